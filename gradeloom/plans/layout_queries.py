"""Queries: runs, bands, as-of and nearest matches, carried values, ordered checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import layout
from gradeloom.plans import roles
from gradeloom.plans.registry import query, with_parts

PAGES = "marks AS (SELECT DISTINCT o_custkey % 200 AS k, o_orderkey % 400 AS page FROM orders)"


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("k"), (F.col("o_orderkey") % 400).alias("page")).distinct()


def _islands(gap: int, start: str = "page") -> str:
    return f"""steps AS (SELECT k, page, CASE WHEN page - lag(page) OVER (PARTITION BY k ORDER BY page) > {gap} THEN 1 ELSE 0 END AS new FROM marks),
runs AS (SELECT k, min(page) AS first, max(page) AS last, count(*) AS length FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY page) AS island FROM steps) GROUP BY k, island)"""


@query(with_parts(PAGES, _islands(1)) + "SELECT k, first, last, length FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY first) = 1")
def page_runs(spark: SparkSession, d: str) -> DataFrame:
    return layout.first_run(_marks(spark, d), "page", "k")


@query(with_parts(PAGES, _islands(2)) + "SELECT k, first, last, length FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY length DESC, first) = 1")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return layout.longest_run(_marks(spark, d), "page", "k", gap=2)


@query(
    with_parts(
        PAGES,
        "steps AS (SELECT k, page, CASE WHEN page - lag(page) OVER (PARTITION BY k ORDER BY page) = 2 THEN 0 ELSE 1 END AS new FROM marks WHERE page % 2 = 0)",
        "runs AS (SELECT k, min(page) AS first, max(page) AS last, count(*) AS length FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY page) AS island FROM steps) GROUP BY k, island)",
    )
    + "SELECT k, first, last, length FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY length DESC, first) = 1"
)
def equally_spaced_run(spark: SparkSession, d: str) -> DataFrame:
    return layout.equally_spaced_run(_marks(spark, d).where("page % 2 = 0"), "page", "k", step=2)


BOXES = "boxes AS (SELECT o_custkey % 100 AS k, o_orderkey AS id, o_orderkey % 5000 AS y0, o_orderkey % 5000 + o_orderkey % 13 AS y1 FROM orders)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    return roles.table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("k"), o.alias("id"), (o % 5000).alias("y0"), (o % 5000 + o % 13).alias("y1"))


@query(
    with_parts(
        BOXES,
        "deep AS (SELECT *, max(y1) OVER (PARTITION BY k ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM boxes)",
        "numbered AS (SELECT k, y0, y1, sum(CASE WHEN y0 > m + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS block FROM deep)",
    )
    + "SELECT k, CAST(block AS BIGINT) AS block, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM numbered GROUP BY ALL"
)
def growing_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = layout.growing_blocks(_boxes(spark, d), "y0", "y1", "k", gap=5)
    return b.groupBy("k", "block").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("n"))


SESSION = "CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END"


@query(f"SELECT event_id, user_id, last_value({SESSION} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def forward_fill_section(spark: SparkSession, d: str) -> DataFrame:
    e = roles.table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    first = e.agg(F.min("event_type").alias("_first"))
    e = e.join(F.broadcast(first), how="cross")  # one value
    return layout.carried(e, F.when(F.col("event_type") == F.col("_first"), F.col("event_id")), "at", "user_id", name="section").select("event_id", "user_id", "section")


TURNS = "turns AS (SELECT conv_id, turn, role, text FROM conversations)"


@query(with_parts(TURNS) + "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prompt FROM turns")
def prompt_of_answer(spark: SparkSession, d: str) -> DataFrame:
    c = roles.table(spark, d, "conversations")
    return layout.carried(c, F.when(F.col("role") == "user", F.col("turn")), "turn", "conv_id", name="prompt").select("conv_id", "turn", "prompt")


@query(
    with_parts(
        "a AS (SELECT o_custkey % 50 AS k, o_orderkey AS id, o_orderkey % 3000 AS y FROM orders WHERE o_orderkey % 2 = 0)",
        "b AS (SELECT o_custkey % 50 AS k, o_orderkey % 3000 AS y, max(o_orderkey) AS session FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)",
    )
    + "SELECT a.id, b.session FROM a ASOF LEFT JOIN b ON a.k = b.k AND a.y >= b.y"
)
def asof_session(spark: SparkSession, d: str) -> DataFrame:
    o = roles.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3000).alias("y"))
    right = o.where("id % 2 = 1").select("k", "y", F.col("id").alias("session"))
    return layout.as_of(o.where("id % 2 = 0"), right, "y", "session", "k").select("id", "session")


@query(
    with_parts(
        "a AS (SELECT o_custkey % 50 AS k, o_orderkey AS id, o_orderkey % 3001 AS y FROM orders WHERE o_orderkey % 2 = 0)",
        "b AS (SELECT o_custkey % 50 AS k, o_orderkey AS right_id, o_orderkey % 3001 AS y FROM orders WHERE o_orderkey % 2 = 1)",
        "d AS (SELECT id, right_id, abs(a.y - b.y) AS distance FROM a JOIN b USING (k))",
    )
    + "SELECT id, right_id, distance FROM d WHERE distance < 12 QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, right_id) = 1"
)
def nearest_mark(spark: SparkSession, d: str) -> DataFrame:
    o = roles.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3001).alias("y"))
    b = o.where("id % 2 = 1").select("k", F.col("id").alias("right_id"), F.col("y").alias("y2"))
    return layout.nearest(o.where("id % 2 = 0"), b, "y", "y2", "k", within=12).select("id", "right_id", "distance")


@query("SELECT p_partkey AS item, CASE WHEN p_size < 11 THEN 1 WHEN p_size < 24 THEN 2 WHEN p_size < 40 THEN 3 ELSE 4 END AS session FROM part WHERE p_size >= 3")
def band_range_join(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame([(3, 1), (11, 2), (24, 3), (40, 4)], "start int, session int")
    b = layout.bands(edges, "start")
    p = roles.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("x"))
    return layout.in_band(p, b, "x").select("item", "session")


@query(
    with_parts("c AS (SELECT DISTINCT n_regionkey AS k, n_nationkey * 10 AS x FROM nation)", "b AS (SELECT k, x, (lag(x) OVER w + x) / 2 AS lo, (lead(x) OVER w + x) / 2 AS hi FROM c WINDOW w AS (PARTITION BY k ORDER BY x))", "p AS (SELECT c_custkey AS id, c_custkey % 5 AS k, c_custkey % 260 AS at FROM customer)")
    + "SELECT id, x AS owner FROM p JOIN b ON p.k = b.k AND (lo IS NULL OR p.at >= lo) AND (hi IS NULL OR p.at < hi)"
)
def midpoint_owner(spark: SparkSession, d: str) -> DataFrame:
    c = roles.table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("k"), (F.col("n_nationkey") * 10).alias("x")).distinct()
    p = roles.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("k"), (F.col("c_custkey") % 260).alias("at"))
    return layout.in_band(p, layout.midpoint_bands(c, "x", "k"), "at", "k").select("id", F.col("x").alias("owner"))


@query(with_parts(BOXES) + "SELECT a.id, b.id AS id2 FROM boxes a JOIN boxes b ON a.k = b.k AND a.y0 <= b.y1 AND b.y0 <= a.y1 WHERE a.id % 2 = 0 AND b.id % 2 = 1")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    left = b.where("id % 2 = 0").select("k", "id", F.col("y0").alias("lo"), F.col("y1").alias("hi"))
    right = b.where("id % 2 = 1").select("k", F.col("id").alias("id2"), F.col("y0").alias("lo2"), F.col("y1").alias("hi2"))
    return layout.overlapping(left, right, "k", width=16).select("id", "id2")


@query(with_parts(BOXES) + "SELECT k, min(y0) AS x0, min(y0) AS y0, max(y1) AS x1, max(y1) AS y1 FROM boxes WHERE y1 > y0 GROUP BY k")
def region_bounds(spark: SparkSession, d: str) -> DataFrame:
    p = _boxes(spark, d).select("k", F.col("y0").alias("x0"), "y0", F.col("y1").alias("x1"), "y1")
    return layout.bounds(p, "k", degenerate=False)


@query(with_parts(BOXES) + "SELECT k, id FROM boxes WHERE y0 < coalesce((SELECT min(y0) FROM boxes f WHERE f.k = boxes.k AND f.id % 17 = 0), 1000000)")
def footnote_trim(spark: SparkSession, d: str) -> DataFrame:
    return layout.before_footnote(_boxes(spark, d), F.col("id") % 17 == 0, "y0", "k").select("k", "id")


@query("SELECT p_brand AS k, p_size AS median FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r = n // 2")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return layout.upper_median(roles.table(spark, d, "part").select(F.col("p_brand").alias("k"), "p_size"), "p_size", "k")


@query(
    with_parts(PAGES, "g AS (SELECT k, page - lag(page) OVER (PARTITION BY k ORDER BY page) AS gap FROM marks)")
    + "SELECT k, gap FROM (SELECT k, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, gap) = 1"
)
def modal_gap(spark: SparkSession, d: str) -> DataFrame:
    return layout.modal_gap(_marks(spark, d), "page", "k")


@query("SELECT user_id, md5(string_agg(event_type, ' ' ORDER BY event_id)) AS digest FROM events GROUP BY user_id")
def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    e = roles.table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("text"))
    return layout.joined_lines(e, ["user_id"], "event_id").select("user_id", F.md5("text").alias("digest"))


@query(
    with_parts(TURNS, "m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM turns)")
    + "SELECT conv_id, CAST(entry AS BIGINT) AS entry, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM m GROUP BY ALL"
)
def continuation_lines(spark: SparkSession, d: str) -> DataFrame:
    c = roles.table(spark, d, "conversations")
    return layout.continued(c, F.col("role") == "user", "turn", "conv_id").select("conv_id", "entry", F.md5("text").alias("digest"))


@query(with_parts(PAGES) + "SELECT k, page, before FROM (SELECT k, page, lag(page) OVER (PARTITION BY k ORDER BY page) AS before FROM marks) WHERE page <> before + 1")
def sequence_faults(spark: SparkSession, d: str) -> DataFrame:
    return layout.sequence_faults(_marks(spark, d), "page", "page", "k").select("k", "page", "before")


@query("SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def all_letters(spark: SparkSession, d: str) -> DataFrame:
    return layout.all_letters(roles.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("letter")), "k", letters="ANR")
