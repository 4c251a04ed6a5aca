"""Queries: scalar text functions, markup, retrieval with recall, titles, quotes, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import scalars
from gradeloom.operators import agreement, retrieve
from gradeloom.operators.stored import checkpointed
from gradeloom.plans import roles
from gradeloom.plans.registry import query, r3, with_parts

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in scalars.STOP_WORDS)
_stem = "w"
for _s in reversed(scalars.SUFFIXES):
    _tail = " || 'y'" if _s == "ies" else ""
    _stem = f"CASE WHEN ends_with(w, '{_s}') AND length(w) - {len(_s)} >= 4 THEN left(w, length(w) - {len(_s)}){_tail} ELSE {_stem} END"

TERMS = f"""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9'']+')) AS w FROM documents),
terms AS (SELECT doc_id, {_stem} AS term FROM words WHERE length(w) >= 3 AND w NOT IN ({STOP})),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)"""
ASKED = f"""qwords AS (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9'']+')) AS w FROM benchmark),
asked AS (SELECT DISTINCT item_id AS query_id, {_stem} AS term FROM qwords WHERE length(w) >= 3 AND w NOT IN ({STOP}))"""


@query(with_parts(TERMS) + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM counts GROUP BY term")
def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = retrieve.term_counts(roles.table(spark, d, "documents"), "doc_id")
    return c.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


SCORES = """size AS (SELECT count(*) AS n_docs, (SELECT count(*) FROM terms) / count(*) AS mean_terms FROM documents),
lengths AS (SELECT doc_id, count(*) AS doc_terms FROM terms GROUP BY doc_id),
freq AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
scores AS (
  SELECT query_id, doc_id, sum(ln((n_docs + 1.0) / (df + 1.0)) * (tf * 2.5) / (tf + 1.5 * (0.4 + 0.6 * doc_terms / mean_terms))) AS score
  FROM asked JOIN counts USING (term) JOIN freq USING (term) JOIN lengths USING (doc_id), size GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1000000 + 0.5) / 1000000 DESC, doc_id) AS rank FROM scores)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    queries = roles.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scores = retrieve.bm25_scores(roles.table(spark, d, "documents"), queries)
    return retrieve.promoted_rank(scores, "query_id", "doc_id")


@query(with_parts(TERMS, ASKED, SCORES) + f"SELECT query_id, doc_id, {r3('score')} AS score, rank FROM ranked WHERE rank <= 8")
def bm25_top_k(spark: SparkSession, d: str) -> DataFrame:
    top = retrieve.top_k(_ranked(spark, d), 8)
    return top.select("query_id", "doc_id", scalars.half_up(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


RELEVANT = "relevant AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text))"


#: Words inside a passage that a text must have in a row to be searched for it.
INSIDE = 3


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a document and a benchmark passage that it holds.

    Words inside a passage, behind its first separator, are whole words of any text that holds
    it, whatever stands before; documents are searched only where they have them in a row.
    Passages too short for that are a small table and are searched for everywhere.
    """
    docs = roles.table(spark, d, "documents").select("doc_id", "text")
    b = roles.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), F.split("text", r"[ \n]").alias("_w")).where("passage IS NOT NULL")
    key = lambda c, i: F.array_join(F.slice(c, i, F.lit(INSIDE)), " ")
    long = b.where(F.size("_w") >= INSIDE + 2).select("query_id", key(F.col("_w"), F.lit(2)).alias("_k"))
    words = docs.select("doc_id", F.split("text", r"[ \n]").alias("_w")).where(F.size("_w") >= INSIDE)
    keys = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - INSIDE + 1), lambda i: key(F.col("_w"), i)))).alias("_k"))
    near = keys.join(long, "_k").select("doc_id", "query_id").distinct()
    found = docs.join(near.join(b.select("query_id", "passage"), "query_id"), "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    short = b.where(F.size("_w") < INSIDE + 2).select("query_id", "passage")
    return found.unionByName(docs.join(F.broadcast(short), F.contains("text", "passage")).select("query_id", "doc_id"))


@query(
    with_parts(TERMS, ASKED, SCORES, RELEVANT, "ks AS (SELECT CAST(unnest([1, 3, 5, 8, 12, 20]) AS INTEGER) AS k)")
    + f"SELECT k, count(*) FILTER (WHERE rank <= k) AS hits, count(*) AS relevant, {r3('count(*) FILTER (WHERE rank <= k) / count(*)')} AS recall FROM relevant LEFT JOIN ranked USING (query_id, doc_id), ks GROUP BY k"
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.recall_at(_ranked(spark, d), _relevant(spark, d))


@query(with_parts(TERMS, ASKED, SCORES) + "SELECT query_id, count(*) AS n FROM ranked WHERE rank > 12 GROUP BY query_id")
def second_tier_size(spark: SparkSession, d: str) -> DataFrame:
    """The second tier of all ranked documents: those outside of the first."""
    pool = checkpointed(_ranked(spark, d).select("query_id", "doc_id", "rank"))
    return retrieve.second_tier(pool, retrieve.top_k(pool, 12), "query_id", "doc_id").groupBy("query_id").agg(F.count("*").alias("n"))


@query(
    with_parts(TERMS, ASKED, SCORES, "prior AS (SELECT query_id, doc_id, score * CASE WHEN lang = 'en' THEN 1.3 ELSE 1.0 END AS score, coalesce(source IN ('src1', 'src2'), false) AS promoted FROM scores JOIN documents USING (doc_id))")
    + f"SELECT query_id, doc_id, {r3('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY promoted DESC, floor(score * 1000000 + 0.5) / 1000000 DESC, doc_id) AS rank FROM prior) WHERE rank <= 8"
)
def promoted_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Documents of two sources come first, those in one language weigh more: the shortlist's length is 8."""
    docs = roles.table(spark, d, "documents")
    asked = roles.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scores = retrieve.bm25_scores(docs, asked).join(docs.select("doc_id", "lang", "source"), "doc_id")
    top = retrieve.top_k(retrieve.promoted_rank(scores, "query_id", "doc_id", F.col("source").isin("src1", "src2"), F.col("lang") == "en"), 8)
    return top.select("query_id", "doc_id", scalars.half_up(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "pages").select("page_id", F.md5(scalars.without_tags(F.col("html"))).alias("digest"))


#: Markup made of columns, and the text it reads as.
MARKUP = """m AS (SELECT p_partkey AS item, p_size AS a, p_partkey % 9 + 2 AS b, p_brand AS w, p_partkey % 6 AS k, p_partkey % 4 AS deep FROM part)"""
_READ = """CASE k WHEN 0 THEN '((' || a || ')/(' || b || '))/(' || w || ')' WHEN 1 THEN '\u221a(' || a || '^' || b || ')' WHEN 2 THEN 'segment ' || w WHEN 3 THEN a || '.' || b || '-repeating'
 WHEN 4 THEN a || '_' || b || ' \u2264 ' || w || ' & ' || a || ' \u2212 ' || b ELSE '(' || a || '^2)/(' || b || ')' END"""


@query(with_parts(MARKUP) + f"SELECT item, 'x ' || {_READ} || ' y ' || CASE deep WHEN 0 THEN '((((1)/(2))/(3))/(4))/(' || a || ')' ELSE '\u221a((' || a || ')/(' || b || '))' END AS text FROM m")
def html_to_plain(spark: SparkSession, d: str) -> DataFrame:
    """Fractions in fractions, powers in radicals and the like, made of every part's columns."""
    s = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    frac = lambda x, y: s('<span class="frac"><span>', x, "</span><span>", y, "</span></span>")
    root = lambda x: s('<span class="radical"><span class="radicand">', x, "</span></span>")
    k = F.col("p_partkey") % 6
    a, b, w = F.col("p_size").cast("string"), (F.col("p_partkey") % 9 + 2).cast("string"), F.col("p_brand")
    nested = frac(frac(frac(frac(F.lit("1"), F.lit("2")), F.lit("3")), F.lit("4")), a)
    body = (
        F.when(k == 0, frac(frac(a, b), s("<i>", w, "</i>"))).when(k == 1, root(s(a, "<sup>", b, "</sup>"))).when(k == 2, s('<span class="segment">', w, "</span>"))
        .when(k == 3, s('<span class="repeat">', a, ".", b, "</span>")).when(k == 4, s(a, "<sub>", b, "</sub> &le; ", w, " &amp; ", a, " &minus; ", b)).otherwise(frac(s(a, "<sup>2</sup>"), b))
    )
    html = s("<p>x ", body, "<br/>y ", F.when(F.col("p_partkey") % 4 == 0, nested).otherwise(root(frac(a, b))), "</p>")
    return roles.table(spark, d, "part").select(F.col("p_partkey").alias("item"), scalars.plain_markup(html).alias("text"))


NORMAL = "trim(regexp_replace(translate(lower({0}), '‘’“”–—', '''''\"\"--'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey AS item, {NORMAL.format('p_name')} AS title FROM part")
def normal_titles(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "part").select(F.col("p_partkey").alias("item"), scalars.normal_title(F.col("p_name")).alias("title"))


@query(
    f"""WITH titles AS (SELECT c_nationkey AS k, {NORMAL.format("c_mktsegment || ' ' || c_custkey % 7")} AS n, count(*) AS c, min(c_custkey) AS id FROM customer GROUP BY ALL)
SELECT s_suppkey AS ask_id, id FROM supplier LEFT JOIN titles ON s_nationkey = k AND c = 1 AND n = {NORMAL.format("'BUILDING—' || s_suppkey % 7")}"""
)
def title_unique_resolve(spark: SparkSession, d: str) -> DataFrame:
    c = roles.table(spark, d, "customer")
    titles = c.select(F.col("c_nationkey").alias("k"), F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 7).cast("string")).alias("title"), F.col("c_custkey").alias("id"))
    s = roles.table(spark, d, "supplier")
    asked = s.select(F.col("s_suppkey").alias("ask_id"), F.col("s_nationkey").alias("k"), F.concat(F.lit("BUILDING—"), (F.col("s_suppkey") % 7).cast("string")).alias("title"))
    return agreement.unique_titles(titles, asked, "k").select("ask_id", "id")


@query(
    f"""WITH q AS (SELECT conv_id, text FROM conversations WHERE turn = (SELECT min(turn) FROM conversations))
SELECT c.conv_id, c.turn, {NORMAL.format("q.text")} <> '' AND contains(' ' || {NORMAL.format('c.text')} || ' ', {NORMAL.format("q.text")}) AS found
FROM conversations c JOIN q ON c.conv_id = q.conv_id"""
)
def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    c = roles.table(spark, d, "conversations")
    least = c.agg(F.min("turn").alias("turn"))
    q = c.join(F.broadcast(least), "turn").select("conv_id", F.col("text").alias("quote"))
    return c.join(q, "conv_id").select("conv_id", "turn", agreement.contains_quote(F.col("text"), F.col("quote")).alias("found"))


DIGEST = "left(sha256(concat_ws(chr(31), source, lang, text)), 32)"


@query(f"SELECT doc_id FROM documents WHERE {DIGEST} NOT IN (SELECT {DIGEST} FROM documents WHERE doc_id % 4 = 0)")
def digest_anti_join(spark: SparkSession, d: str) -> DataFrame:
    docs = roles.table(spark, d, "documents").withColumn("digest", scalars.field_digest(F.col("source"), F.col("lang"), F.col("text")))
    return docs.join(docs.where("doc_id % 4 = 0").select("digest"), "digest", "left_anti").select("doc_id")


@query("SELECT page_id, (len(regexp_extract_all(html, '<[^>]+>'))) AS tags, CASE WHEN trim(coalesce(html, '')) = '' THEN 0 ELSE len(regexp_split_to_array(trim(html), '\\s+')) END AS words FROM pages")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    p = roles.table(spark, d, "pages")
    return p.select("page_id", F.regexp_count("html", F.lit("<[^>]+>")).cast("long").alias("tags"), scalars.word_count(F.coalesce("html", F.lit(""))).cast("long").alias("words"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 5 WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'pts' WHEN 1 THEN ' -' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5 of 60'
 WHEN 2 THEN 'none' WHEN 3 THEN '' ELSE '.25' END AS v FROM lineitem)
SELECT l_linenumber, v AS value, TRY_CAST(nullif(regexp_extract(v, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS number, count(*) AS n FROM r GROUP BY ALL"""
)
def leading_numbers(spark: SparkSession, d: str) -> DataFrame:
    k, q = F.col("l_linenumber") % 5, F.col("l_quantity").cast("int").cast("string")
    v = F.when(k == 0, F.concat(q, F.lit("pts"))).when(k == 1, F.concat(F.lit(" -"), q, F.lit(".5 of 60"))).when(k == 2, "none").when(k == 3, "").otherwise(".25")
    r = roles.table(spark, d, "lineitem").select("l_linenumber", v.alias("value"))
    return r.groupBy("l_linenumber", "value").agg(F.first(scalars.leading_number(F.col("value"))).alias("number"), F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT c_custkey AS id, c_acctbal / 10000 AS gap FROM customer)
SELECT id, floor(gap * 1000 + 0.5) / 1000 AS rounded, CASE WHEN gap <= -0.15 THEN 'far-below' WHEN gap <= -0.05 THEN 'below' WHEN gap < 0.05 THEN 'near' ELSE 'above' END AS class,
       CASE WHEN floor(gap * 100 + 0.5) > 0 THEN '+' ELSE '' END || CAST(CAST(floor(gap * 100 + 0.5) AS BIGINT) AS VARCHAR) AS signed, CAST(CAST(floor(gap * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS pct FROM g"""
)
def gap_formats(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("gap")
    c = roles.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("gap"))
    return c.select("id", scalars.half_up(g).alias("rounded"), scalars.gap_class(g).alias("class"), scalars.signed_text(g).alias("signed"), scalars.percent_text(g).alias("pct"))


CODES = """c AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'NY-NY-' WHEN 1 THEN 'NY-' ELSE '' END || (c_nationkey % 3 + 6) || '.RP.' || c_custkey % 9 || CASE c_custkey % 5 WHEN 0 THEN '.a' WHEN 1 THEN 'b' ELSE '' END AS raw FROM customer)"""


@query(
    with_parts(CODES, "n AS (SELECT raw, regexp_replace(regexp_replace(trim(raw), '^(NY-){2,}', 'NY-'), '\\.(\\d+)\\.([a-z])$', '.\\1\\2') AS code FROM c)")
    + """SELECT raw, code, CASE WHEN starts_with(code, 'NY-') THEN code ELSE 'NY-' || code END AS full, CAST(nullif(regexp_extract(code, '^(?:NY-)?(\\d+)\\.([A-Z]+)\\.(\\d+)([a-z]?)$', 1), '') AS INTEGER) AS grade,
       nullif(regexp_extract(code, '^(?:NY-)?(\\d+)\\.([A-Z]+)\\.(\\d+)([a-z]?)$', 2), '') AS domain, nullif(regexp_extract(code, '^(?:NY-)?(\\d+)\\.([A-Z]+)\\.(\\d+)([a-z]?)$', 4), '') AS letter FROM n"""
)
def normal_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.concat(
        F.when(k % 4 == 0, "NY-NY-").when(k % 4 == 1, "NY-").otherwise(""), (F.col("c_nationkey") % 3 + 6).cast("string"), F.lit(".RP."), (k % 9).cast("string"), F.when(k % 5 == 0, ".a").when(k % 5 == 1, "b").otherwise("")
    )
    c = roles.table(spark, d, "customer").select(raw.alias("raw")).distinct()
    c = c.withColumn("code", scalars.undotted_letter(scalars.unrepeated_prefix(F.col("raw"))))
    part = lambda p: scalars.code_part(F.col("code"), p).alias(p)
    return c.select("raw", "code", scalars.prefixed(F.col("code")).alias("full"), part("grade"), part("domain"), part("letter"))


@query(
    """WITH l AS (SELECT DISTINCT s_nationkey AS k, s_nationkey || '.RP.' || s_nationkey % 4 || 'a, ' || s_nationkey % 5 || 'b,' || s_nationkey % 6 || '.EE.1' AS line FROM supplier)
SELECT k, CAST(unnest(range(3)) AS INTEGER) AS pos, unnest([k || '.RP.' || k % 4 || 'a', k || '.RP.' || k % 5 || 'b', k % 6 || '.EE.1']) AS code FROM l"""
)
def expanded_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_nationkey")
    line = F.concat(k, F.lit(".RP."), k % 4, F.lit("a, "), k % 5, F.lit("b,"), k % 6, F.lit(".EE.1"))
    s = roles.table(spark, d, "supplier").select(k.alias("k"), line.alias("line")).distinct()
    return s.select("k", F.posexplode(scalars.expanded_codes(F.col("line"))).alias("pos", "code"))


@query("SELECT n_nationkey AS k, 'Grade ' || n_nationkey % 9 || ' Unit ' || n_regionkey || ' Lesson ' || n_nationkey || ': ' || n_name AS cite, CAST(n_nationkey % 9 AS INTEGER) AS grade, CAST(n_regionkey AS INTEGER) AS unit, CAST(n_nationkey AS INTEGER) AS lesson, n_name AS title FROM nation")
def citation_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = roles.table(spark, d, "nation").select(k.alias("k"), F.concat(F.lit("Grade "), k % 9, F.lit(" Unit "), "n_regionkey", F.lit(" Lesson "), k, F.lit(": "), "n_name").alias("cite"))
    return n.withColumn("_c", scalars.citation(F.col("cite"))).select("k", "cite", "_c.*")
