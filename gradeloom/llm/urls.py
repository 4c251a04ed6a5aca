"""URL filtering: host and path rules, and gradient-boosted trees for the rest.

The trees are trained on URLs that a rule labels. Features are small integers taken
from the URL alone: lengths, depth, digit ratio, entropy, parameter counts and how
often training URLs with the same suffix, or the same first path segment, are blocked (a
training URL's own fold is left out of its statistics, so that they don't tell its label).
Boosting is histogram-based: each level of a tree is one aggregation of gradients by
(node, feature, bin), in fixed-point numbers so that the sums don't depend on order.
The trained model is a column expression.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table


@dataclass(frozen=True)
class Rule:
    """site: host followed by the start of the path, such as ``example.org/es/``."""

    site: str
    verdict: str

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.site.partition("/")[2]


#: Fixed values.
RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS = 64
SCALE = 1 << 20
#: Folds of the statistics of suffixes and segments.
FOLDS = 5


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Both empty for a null or a URL without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(site, verdict) of the longest rule that fits, else nulls; a rule fits its host and
    all subdomains, if the path starts with the rule's."""
    site, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.site), r.site)):  # the longest last, outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        site = F.when(fits, F.lit(r.site)).otherwise(site)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return site, verdict


def _count(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def _bin(v: Column) -> Column:
    """Exact up to 16, then eight bins for each doubling, BINS at most."""
    v = v.cast("double")
    return F.least(F.when(v <= 16, v).otherwise(F.floor(16 + 8 * F.log2(v / 16))), F.lit(BINS - 1)).cast("int")


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) plus the integer features f_* and the keys suffix, segment."""
    u = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    step = urls.withColumns({
        "_u": u,
        "_chars": F.array_distinct(F.split(u, "")),
        "suffix": F.concat_ws(" ", F.regexp_extract("host", r"([^.]*)$", 1), F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)),
        "segment": F.regexp_extract("path", r"^/([^/]*)", 1),
    })
    n = F.greatest(F.length("_u"), F.lit(1))
    share = lambda c: (F.length("_u") - F.length(F.replace(F.col("_u"), c, F.lit("")))) / n
    entropy = F.aggregate(F.transform("_chars", lambda c: F.when(c != "", -share(c) * F.log2(share(c))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    step = step.withColumns({
        "f_length": _bin(F.length("_u")),
        "f_host": _bin(F.length("host")),
        "f_labels": _bin(_count(F.col("host"), ".")),
        "f_hyphens": _bin(_count(F.col("host"), "-")),
        "f_depth": _bin(_count(F.col("path"), "/")),
        "f_digits": _bin(F.floor((F.length("_u") - F.length(F.translate("_u", "0123456789", ""))) * 40 / n)),
        "f_entropy": _bin(F.floor(F.coalesce(entropy, F.lit(0.0)) * 10)),
        "f_params": _bin(F.when(query == "", 0).otherwise(_count(query, "&") + 1)),
    })
    return step.drop("_u", "_chars")


def block_counts(labelled: DataFrame, key: str, *more: str) -> DataFrame:
    """(_key, more.., n_key, s_key): rows and blocked rows of each key."""
    return labelled.groupBy(F.col(key).alias(f"_{key}"), *more).agg(F.count("*").alias(f"n_{key}"), F.sum("y").alias(f"s_{key}"))


def _rate(n: Column, s: Column) -> Column:
    """The share of blocked rows in 0..BINS-1, drawn towards the half by two rows."""
    return F.floor((F.coalesce(s, F.lit(0)) + 1) / (F.coalesce(n, F.lit(0)) + 2) * (BINS - 1)).cast("int")


KEYS = ("suffix", "segment")
NAMES = ("f_length", "f_host", "f_labels", "f_hyphens", "f_depth", "f_digits", "f_entropy", "f_params", "f_suffix", "f_segment")


def with_rates(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    """Adds f_suffix and f_segment; keys never seen in training take the middle."""
    for key, t in rates.items():
        rows = rows.join(t, F.col(key) == F.col(f"_{key}"), "left").withColumn(f"f_{key}", _rate(F.col(f"n_{key}"), F.col(f"s_{key}"))).drop(f"_{key}", f"n_{key}", f"s_{key}")
    return rows


def with_fold_rates(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    """The same for the training rows themselves: their own fold is left out."""
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    for key, t in rates.items():
        own = block_counts(rows, key, "_fold").select(F.col(f"_{key}").alias("_k"), F.col("_fold").alias("_f"), F.col(f"n_{key}").alias("_n"), F.col(f"s_{key}").alias("_s"))
        met = rows.join(t, F.col(key) == F.col(f"_{key}")).join(own, (F.col(key) == F.col("_k")) & (F.col("_fold") == F.col("_f")))
        rows = met.withColumn(f"f_{key}", _rate(F.col(f"n_{key}") - F.col("_n"), F.col(f"s_{key}") - F.col("_s"))).drop(f"_{key}", f"n_{key}", f"s_{key}", "_k", "_f", "_n", "_s")
    return rows.drop("_fold")


@dataclass
class Tree:
    """splits[node] = (feature, last bin of the left side); leaves[node] = fixed-point value."""

    splits: dict[int, tuple[str, int]]
    leaves: dict[int, int]

    def node(self, depth: int) -> Column:
        """The node that a row has reached after ``depth`` levels (the root is 1)."""
        at = F.lit(1)
        for d in range(depth):
            nxt = at
            for node, (name, cut) in self.splits.items():
                if node.bit_length() == d + 1:
                    nxt = F.when(at == node, F.when(F.col(name) <= cut, F.lit(2 * node)).otherwise(F.lit(2 * node + 1))).otherwise(nxt)
            at = nxt
        return at

    def value(self) -> Column:
        def below(node: int) -> Column:
            if node not in self.splits:
                return F.lit(self.leaves.get(node, 0)).cast("long")
            name, cut = self.splits[node]
            return F.when(F.col(name) <= cut, below(2 * node)).otherwise(below(2 * node + 1))

        return below(1)


@dataclass
class Model:
    """trees add up to the log odds of block, in fixed-point numbers; rates by key."""

    base: int
    trees: list[Tree]
    rates: dict[str, DataFrame]

    def score(self) -> Column:
        return reduce(lambda a, b: a + b, [t.value() for t in self.trees], F.lit(self.base).cast("long"))


def train(labelled: DataFrame, trees: int = 10, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> Model | None:
    """labelled: url, host, path, y (1: block). None if there are no rows.

    What reaches the driver is one histogram a level: at most 2**depth nodes times
    features times BINS.
    """
    from math import log

    rows = saved(features(labelled), "features")
    rates = {k: saved(block_counts(rows, k), f"rates-{k}") for k in KEYS}
    grouped = with_fold_rates(rows, rates).groupBy(*NAMES).agg(F.count("*").alias("n"), F.sum("y").alias("n_block"))
    state = saved(grouped, "grouped")
    total = state.agg(F.sum("n"), F.sum("n_block")).head()
    if not total[0]:
        return None
    base = round(log((total[1] + 0.5) / (total[0] - total[1] + 0.5)) * SCALE)
    model = Model(base, [], rates)
    state = state.withColumn("margin", F.lit(base).cast("long"))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("margin") / SCALE))
        graded = state.withColumns({"g": F.round((F.col("n") * p - F.col("n_block")) * SCALE).cast("long"), "h": F.round(F.col("n") * p * (1 - p) * SCALE).cast("long")})
        tree = Tree({}, {})
        for d in range(depth):
            reached = graded.withColumn("node", tree.node(d))
            long = reached.select("node", "g", "h", F.posexplode(F.array(*NAMES)).alias("f", "bin"))
            hist = long.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            if not _grow(tree, hist, d, ridge, rate):
                break
        model.trees.append(tree)
        state = saved(state.withColumn("margin", F.col("margin") + tree.value()), "margins")
    return model


def _grow(tree: Tree, hist: list, depth: int, ridge: float, rate: float) -> bool:
    """Splits the level's nodes where that lowers the loss; sets their children's leaves."""
    lam = ridge * SCALE
    cells: dict[int, dict[int, dict[int, tuple[int, int]]]] = {}
    for r in hist:
        cells.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
    grown = False
    for node, by in sorted(cells.items()):
        if node.bit_length() != depth + 1:
            continue
        g0, h0 = (sum(v[i] for v in by[0].values()) for i in (0, 1))
        tree.leaves[node] = round(-rate * SCALE * g0 / (h0 + lam))
        best = (1e-6 * SCALE, None)
        for f, bins in sorted(by.items()):
            g = h = 0
            for b in sorted(bins)[:-1]:
                g, h = g + bins[b][0], h + bins[b][1]
                gain = g * g / (h + lam) + (g0 - g) ** 2 / (h0 - h + lam) - g0 * g0 / (h0 + lam)
                if gain > best[0]:
                    best = (gain, (f, b, g, h))
        if best[1]:
            f, b, g, h = best[1]
            tree.splits[node] = (NAMES[f], b)
            tree.leaves[2 * node] = round(-rate * SCALE * g / (h + lam))
            tree.leaves[2 * node + 1] = round(-rate * SCALE * (g0 - g) / (h0 - h + lam))
            grown = True
    return grown


def training_sample(urls: DataFrame, rules: tuple[Rule, ...], rows: int) -> DataFrame:
    """About ``rows`` distinct URLs that a rule labels: those with a hash below the share
    that the count gives (all of them, if they are fewer)."""
    host, path = host_and_path()
    _, verdict = rule_for(F.col("host"), F.col("path"), rules)
    labelled = urls.select("url").withColumns({"host": host, "path": path}).withColumn("verdict", verdict).where(F.col("verdict").isNotNull())
    labelled = labelled.withColumn("_h", F.pmod(F.xxhash64("url"), F.lit(1 << 40)))
    n = labelled.agg(F.approx_count_distinct("url")).head()[0] or 0
    if n > rows:
        labelled = labelled.where(F.col("_h") < int((1 << 40) * rows / n))
    return labelled.select("url", "host", "path", (F.col("verdict") == "block").cast("long").alias("y")).distinct()


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, train_rows: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of ``pages``.

    train_rows bounds the labelled sample that the trees are fitted to. score is the
    model's log odds of block. Null URLs and URLs without a scheme have an empty host
    and path, no rule and the model's verdict; without labelled URLs that is allow.
    Repeated rows are judged each; other columns are not used, whatever their names.
    """
    own = pages.select("page_id", "url")
    model = train(saved(training_sample(own, rules, train_rows), "labelled"))
    host, path = host_and_path()
    site, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = own.withColumns({"host": host, "path": path}).withColumns({"rule": site, "_by_rule": verdict})
    if model is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scored = with_rates(features(rows), model.rates).withColumn("_s", model.score())
    own_verdict = F.when(F.col("_s") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", own_verdict).alias("verdict"), (F.col("_s") / SCALE).alias("score"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
