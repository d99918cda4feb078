"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Everything runs as DataFrame expressions. The trees are fitted by Spark's own boosted-tree estimator on
labelled URLs and turned into CASE expressions, so that scoring stays inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled URLs that the trees are fitted on, at most.
MOST_LABELLED = 20_000
TREES, DEPTH = 12, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query as (action, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# Words of which the labelled URLs are made.
_PLAIN = "news weather garden recipes history science travel music library school museum village football cinema review notes journal photos market council".split()
_BAIT = "cheap free best hot win fast extra big".split()
_LURE = "pills bets casino loans replica meds slots deals".split()


def host_of(url: Column) -> Column:
    """The lower-cased host; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


def _entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c))) / n
    return F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


FEATURES = ["length", "host_length", "depth", "digit_ratio", "entropy", "host_entropy", "parameters", "labels", "hyphens", "longest_label", "suffix_rate"]


def with_features(df: DataFrame, suffix_rates: dict[str, float], base: float) -> DataFrame:
    """df (url) with one column f_<name> for each lexical feature."""
    url, host, path = F.coalesce("url", F.lit("")), host_of(F.col("url")), path_of(F.col("url"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    rates = F.create_map(*[F.lit(x) for kv in (suffix_rates or {"": base}).items() for x in kv])
    made = {
        "length": F.length(url), "host_length": F.length(host), "depth": _count(path, "/"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url), "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "labels": _count(host, "."), "hyphens": _count(host, "-"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))),
        "suffix_rate": F.coalesce(rates[F.substring_index(host, ".", -1)], F.lit(base)),
    }
    return df.withColumns({f"f_{k}": made[k].cast("double") for k in FEATURES})


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URLs of the registered query: url, blocked (0 or 1), made from word lists by one rule."""
    texts = lambda xs: F.array(*map(F.lit, xs))
    grid = spark.range(2400).select("id", (F.col("id") % 2).alias("blocked"), F.pmod(F.hash("id", F.lit(1)), F.lit(1000)).alias("n"))
    pick = lambda xs, salt: F.element_at(texts(xs), F.pmod(F.hash("id", F.lit(salt)), F.lit(len(xs))) + 1)
    plain = F.concat(pick(_PLAIN, 2), pick(["", "hill", "lane", "port"], 3))
    bait = F.concat(pick(_BAIT, 4), F.lit("-"), pick(_LURE, 5))
    host = F.concat(pick(["", "www.", "blog.", "m."], 6), F.when(F.col("blocked") == 1, bait).otherwise(plain), F.lit(".example."), pick(["com", "net", "org"], 7))
    path = F.concat(F.lit("/"), pick(["en", "fr", "de", "es"], 8), F.lit("/"), F.col("n"), pick(["", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed"], 9))
    return grid.select(F.concat(pick(["https://", "http://"], 10), host, path).alias("url"), "blocked")


class UrlModel:
    """Boosted trees as one score expression over a URL's features."""

    def __init__(self, labelled: DataFrame, trees: int = TREES, depth: int = DEPTH):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        known = labelled.where("url is not null and blocked is not null").orderBy(F.xxhash64("url")).limit(MOST_LABELLED)
        per = known.groupBy(F.substring_index(host_of(F.col("url")), ".", -1).alias("suffix")).agg(F.sum("blocked").alias("k"), F.count(F.lit(1)).alias("n"))
        rows = per.collect()  # at most one for each of the labelled URLs
        total, hits = sum(r.n for r in rows), sum(r.k for r in rows)
        self.base = hits / total if total else 0.0
        self.rates = {r.suffix: (r.k + 10 * self.base) / (r.n + 10) for r in rows}
        self.trees: list[tuple[float, object]] = []
        if 0 < hits < total:
            frame = with_features(known, self.rates, self.base).withColumn("label", F.col("blocked").cast("double"))
            rows = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(frame)
            fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32).fit(rows.select("features", "label").coalesce(1))
            self.trees = list(zip(fitted.treeWeights, [t._call_java("rootNode") for t in fitted.trees], strict=True))

    def _tree(self, node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.col(f"f_{FEATURES[split.featureIndex()]}") <= float(split.threshold()), self._tree(node.leftChild())).otherwise(self._tree(node.rightChild()))

    def score(self) -> Column:
        """Probability of block, over the columns of with_features."""
        if not self.trees:
            return F.lit(self.base)
        margin = reduce(lambda a, b: a + b, (self._tree(n) * float(w) for w, n in self.trees))
        return 1 / (1 + F.exp(-2 * margin))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, or null; rules is a short list (1000 at most)."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules")
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages (page_id, url).

    A null url, or one without ://, has an empty host and path, so that only the trees judge it, as an empty text. A
    long url is judged whole. Repeated rows stay separate rows; other columns are ignored; an empty table gives no rows.
    """
    base = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    scored = with_features(base, model.rates, model.base).withColumn("score", model.score())
    verdict = F.coalesce("__rule.action", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "score")
