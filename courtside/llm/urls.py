"""URL filters: allow and block rules, and for the other URLs gradient-boosted trees on lexical features.

Everything is a Spark expression or Spark's own tree ensemble; the trees are trained on URLs that the caller has labelled (the registered
query takes the verdicts of the rules as labels).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.store import new_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
PER_VERDICT = 5000  # different labelled URLs of either verdict that the trees are trained on; their weights stand for all rows
TREES, DEPTH, RATE = 16, 4, 0.3
PRIOR = 20.0  # URLs of the average verdict that a suffix's statistics start with

FEATURES = ["n_url", "n_host", "n_path", "n_query", "depth", "labels", "digits", "hyphens", "parameters", "entropy", "suffix_share", "suffix_weight"]


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with all its subdomains ("": any host) and paths that begin with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        here = (host == self.host) | F.endswith(host, F.lit("." + self.host)) if self.host else F.lit(True)
        return here & F.startswith(path, F.lit(self.path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null and where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def by_rules(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equally long ones the first listed), else null. For lists of up to some hundreds."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        name = F.when(rule.fits(host, path), F.lit(rule.name)).otherwise(name)
        verdict = F.when(rule.fits(host, path), F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def with_features(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the FEATURES; ``suffixes`` has suffix, suffix_share, suffix_weight, and a row for null: the average."""

    def count(text: Column, chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    sizes = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double"))
    entropy = F.aggregate(F.filter(sizes, lambda k: k > 0), F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))
    plain = {
        "n_url": F.length(url), "n_host": F.length(host), "n_path": F.length(path), "n_query": F.length(query),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")), "labels": count(host, ".") + 1, "digits": count(url, "0123456789") / n,
        "hyphens": count(host, "-"), "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "entropy": entropy,
    }
    out = urls.select("*", *[c.cast("double").alias(k) for k, c in plain.items()], suffix_of(host).alias("suffix"))
    # As many suffixes as the labelled URLs have: the optimizer broadcasts them if they are few.
    average = suffixes.where("suffix is null").first()
    out = out.join(suffixes.where("suffix is not null"), "suffix", "left")
    return out.fillna({"suffix_share": average["suffix_share"], "suffix_weight": 0.0})


class UrlModel:
    """Trees over the features, with the suffix statistics that these were computed from."""

    def __init__(self, suffixes: DataFrame, trees: GBTClassificationModel | None, share: float):
        self.suffixes, self.trees, self.share = suffixes, trees, share

    def block_probability(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with url, host and path) and ``blocked``, the probability of the verdict block."""
        if self.trees is None:
            return urls.withColumn("blocked", F.lit(self.share))
        keep = urls.columns
        scored = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(urls, self.suffixes)))
        return scored.select(*keep, vector_to_array("probability")[1].alias("blocked"))


def train_urls(labelled: DataFrame, per_verdict: int = PER_VERDICT) -> UrlModel:
    """Suffix statistics of all rows, and trees trained on at most ``per_verdict`` different URLs of either ``verdict`` (allow, block).

    These are taken by a hash of the url and weigh as many rows as they have, scaled so that both verdicts keep their shares of the table.
    host and path are given. Without rows of both verdicts the model is their share (0 without any rows).
    """
    spark = labelled.sparkSession
    rows = labelled.select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("label"))
    path = new_path(spark, "url-suffixes")
    by_suffix = rows.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    by_suffix.write.parquet(path)
    by_suffix = spark.read.parquet(path)
    total = by_suffix.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    of_verdict = {0.0: (total["n"] or 0) - (total["bad"] or 0.0), 1.0: total["bad"] or 0.0}
    share = of_verdict[1.0] / total["n"] if total["n"] else 0.0
    statistics = by_suffix.select("suffix", ((F.col("bad") + PRIOR * share) / (F.col("n") + PRIOR)).alias("suffix_share"), F.log1p("n").alias("suffix_weight"))
    average = spark.range(1).select(F.lit(None).cast("string").alias("suffix"), F.lit(share).alias("suffix_share"), F.lit(0.0).alias("suffix_weight"))
    path = new_path(spark, "url-suffix-shares")
    statistics.union(average).write.parquet(path)
    suffixes = spark.read.parquet(path)
    if share in (0.0, 1.0):
        return UrlModel(suffixes, None, share)
    different = rows.groupBy("label", "url", "host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"))
    some = [different.where(F.col("label") == v).orderBy(F.xxhash64("url"), "url", "host", "path").limit(per_verdict) for v in (0.0, 1.0)]
    path = new_path(spark, "labelled-urls")
    some[0].union(some[1]).write.parquet(path)
    some = spark.read.parquet(path)
    taken = {r["label"]: r for r in some.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("urls")).collect()}
    # Weights add up to the number of URLs taken, so that the trees' bounds mean the same at any size.
    scale = {v: of_verdict[v] / r["n"] * sum(x["urls"] for x in taken.values()) / total["n"] for v, r in taken.items()}
    some = some.withColumn("weight", F.col("n") * F.when(F.col("label") == 1.0, scale[1.0]).otherwise(scale[0.0]))
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(some, suffixes)).select("features", "label", "weight")
    return UrlModel(suffixes, GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=11, weightCol="weight").fit(table), share)


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Per row: ``id_col``, host, path, rule (the longest that fits, else null), blocked (the trees' probability) and verdict.

    The verdict is the rule's, else block if the probability reaches ``threshold``, else allow. A null url has an empty host and path, as
    one without ``://``; ids may repeat or be null; other columns are not read. Long urls are judged whole.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = by_rules(rules, F.col("host"), F.col("path"))
    urls = urls.withColumn("rule", name).withColumn("verdict", verdict)
    model = train_urls(urls.where(F.col("verdict").isNotNull()))
    by_trees = F.when(F.col("blocked") >= threshold, "block").otherwise("allow")
    return model.block_probability(urls).select(F.col("id").alias(id_col), "host", "path", "rule", "blocked", F.coalesce("verdict", by_trees).alias("verdict"))
