"""URL filter: a list of host and path rules, and for other URLs a logistic regression on hashed character n-grams.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: what follows it up to
``?``, ``#`` or the end. Without ``://`` both are empty. A rule is a host and a path joined; it fits its host and all
subdomains when the URL's path starts with the rule's. The longest fitting rule decides.

The classifier's features are the different n-grams of three to five characters of host and path between edge marks,
hashed to ``FEATURES`` places. It learns from a small table of labelled URLs, ``SAMPLE`` at most, by Spark's own
logistic regression; the model's size is fixed. Rules and model are small and travel with the plan, so
a page is judged where it is read, without a shuffle, however often its host occurs.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is judged by the method on
the edge marks alone; without labelled URLs the method allows everything; every row is judged by itself.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import LOWER, UPPER
from wakeline.session import stage

ALLOW, BLOCK = "allow", "block"
RULES = {"net/": BLOCK, "example.net/en/": ALLOW, "example.com/de/": BLOCK, "org/fr/": ALLOW}
GRAMS = (3, 4, 5)
FEATURES = 1 << 14
SAMPLE = 2000


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, with its verdict; null if there is none."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    parts = [(r[: r.index("/")], r[r.index("/") :], r, v) for r, v in sorted(rules.items(), key=lambda x: (-len(x[0]), x[0]))]
    names = ("host", "path", "rule", "verdict")
    listed = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(p, names)]) for p in parts])
    fits = F.filter(
        listed,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    return F.get(F.transform(fits, lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))), 0)


def grams(host: Column, path: Column) -> Column:
    whole = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    size = F.char_length(whole)
    parts = [
        F.transform(
            F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>")),
            lambda i, n=n: F.substring(whole, i, F.lit(n)),
        )
        for n in GRAMS
    ]
    return F.array_distinct(F.concat(*parts))


def _features(urls: DataFrame) -> DataFrame:
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    return hashing.transform(urls.withColumn("_grams", grams(F.col("_host"), F.col("_path"))))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> LogisticRegressionModel | None:
    """Fit on a small table of URLs labelled allow or block, at most ``SAMPLE`` different ones: those of smallest hash."""
    host, path = host_and_path(F.col(url_col))
    rows = labelled.where(F.col(label_col).isin(ALLOW, BLOCK) & F.col(url_col).isNotNull())
    rows = rows.select(F.col(url_col).alias("_url"), host.alias("_host"), path.alias("_path"), F.col(label_col).alias("_label"))
    rows = rows.groupBy("_url", "_host", "_path").agg(F.max("_label").alias("_label"))
    sample = stage(rows.orderBy(F.xxhash64("_url"), "_url").limit(SAMPLE), "labelled-urls")
    if sample.isEmpty():
        return None
    known = _features(sample).withColumn("_y", (F.col("_label") == BLOCK).cast("double"))
    return LogisticRegression(featuresCol="_features", labelCol="_y", regParam=0.01, maxIter=50).fit(known.coalesce(1))


def judge(pages: DataFrame, model: LogisticRegressionModel | None, rules: dict[str, str], url_col: str = "url") -> DataFrame:
    """The columns of ``pages`` with host, path, rule, verdict and score (the method's probability of block)."""
    host, path = host_and_path(F.col(url_col))
    own = F.struct(*[F.col(c) for c in pages.columns])
    rows = pages.select(own.alias("_row"), host.alias("_host"), path.alias("_path"))
    rows = rows.withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
    if model is None:
        rows = rows.withColumn("_score", F.lit(0.0))
    else:
        rows = model.setProbabilityCol("_p").setPredictionCol("").setRawPredictionCol("_r").transform(_features(rows))
        rows = rows.withColumn("_score", vector_to_array("_p")[1])
    method = F.when(F.col("_score") >= 0.5, BLOCK).otherwise(ALLOW)
    verdict = F.coalesce(F.col("_rule.verdict"), method)
    kept = [F.col("_row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    return rows.select(
        *kept,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        verdict.alias("verdict"),
        F.col("_score").alias("score"),
    )
