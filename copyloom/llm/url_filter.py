"""URL verdicts: rules on hosts and paths, and a logistic regression for the rest.

Only DataFrame functions and Spark's own estimators. The model sees hashed
character n-grams of host and path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import ascii_lower, share, stored

#: Hash buckets of the n-grams, and their lengths.
FEATURES = 1 << 12
GRAMS = (2, 3, 4)
#: Rules are one expression per row; there can be so many.
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """`where`: host and path, like `example.net/en/`; it holds for subdomains and longer paths."""

    where: str
    verdict: str  # allow or block


def host(url: Column) -> Column:
    """Behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return ascii_lower(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0))


def path(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as `rule, verdict`; null if none does.

    Of equally long ones, the one that comes first in the list.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; there can be {MOST_RULES}")
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.where)):
        name, slash, rest = rule.where.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule.where).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value).otherwise(chosen)
    return chosen


def _grams(host: Column, path: Column) -> Column:
    """All n-grams of `^host$path$`: the ends count, and host and path share no n-gram."""
    text = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$"))
    every = [
        F.transform(
            F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i, n=n: F.substring(text, i, F.lit(n)),
        )
        for n in GRAMS
    ]
    return F.concat(*every)


def _features(urls: DataFrame) -> DataFrame:
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES)
    return hashing.transform(urls.withColumn("_grams", _grams(F.col("_host"), F.col("_path"))))


def fit(labelled: DataFrame, rounds: int = 25) -> LogisticRegressionModel | float:
    """`url, verdict` (allow or block), a small table → a model of `block`.

    Other verdicts and null don't count. If only one verdict occurs, its
    probability (0 or 1) is the model; without rows it is 0.
    """
    known = labelled.where("verdict in ('allow', 'block')").select(
        host(F.col("url")).alias("_host"),
        path(F.col("url")).alias("_path"),
        (F.col("verdict") == "block").cast("double").alias("label"),
    )
    known = stored(known, "labelled-urls")
    kinds = known.agg(F.min("label"), F.max("label")).first()
    if kinds[0] == kinds[1]:
        return kinds[0] or 0.0
    return LogisticRegression(
        featuresCol="_features", labelCol="label", maxIter=rounds, regParam=0.01
    ).fit(_features(known))


def judged(pages: DataFrame, rules: list[Rule], model: LogisticRegressionModel | float) -> DataFrame:
    """`page_id, url` → `page_id, host, path, rule, verdict, block_score`.

    The longest rule decides, and where there is none the model, at 0.5. A null
    url, and one without `://`, has an empty host and path and is judged by the
    model. Every row gives a row; other columns don't matter.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    if isinstance(model, float):
        scored = rows.withColumn("block_score", F.lit(model))
    else:
        scored = model.setProbabilityCol("_p").transform(_features(rows)).withColumn(
            "block_score", vector_to_array("_p")[1]
        )
    by_rule = ruled(F.col("_host"), F.col("_path"), rules)
    by_model = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("_rule", by_rule).select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", by_model).alias("verdict"),
        "block_score",
    )


def labels_from_rules(pages: DataFrame, rules: list[Rule], most: int = 4000) -> DataFrame:
    """Different urls that a rule decides, as a small labelled table; `most` bounds it (about, by hash).

    Each url counts once, however many rows have it.
    """
    urls = pages.select("url").where("url is not null").distinct()
    by_rule = ruled(host(F.col("url")), path(F.col("url")), rules)
    known = urls.select("url", by_rule["verdict"].alias("verdict")).where("verdict is not null")
    count = known.count()
    return known.where(share(3, F.col("url")) < min(1.0, most / max(1, count)))
