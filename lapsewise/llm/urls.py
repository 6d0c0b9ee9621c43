"""URL filter: domain rules first, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.common import column, lower_ascii

# Verdict, host and path of the rules.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

# The words that the labelled URLs are built from.
UNWANTED = ["spam", "cheap", "pills", "casino", "poker", "bonus", "viagra", "loans", "adult", "farm", "clicks", "lottery"]
WANTED = ["news", "school", "library", "science", "garden", "history", "music", "travel", "museum", "weather", "recipes", "maps"]
FRONTS = ["www.", "blog.", "m.", ""]
ENDS = ["com", "org", "net"]
PATHS = ["/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}"]

GRAM = 4
BUCKETS = 1 << 16


def labelled_urls() -> list[tuple[str, str, float]]:
    """The small labelled table: (host, path, label), label 1 to block.

    Built by one rule for both labels, so that only the words of the host differ.
    """
    rows = []
    for words, label in ((UNWANTED, 1.0), (WANTED, 0.0)):
        for i, a in enumerate(words):
            for j in range(1, 5):
                b = words[(i + j) % len(words)]
                host = f"{FRONTS[(i + j) % 4]}{a}-{b}.example.{ENDS[(i * j) % 3]}"
                rows.append((host, PATHS[j - 1].format(10 * i + j), label))
    # Unhyphenated hosts are ordinary in either case.
    rows += [(f"{FRONTS[i % 4]}{a}{b}.example.{ENDS[i % 3]}", PATHS[i % 4].format(i), 0.0) for i, (a, b) in enumerate(zip(WANTED, WANTED[5:] + WANTED[:5]))]
    rows += [(f"{FRONTS[i % 4]}{a}{b}.example.{ENDS[i % 3]}", PATHS[i % 4].format(i), 1.0) for i, (a, b) in enumerate(zip(UNWANTED, UNWANTED[5:] + UNWANTED[:5]))]
    syllables = ["th", "tion", "re", "en", "an", "ou", "st", "es"]
    rows += [(f"{FRONTS[(i + j) % 4]}{a}{b}.example.{ENDS[(i * j) % 3]}", PATHS[j % 4].format(i * j), 0.0) for i, a in enumerate(syllables) for j, b in enumerate(syllables)]
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and path up to ``?`` or ``#``.

    A null url, or one without ``://``, has an empty host and an empty path.
    """
    pattern = r"^(?s:.*?)://([^/?#]*+)([^?#]*+)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does.

    ``rules`` is a short curated list; each is one branch of an expression.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]

    def choose(values: list[str]) -> Column:
        chain = reduce(lambda c, x: c.when(x[0], x[1]), zip(fits[1:], values[1:]), F.when(fits[0], values[0]))
        return chain.otherwise(F.lit(None).cast("string"))

    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return choose([h + p for _, h, p in ordered]), choose([v for v, _, _ in ordered])


def grams(host: Column, path: Column, n: int = GRAM) -> Column:
    """Character n-grams of host and path, marked by where they come from.

    Digits are one symbol, as page numbers say nothing about a site.
    """

    def of(text: Column, mark: str) -> Column:
        padded = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]", "0"), F.lit("$"))
        count = F.greatest(F.char_length(padded) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit(mark), F.substr(padded, i, F.lit(n))))

    return F.array_distinct(F.concat(of(host, "h"), of(path, "p")))


@dataclass
class UrlModel:
    hashing: HashingTF
    regression: LogisticRegressionModel

    def score(self, df: DataFrame, host: Column, path: Column) -> DataFrame:
        """Adds ``score``, the probability that the url is unwanted."""
        hashed = self.hashing.transform(df.withColumn("_grams", grams(host, path)))
        scored = self.regression.transform(hashed)
        return scored.withColumn("score", vector_to_array("_p")[1]).drop("_grams", "_features", "_p", "_raw", "_label")


def fit_urls(spark: SparkSession, rows: list[tuple[str, str, float]] | None = None, buckets: int = BUCKETS) -> UrlModel:
    """Logistic regression on hashed n-grams of a small labelled table of URLs."""
    df = spark.createDataFrame(labelled_urls() if rows is None else rows, "host string, path string, label double")
    hashing = HashingTF(numFeatures=buckets, binary=True, inputCol="_grams", outputCol="_features")
    data = hashing.transform(df.coalesce(1).withColumn("_grams", grams(F.col("host"), F.col("path"))))
    fitted = LogisticRegression(
        featuresCol="_features", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_label",
        regParam=0.005, maxIter=100, standardization=False,
    ).fit(data)
    return UrlModel(hashing, fitted)


def judge_urls(
    pages: DataFrame, model: UrlModel, key: str = "page_id", url: str = "url", rules=RULES, threshold: float = 0.5
) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, score``.

    The longest rule that fits decides; else the url is blocked when the model's
    probability reaches ``threshold``. A null or odd url has an empty host and path,
    fits no rule and is judged like any other. Repeated rows each give a row; other
    columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    df = pages.select(column(key).alias("id"), column(url).cast("string").alias("url"))
    df = df.select("id", host.alias("host"), path.alias("path"))
    df = model.score(df, F.col("host"), F.col("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return df.select(
        "id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score",
    )
