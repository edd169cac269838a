"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained in the JVM from a small labelled URL table, and scoring is one native projection.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the model
(empty n-grams, so by its intercept); of several fitting rules the longest wins, and of equal ones the first listed;
repeated rows are judged each; an empty table stays empty; columns named as the results are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden, once, shown, table


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the query's contract, in its notation.
RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))
#: A small labelled table: common words of the names of unwanted and of plain sites (fixed values, general English).
UNWANTED = (
    "casino poker jackpot betting slots roulette lottery bonus winner prize free cheap discount deals coupon outlet replica pills pharmacy viagra cialis "
    "tablets diet slimming detox miracle adult webcam escort dating hookup singles payday loan loans credit debt refinance mortgage quick cash earn money "
    "crypto doubler giveaway followers likes traffic backlinks seo clicks torrent crack keygen warez nulled serial download toolbar ringtones horoscope spam "
    "farm ads popunder redirect parked domains expired rolex handbags"
).split()
PLAIN = (
    "news daily times journal review library archive museum gallery theatre university college school academy institute research science physics biology "
    "history geography language weather climate garden kitchen recipes cooking bakery travel railway airport harbour council city village county parliament "
    "health hospital clinic dental sport football cricket cycling running music concert radio festival river mountain forest coast national park wildlife "
    "software docs developer python database network hardware forum wiki blog photo studio design architecture engineering energy transport community "
    "charity church market bookshop publishing press"
).split()
PATHS = ("/", "/about", "/en/index.html", "/news/2021/03/story", "/item/825", "/de/77.html", "/p?id=3", "/contact", "/a/b/c", "/es/5/")


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return host, path


def ngrams(host: Column, path: Column, sizes=(2, 3, 4)) -> Column:
    """Character n-grams, marked by part."""
    grams = lambda s, n, mark: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.concat(F.lit(mark), s.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    host = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*[grams(host, n, "h") for n in sizes], *[grams(path, n, "p") for n in sizes])


def labelled_urls(spark: SparkSession, fold: int | None = None, held_out: bool = False) -> DataFrame:
    """host, path, label (1: unwanted): names of one and two words under a few domains and paths, a bounded table of some
    thousand rows. ``fold`` (0 to 4) leaves out every fifth name, or gives only these."""
    rows = []
    for label, names in ((1, UNWANTED), (0, PLAIN)):
        for i, name in enumerate(names):
            pairs = [name, *(name + mark + names[(7 * i + 11 * j) % len(names)] for j, mark in enumerate(("-", "", "-", "") * 3))]
            rows += [(f"{'www.' * ((i + j) % 2)}{x}.{'com org net info co.uk'.split()[(i + j) % 5]}", PATHS[(3 * i + j) % len(PATHS)], float(label)) for j, x in enumerate([*pairs, f"{name}.example"])]
    rows = [r for i, r in enumerate(rows) if fold is None or (i % 5 == fold) == held_out] + [("", "", 0.0)] * (not held_out)
    return spark.createDataFrame(rows, "host string, path string, label double")


_MODELS: dict = {}


def train(spark: SparkSession, features: int = 1 << 13, fold: int | None = None):
    """The fitted (hashing, logistic regression) pipeline, once a session."""
    key = (spark.sparkContext.applicationId, features, fold)
    if key not in _MODELS:
        _MODELS[key] = _train(labelled_urls(spark, fold), features)
    return _MODELS[key]


def _train(urls: DataFrame, features: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    data = urls.select(ngrams(F.col("host"), F.col("path")).alias("grams"), "label").coalesce(1)
    stages = [HashingTF(inputCol="grams", outputCol="__features", numFeatures=features, binary=True), LogisticRegression(featuresCol="__features", regParam=0.02, maxIter=60, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction")]
    return Pipeline(stages=stages).fit(data)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (text, verdict), or null."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("text"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<text:string,verdict:string>")


def url_filter(pages: DataFrame, url: str = "url", rules=RULES, block_from: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, score (the model's probability of an unwanted URL) and verdict."""
    from pyspark.ml.functions import vector_to_array

    rows, names = hidden(pages)
    host, path = host_path(F.col(names[url]).cast("string"))
    named = once(rows, "u", F.struct(host.alias("host"), path.alias("path"))).select(*names.values(), F.col("u.host").alias("host"), F.col("u.path").alias("path"))
    scored = train(pages.sparkSession).transform(named.withColumn("grams", ngrams(F.col("host"), F.col("path"))))
    found = scored.select(*names.values(), "host", "path", rule_column(F.col("host"), F.col("path"), rules).alias("r"), vector_to_array("__probability")[1].alias("score"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= block_from, F.lit("block")).otherwise(F.lit("allow")))
    return found.select(*shown(names, "host", "path", "rule", "verdict", "score"), "host", "path", F.col("r.text").alias("rule"), verdict.alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
