"""URL filter: suffix rules first, then a logistic regression on hashed character n-grams.

All work is DataFrame operations. The model is trained with Spark's own logistic
regression on a small labelled table of URLs (``SEED_URLS`` unless another one
is given); its weights, one number per hash bucket (4,096 by default, a
parameter and so a bound), become an array literal that scores each URL inside
the scan. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, packed

# (verdict, rule): fixed values of the query's contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BUCKETS = 4096
SIZES = (3, 4, 5)  # lengths of the n-grams
MAX_LABELLED = 20_000  # bound of the labelled sample that a model is fitted on

# The small labelled table: 1 = block. Host labels are enough; paths vary to keep them neutral.
BAD_NAMES = (
    "best-casino", "casino-slots", "online-casino", "sports-bets", "bets-now", "lucky-slots",
    "jackpot-win", "win-prizes", "pills-online", "cheap-meds", "meds-discount", "viagra-shop",
    "link-farm", "content-farm", "click-farm", "ad-tracker", "track-clicks", "popup-ads",
    "ads-server", "free-money", "quick-loans", "payday-loans", "cheap-loans", "xxx-videos", "adult-cams", "hot-cams",
    "crypto-doubler", "free-crypto", "replica-watches", "cheap-replica", "free-gift-cards", "free-download-crack",
    "warez-keys", "hacked-keygen", "seo-backlinks",
)
GOOD_NAMES = (
    "news", "weather", "library", "museum", "university", "school", "garden", "recipes", "travel", "history",
    "science", "physics", "chemistry", "biology", "maths", "music", "theatre", "cinema", "books", "poetry",
    "sports", "football", "cycling", "hiking", "photography", "painting", "health", "hospital", "council", "parliament",
    "docs", "wiki", "forum", "archive", "journal", "gazette",
    "open-data", "city-council", "world-news", "local-history", "public-library", "science-daily",
)
SUBDOMAINS = ("", "www.", "blog.", "m.")
PATHS = ("/en/12", "/de/407/", "/fr/88.html", "/es/951", "/en/300", "/")
DOMAINS = ("example.com", "example.org", "example.net")


def seed_urls(spark: SparkSession) -> DataFrame:
    """The labelled table (url, label): every name with each subdomain, and
    paths and domains dealt alike to both classes, so that only names differ."""
    names = [(n, 1) for n in BAD_NAMES] + [(n, 0) for n in GOOD_NAMES]
    rows = []
    for i, (name, label) in enumerate(names):
        for j, sub in enumerate(SUBDOMAINS):
            path, domain = PATHS[(i + j) % len(PATHS)], DOMAINS[(i // 2 + j) % len(DOMAINS)]
            rows.append(f"('https://{sub}{name}.{domain}{path}', {label})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, label)")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased;
    empty if the URL is NULL or has none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else NULLs. Equally long
    rules are tried in the order given."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def grams(host: Column, path: Column, sizes: Sequence[int] = SIZES) -> Column:
    """The distinct character n-grams of host and path, each marked with its part."""

    def cut(mark: str, text: Column, n: int):
        return lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))

    parts = []
    for mark, text in (("h:", F.concat(F.lit("^"), host, F.lit("$"))), ("p:", path)):
        for n in sizes:
            starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(
                F.array().cast("array<int>")
            )
            parts.append(F.transform(starts, cut(mark, text, n)))
    return F.array_distinct(F.concat(*parts))


def fit(
    labelled: DataFrame, buckets: int = BUCKETS, sizes: Sequence[int] = SIZES, reg: float = 0.01, max_rows: int = MAX_LABELLED
):
    """Hashing and logistic regression, fitted on (url, label) rows.

    At most ``max_rows`` rows are used, those with the smallest hash of their
    URL. Rows without a label are left out. One class alone gives a constant; no
    labelled row at all is an error.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    rows = labelled.where("label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    train = rows.select(
        F.col("label").cast("double").alias("label"),
        grams(host_of(F.col("url")), path_of(F.col("url")), sizes).alias("_grams"),
    ).cache()
    try:
        if not train.limit(1).count():
            raise ValueError("no labelled URLs")
        hashing = HashingTF(numFeatures=buckets, binary=True, inputCol="_grams", outputCol="_features")
        model = LogisticRegression(
            featuresCol="_features", labelCol="label", probabilityCol="_chance", rawPredictionCol="_raw",
            predictionCol="_class", regParam=reg, maxIter=50, standardization=False,
        ).fit(hashing.transform(train))
    finally:
        train.unpersist()
    return PipelineModel([hashing, model])


def judge_urls(
    pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES,
    url_column: str = "url", threshold: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict.

    The longest fitting rule decides, on its host and all subdomains; without
    one the model blocks from ``threshold`` on. NULL URLs and URLs without
    ``://`` have an empty host and path, and the model judges those. Rows that
    repeat stay repeated; columns of the same names are replaced. No rows give
    no rows.
    """
    from pyspark.ml.functions import vector_to_array

    model = fit(seed_urls(pages.sparkSession) if labelled is None else labelled)
    host, path = host_of(F.col(f"`{url_column}`")), path_of(F.col(f"`{url_column}`"))
    parts = packed(pages, leave_out=("host", "path", "rule", "score", "verdict"), host=host, path=path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), verdict.alias("ruled"), grams(F.col("host"), F.col("path")).alias("_grams"))
    judged = model.transform(judged).withColumn("score", F.element_at(vector_to_array("_chance"), -1))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select("own.*", "host", "path", "rule", "score", F.coalesce("ruled", by_model).alias("verdict"))
