"""Row-generating functions and lateral views."""

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.plans.functions import URL_SQL
from millrace.plans.registry import Registry, table
from millrace.sources.scans import spread_small

R = Registry()
query = R.query


@query("udtf_explode", """
    SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_type <> 'PROMO'""")
def udtf_explode(spark, sf):
    words = F.when(F.col("p_type") != "PROMO", F.split("p_name", " "))  # NULL and empty arrays give no rows
    return table(spark, sf, "part").select("p_partkey", F.explode(words).alias("word"))


@query("lateral_view", """
    SELECT lang, word, count(*) AS n FROM
      (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) t
    WHERE length(word) > 8 GROUP BY lang, word""")
def lateral_view(spark, sf):
    return spark.sql(r"""
        SELECT lang, word, count(*) AS n FROM {docs} LATERAL VIEW explode(split(text, ' ')) w AS word
        WHERE length(word) > 8 GROUP BY lang, word""", docs=spread_small(table(spark, sf, "documents").select("lang", "text")))


@query("lateral_view_chain", """
    SELECT word, ch, count(*) AS n FROM
      (SELECT word, unnest(string_split(word, 'i')) AS ch FROM
         (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) a) b
    GROUP BY word, ch""")
def lateral_view_chain(spark, sf):
    return spark.sql("""
        SELECT word, ch, count(*) AS n FROM {part}
        LATERAL VIEW explode(split(p_name, ' ')) a AS word LATERAL VIEW explode(split(word, 'i')) b AS ch
        GROUP BY word, ch""", part=table(spark, sf, "part"))


@query("udtf_explode_map", """
    SELECT c_custkey, 'segment' AS k, c_mktsegment AS v FROM customer
    UNION ALL SELECT c_custkey, 'name', c_name FROM customer""")
def udtf_explode_map(spark, sf):
    m = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name")
    return table(spark, sf, "customer").select("c_custkey", F.explode(m).alias("k", "v"))


@query("udtf_inline", """
    SELECT c_custkey, 'bal' AS what, c_acctbal AS amount FROM customer
    UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer""")
def udtf_inline(spark, sf):
    rows = F.array(
        F.struct(F.lit("bal").alias("what"), F.col("c_acctbal").alias("amount")),
        F.struct(F.lit("nation").alias("what"), F.col("c_nationkey").cast("double").alias("amount")),
    )
    return table(spark, sf, "customer").select("c_custkey", F.inline(rows))


@query("udtf_stack", """
    SELECT c_custkey, 'seg' AS k, c_mktsegment AS v FROM customer
    UNION ALL SELECT c_custkey, 'nat', CAST(c_nationkey AS VARCHAR) FROM customer
    UNION ALL SELECT c_custkey, 'len', CAST(length(c_name) AS VARCHAR) FROM customer""")
def udtf_stack(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "stack(3, 'seg', c_mktsegment, 'nat', cast(c_nationkey as string), 'len', cast(length(c_name) as string)) AS (k, v)",
    )


@query("udtf_json_tuple", "SELECT event_id, props->>'k' AS k, props->>'other' AS other FROM events")
def udtf_json_tuple(spark, sf):
    return table(spark, sf, "events").select("event_id", F.json_tuple("props", "k", "other").alias("k", "other"))


@query("udtf_parse_url_tuple", "SELECT page_id, " + URL_SQL.format(p="c0", h="c1", a="c2", q="c3", r="c4", g="c5") + " FROM pages")
def udtf_parse_url_tuple(spark, sf):
    parts = text.url_tuple(F.col("url"), "PROTOCOL", "HOST", "PATH", "QUERY", "REF", "QUERY:page")
    return table(spark, sf, "pages").select("page_id", *parts)
