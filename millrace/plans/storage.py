"""Scans, sources, sinks and incremental loading."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog.tables import Insert, MEMORY, TableCatalog, temporary_database
from millrace.plans.registry import Registry, table
from millrace.scratch import materialize, new_dir, new_name
from millrace.sources import scans, sinks, text_formats, text_source
from millrace.streaming import incremental

R = Registry()
query = R.query


def totals(df, *groups):
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


BY_STATUS = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders{where} GROUP BY o_orderstatus"


@query("scan_project", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity = 50")
def scan_project(spark, sf):
    return scans.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_discount"], "l_quantity = 50")


@query("scan_filter_pushdown", """
    SELECT l_orderkey, l_extendedprice FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-02-01' AND l_returnflag = 'R'""")
def scan_filter_pushdown(spark, sf):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    inside = (F.col("l_shipdate") >= day("1998-01-01")) & (F.col("l_shipdate") < day("1998-02-01"))
    return scans.scan(
        spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_extendedprice"], inside & (F.col("l_returnflag") == "R")
    )


@query("scan_partitioned", """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders WHERE year(o_orderdate) IN (1996, 1999) GROUP BY 1""")
def scan_partitioned(spark, sf):
    path = new_dir(spark, "orders_by_year")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    o.write.partitionBy("y").parquet(path)
    back = scans.scan(spark, path, predicate=F.col("y").isin(1996, 1999), schema=o.schema)
    return totals(back, F.col("y").cast("bigint").alias("y"))


@query("scan_schema_merge", """
    SELECT count(*) AS n, sum(CAST(o_custkey AS BIGINT))::BIGINT AS keys, count(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS n_priority,
           round(sum(o_totalprice), 2) AS total FROM orders""")
def scan_schema_merge(spark, sf):
    o = table(spark, sf, "orders")
    old, new = new_dir(spark, "old_schema"), new_dir(spark, "new_schema")
    # The old partition has text keys and no priority column, the new one short keys and more columns.
    o.where("o_orderstatus <> 'F'").selectExpr("CAST(o_custkey AS STRING) AS o_custkey", "o_totalprice").write.parquet(old)
    o.where("o_orderstatus = 'F'").selectExpr(
        "o_orderpriority", "CAST(o_custkey AS INT) AS o_custkey", "o_totalprice", "o_orderkey"
    ).write.parquet(new)
    merged = scans.merge_partitions(
        [spark.read.parquet(old), spark.read.parquet(new)],
        "o_custkey bigint, o_totalprice double, o_orderpriority string",
    )
    return merged.agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"), F.count("o_orderpriority").alias("n_priority"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("scan_empty", """
    SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus""")
def scan_empty(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    missing = scans.scan_or_empty(spark, new_dir(spark, "never_written"), o.schema)
    return o.union(missing).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("source_delimited_nested", """
    SELECT c_mktsegment AS segment, count(*) AS n, sum(length(c_name))::BIGINT AS chars,
           count(CASE WHEN c_nationkey <> 0 THEN 1 END) AS n_nation, round(sum(c_acctbal), 2) AS bal
    FROM customer GROUP BY c_mktsegment""")
def source_delimited_nested(spark, sf):
    path = new_dir(spark, "customer_text")
    schema = "c_custkey bigint, parts array<string>, attrs map<string,array<string>>, c_acctbal double"
    c = table(spark, sf, "customer").select(
        "c_custkey", F.split("c_name", "#").alias("parts"),
        F.create_map(
            F.lit("segment"), F.array("c_mktsegment"),
            F.lit("nation"), F.array(F.nullif(F.col("c_nationkey").cast("string"), F.lit("0"))),
        ).alias("attrs"),
        "c_acctbal",
    )
    text_formats.render_delimited(c).write.text(path)
    back = text_formats.parse_delimited(spark.read.text(path), schema)
    item = lambda k: F.get(F.try_element_at("attrs", F.lit(k)), F.lit(0))
    return back.groupBy(item("segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length(F.array_join("parts", "#"))).alias("chars"),
        F.count(item("nation")).alias("n_nation"),
        F.round(F.sum("c_acctbal"), 2).alias("bal"),
    )


@query("source_regex", """
    SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT NULL, NULL FROM orders WHERE o_orderstatus <> 'P'""")
def source_regex(spark, sf):
    path = new_dir(spark, "order_lines")
    o = table(spark, sf, "orders")
    good = F.concat_ws("|", "o_orderkey", "o_orderpriority")
    o.select(F.when(F.col("o_orderstatus") == "P", good).otherwise("no match").alias("value")).write.text(path)
    return text_formats.parse_regex(spark.read.text(path), r"(\d+)\|(.+)", ["k", "p"])


@query("source_registered_format", """
    SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS price FROM orders
    WHERE o_orderkey BETWEEN 100 AND 40000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def source_registered_format(spark, sf):
    path = new_dir(spark, "order_text")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.array("o_orderstatus").alias("tags"))
    text_formats.render_delimited(o).write.text(path)
    text_source.register(spark)
    columns = "o_orderkey bigint, o_orderpriority string, o_totalprice double, tags array<string>"
    back = spark.read.format("delimited_text").schema(columns).options(
        path=path, split_bytes=str(1 << 20), columns="o_orderkey,o_orderpriority,o_totalprice").load()
    # The reader gets both filters and parses the prices of the lines that pass.
    kept = back.where("o_orderkey BETWEEN 100 AND 40000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
    return kept.select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"))


@query("create_text_table", """
    SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS nations,
           count(CASE WHEN c_nationkey % 5 = 0 THEN 1 END) AS fifth
    FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment""")
def create_text_table(spark, sf):
    plain, matched = new_dir(spark, "customer_lines"), new_dir(spark, "customer_pattern")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    c.select(F.concat_ws("|", *c.columns).alias("value")).write.text(plain)
    c.select(F.concat_ws(" ", F.lit("key"), "c_custkey", F.lit("nation"), "c_nationkey").alias("value")).write.text(matched)
    one, two = new_name("customers"), new_name("nations")
    text_source.create_text_table(spark, one, "k bigint, segment string, nation int", plain, field="|")
    text_source.create_text_table(spark, two, "k string, nation string", matched, "regex_text", pattern=r"key (\d+) nation (\d*[05])")
    joined = spark.sql(f"""
        SELECT a.segment, count(*) AS n, sum(a.nation) AS nations, count(b.k) AS fifth
        FROM {one} a LEFT JOIN {two} b ON a.k = CAST(b.k AS BIGINT) WHERE a.segment <> 'BUILDING' GROUP BY a.segment""")
    for name in (one, two):
        spark.catalog.dropTempView(name)
    return joined


@query("source_orc_roundtrip", """
    SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem
    WHERE l_quantity > 25 GROUP BY l_returnflag""")
def source_orc_roundtrip(spark, sf):
    path = new_dir(spark, "lineitem_orc")
    sinks.write_directory(table(spark, sf, "lineitem"), path, "orc")
    back = scans.scan(spark, path, ["l_returnflag", "l_extendedprice"], "l_quantity > 25", format="orc")
    return back.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


@query("sink_directory", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 250000")
def sink_directory(spark, sf):
    path = new_dir(spark, "directory")
    rows = table(spark, sf, "orders").where("o_totalprice > 250000").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.write_directory(rows, path, "csv", header="true")
    sinks.write_directory(rows, path, "csv", header="true")  # a second run replaces the first
    return scans.scan(spark, path, format="csv", schema=rows.schema, header="true")


@query("insert_into_overwrite", BY_STATUS.format(where=" WHERE o_orderstatus <> 'F'"))
def insert_into_overwrite(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    part = lambda s: o.where(F.col("o_orderstatus") == s)
    with temporary_database(spark) as db:
        catalog, name = TableCatalog(spark), f"{db}.t"
        catalog.create(name, part("F"))
        catalog.insert(name, part("O"))
        catalog.overwrite(name, spark.table(name).where("o_orderstatus = 'O'"))  # from the table itself
        catalog.insert(name, part("P"))
        return materialize(totals(spark.table(name), "o_orderstatus"))


def _partitioned(spark, catalog, name, o):
    catalog.create(name, o, partition_by=["o_orderstatus"])


@query("insert_static_partition", """
    SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM
      (SELECT o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'
       UNION ALL SELECT 'F', o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
       UNION ALL SELECT 'X', o_totalprice FROM orders WHERE o_orderpriority = '5-LOW') t
    GROUP BY o_orderstatus""")
def insert_static_partition(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    data = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    with temporary_database(spark) as db:
        catalog, name = TableCatalog(spark), f"{db}.t"
        _partitioned(spark, catalog, name, o)
        catalog.insert_partition(name, o.where("o_orderpriority = '1-URGENT'").select(*data), True, o_orderstatus="F")
        catalog.insert_partition(name, o.where("o_orderpriority = '5-LOW'").select(*data), False, o_orderstatus="X")
        return materialize(totals(spark.table(name), "o_orderstatus"))


@query("insert_dynamic_partition", """
    SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM
      (SELECT o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'
       UNION ALL SELECT o_orderstatus, o_totalprice * 2 FROM orders WHERE o_orderstatus <> 'P') t
    GROUP BY o_orderstatus""")
def insert_dynamic_partition(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    with temporary_database(spark) as db:
        catalog, name = TableCatalog(spark), f"{db}.t"
        _partitioned(spark, catalog, name, o)
        doubled = o.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
        catalog.insert_dynamic(name, doubled, overwrite=True)
        return materialize(totals(spark.table(name), "o_orderstatus"))


@query("multi_insert", """
    SELECT 'returned' AS tgt, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT 'accepted', count(*), round(sum(l_quantity), 2) FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT 'large', count(*), round(sum(l_quantity), 2) FROM lineitem WHERE l_quantity >= 40""")
def multi_insert(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    targets = {"returned": "l_returnflag = 'R'", "accepted": "l_returnflag = 'A'", "large": "l_quantity >= 40"}
    with temporary_database(spark) as db:
        catalog = TableCatalog(spark)
        for name in targets:
            catalog.create(f"{db}.{name}", l.limit(0))
        catalog.multi_insert(l, {f"{db}.{name}": where for name, where in targets.items()})
        tagged = [
            spark.table(f"{db}.{name}").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
            .select(F.lit(name).alias("tgt"), "n", "qty")
            for name in targets
        ]
        return materialize(tagged[0].union(tagged[1]).union(tagged[2]))


@query("multi_insert_aggregates", """
    SELECT 'by_flag' AS tgt, l_returnflag AS k, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'by_year', CAST(year(l_shipdate) AS VARCHAR), count(*), round(max(l_quantity), 2) FROM lineitem
              WHERE l_quantity > 10 GROUP BY 2
    UNION ALL SELECT 'plain', l_linestatus, 1, l_quantity FROM lineitem WHERE l_quantity >= 49""")
def multi_insert_aggregates(spark, sf):
    l = table(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    with temporary_database(spark) as db:
        catalog = TableCatalog(spark)
        names = ("by_flag", "by_year", "plain")
        for name in names:
            spark.sql(f"CREATE TABLE {db}.{name} (k STRING, n BIGINT, qty DOUBLE) USING parquet")
        catalog.multi_insert(l, {
            f"{db}.by_flag": Insert(columns=("count(*)", "round(sum(l_quantity), 2)"), group_by=("l_returnflag",)),
            f"{db}.by_year": Insert("l_quantity > 10", ("count(*)", "round(max(l_quantity), 2)"), ("cast(year(l_shipdate) as string)",)),
            f"{db}.plain": Insert("l_quantity >= 49", ("l_linestatus", "1L", "l_quantity")),
        })
        parts = [spark.table(f"{db}.{n}").select(F.lit(n).alias("tgt"), "k", "n", "qty") for n in names]
        return materialize(parts[0].union(parts[1]).union(parts[2]))


@query("ctas", BY_STATUS.format(where=" WHERE o_totalprice > 50000"))
def ctas(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 50000")
    with temporary_database(spark) as db:
        spark.sql(f"CREATE TABLE {db}.t USING parquet AS SELECT * FROM {{src}}", src=o)
        return materialize(totals(spark.table(f"{db}.t"), "o_orderstatus"))


@query("load_data", """
    SELECT part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM
      (SELECT 1 AS part, o_totalprice FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT 2, o_totalprice FROM orders WHERE o_orderstatus <> 'F') t GROUP BY part""")
def load_data(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    files = {}
    for s in ("F", "O", "P"):
        files[s] = new_dir(spark, f"load_{s}")
        o.where(F.col("o_orderstatus") == s).write.parquet(files[s])
    with temporary_database(spark) as db:
        name = f"{db}.t"
        spark.sql(f"CREATE TABLE {name} (o_orderkey BIGINT, o_totalprice DOUBLE, part INT) USING parquet PARTITIONED BY (part)")
        sinks.load_data(spark, files["F"], name, partition={"part": 1})
        sinks.load_data(spark, files["O"], name, overwrite=True, partition={"part": 1})
        sinks.load_data(spark, files["O"], name, partition={"part": 2})
        sinks.load_data(spark, files["P"], name, partition={"part": 2})
        return materialize(totals(spark.table(name), "part"))


@query("save_as_table", "SELECT count(*) AS n, sum(k)::BIGINT AS keys, max(name) AS last_name FROM (SELECT c_custkey AS k, c_name AS name FROM customer) t")
def save_as_table(spark, sf):
    with temporary_database(spark) as db:
        rows = table(spark, sf, "customer").select("c_custkey", "c_name")
        if not TableCatalog(spark).save_dataset(rows, f"{db}.people", ["k", "name"]):
            raise RuntimeError("the dataset was not saved")
        return materialize(spark.table(f"{db}.people").agg(
            F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"), F.max("name").alias("last_name")
        ))


@query("export_import", """
    SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_orderstatus = 'O' GROUP BY o_orderpriority""")
def export_import(spark, sf):
    path = new_dir(spark, "export")
    sinks.export_table(table(spark, sf, "orders"), path, ["o_orderstatus"])
    with temporary_database(spark) as db:
        TableCatalog(spark).create(f"{db}.imported", sinks.import_table(spark, path, o_orderstatus="O"))
        return materialize(totals(spark.table(f"{db}.imported"), "o_orderpriority"))


@query("compact_files", BY_STATUS.format(where=""))
def compact_files(spark, sf):
    small, large = new_dir(spark, "small_files"), new_dir(spark, "large_files")
    table(spark, sf, "orders").repartition(12).write.parquet(small)
    sinks.compact_files(spark, small, large)
    return totals(spark.read.parquet(large), "o_orderstatus")


@query("incremental_load", """
    SELECT 1 AS run, count(*) AS n_new, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_after
    FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 2, count(*), (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 3, 0, count(*) FROM orders WHERE o_orderstatus <> 'P'""")
def incremental_load(spark, sf):
    source, target, check = (new_dir(spark, d) for d in ("incoming", "loaded", "progress"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    counts = []
    for run, status in ((1, "F"), (2, "O"), (3, None)):
        if status:
            o.where(F.col("o_orderstatus") == status).write.mode("append").parquet(source)
        new = incremental.load_new_files(spark, source, o.schema, target, check)
        counts.append((run, new, spark.read.schema(o.schema).parquet(target).count()))
    return spark.createDataFrame(counts, "run int, n_new bigint, n_after bigint")


@query("incremental_table", """
    SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, 4 AS loads FROM orders GROUP BY o_orderstatus""")
def incremental_table(spark, sf):
    """Four files in four batches into a cached, partitioned table. The second batch is
    cut off between write and commit, one is repeated, and a run without news adds none."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    source, checkpoint = new_dir(spark, "arriving"), new_dir(spark, "loads-checkpoint")

    def arrive(part):
        o.where(F.pmod("o_orderkey", F.lit(4)) == part).coalesce(1).write.mode("append").parquet(source)

    with temporary_database(spark) as db:
        loads = incremental.TableLoads(spark, f"{db}.loaded", o.schema, new_dir(spark, "loaded"), ["o_orderstatus"])
        spark.sql(f"CACHE TABLE {db}.loaded")
        arrive(0)
        incremental.load_into_table(spark, source, o.schema, loads, checkpoint)
        arrive(1)

        def cut_off(batch, number):
            loads.write(batch.limit(5), number)
            raise RuntimeError("lost before the commit")

        try:
            incremental.load_into_table(spark, source, o.schema, loads, checkpoint, append=cut_off)
        except StreamingQueryException:
            pass
        for part in (2, 3):
            arrive(part)
        incremental.load_into_table(spark, source, o.schema, loads, checkpoint, max_files=1)
        incremental.load_into_table(spark, source, o.schema, loads, checkpoint)
        loads.append(o, loads.ledger()[0])  # a repeated number changes nothing
        sums = spark.table(f"{db}.loaded").groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        return materialize(sums.withColumn("loads", F.lit(len(loads.ledger()))))


@query("compact_partition", """
    SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS fewer FROM orders GROUP BY o_orderstatus""")
def compact_partition(spark, sf):
    """A partition of many small files is merged in place; a table without partitions, too."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    with temporary_database(spark) as db:
        files = max(12, o.count() // 50_000)  # small beside the megabyte they are merged to, however large the table
        o.repartition(files).write.partitionBy("o_orderstatus").saveAsTable(f"{db}.many")
        done = [sinks.compact_partition(spark, f"{db}.many", {"o_orderstatus": s}, 1 << 20) for s in ("F", "O")]
        for one in done:
            one.remove_old()
        sums = spark.table(f"{db}.many").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        return materialize(sums.withColumn("fewer", F.lit(all(d.after < d.before for d in done))))
