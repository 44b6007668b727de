"""Cached tables, partitions, databases and catalog commands."""

from pyspark.sql import functions as F

from millrace.catalog.tables import MEMORY, MEMORY_ONLY, TableCatalog, temporary_database
from millrace.plans.registry import Registry, table
from millrace.scratch import materialize, new_dir, new_name

R = Registry()
query = R.query

COUNTS = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {source} GROUP BY o_orderstatus"
ALL_ORDERS = COUNTS.format(source="orders")


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


def _totals(df, *groups):
    return df.groupBy(*(groups or ("o_orderstatus",))).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def _expect(condition, message):
    if not condition:
        raise RuntimeError(message)


@query("cached_ctas", ALL_ORDERS)
def cached_ctas(spark, sf):
    with temporary_database(spark) as db:
        catalog = TableCatalog(spark, cached_suffix=True)
        catalog.create(f"{db}.by_property", _orders(spark, sf), cache="true")
        catalog.create(f"{db}.orders_cached", _orders(spark, sf))
        _expect(catalog.is_cached(f"{db}.by_property") and catalog.is_cached(f"{db}.ORDERS_cached"), "not cached")
        return materialize(_totals(spark.table(f"{db}.orders_cached")))


@query("cache_uncache", ALL_ORDERS)
def cache_uncache(spark, sf):
    with temporary_database(spark) as db:
        catalog, name = TableCatalog(spark), f"{db}.t"
        catalog.create(name, _orders(spark, sf))
        catalog.cache(name)
        _expect(catalog.is_cached(name) and catalog.mode(name) == MEMORY, "not cached")
        catalog.uncache(name)
        _expect(not catalog.is_cached(name), "still cached")
        return materialize(_totals(spark.table(name)))


@query("cache_modes", """
    SELECT 'MEMORY' AS mode, count(*) AS n FROM orders UNION ALL SELECT 'MEMORY_ONLY', count(*) FROM orders""")
def cache_modes(spark, sf):
    with temporary_database(spark) as db:
        catalog = TableCatalog(spark)
        parts = []
        for mode in (MEMORY, MEMORY_ONLY):
            name = f"{db}.t_{mode}"
            catalog.create(name, _orders(spark, sf), cache=mode)
            parts.append(spark.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(catalog.mode(name)).alias("mode"), "n"))
        return materialize(parts[0].union(parts[1]))


@query("cached_insert_into", """
    SELECT o_orderstatus, 2 * count(*) AS n, round(2 * sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus""")
def cached_insert_into(spark, sf):
    with temporary_database(spark) as db:
        catalog, name = TableCatalog(spark), f"{db}.t"
        catalog.create(name, _orders(spark, sf), cache=MEMORY)
        catalog.insert(name, _orders(spark, sf))
        _expect(catalog.is_cached(name), "fell out of the cache")
        return materialize(_totals(spark.table(name)))


@query("cached_insert_overwrite", COUNTS.format(source="(SELECT * FROM orders WHERE o_totalprice > 200000) t"))
def cached_insert_overwrite(spark, sf):
    with temporary_database(spark) as db:
        catalog, name = TableCatalog(spark), f"{db}.t"
        catalog.create(name, _orders(spark, sf), cache=MEMORY)
        catalog.overwrite(name, spark.table(name).where("o_totalprice > 200000"))
        _expect(catalog.is_cached(name), "fell out of the cache")
        return materialize(_totals(spark.table(name)))


@query("cached_partition_scan", COUNTS.format(source="(SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P')) t"))
def cached_partition_scan(spark, sf):
    with temporary_database(spark) as db:
        catalog, name = TableCatalog(spark), f"{db}.t"
        catalog.create(name, _orders(spark, sf), cache=MEMORY, partition_by=["o_orderstatus"])
        spark.sql(f"ALTER TABLE {name} DROP PARTITION (o_orderstatus = 'F')")
        _expect(catalog.is_cached(name), "fell out of the cache")
        return materialize(_totals(spark.table(name)))


@query("cached_partition_lru", """
    SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END * count(*) AS n,
           o_orderstatus <> 'P' AS cached FROM orders GROUP BY o_orderstatus""")
def cached_partition_lru(spark, sf):
    """Only the partitions in use are held: a cached view names them."""
    with temporary_database(spark) as db:
        name, view = f"{db}.t", new_name("used")
        TableCatalog(spark).create(name, _orders(spark, sf), partition_by=["o_orderstatus"])
        again = _orders(spark, sf).where("o_orderstatus = 'F'").drop("o_orderstatus")
        TableCatalog(spark).insert_partition(name, again, o_orderstatus="F")
        spark.table(name).where("o_orderstatus IN ('F', 'O')").createOrReplaceTempView(view)
        spark.catalog.cacheTable(view)
        try:
            used = spark.table(view).select("o_orderstatus").distinct().withColumn("cached", F.lit(True))
            counts = spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
            held = counts.join(used, "o_orderstatus", "left")
            return materialize(held.withColumn("cached", F.coalesce("cached", F.lit(False))))
        finally:
            spark.catalog.uncacheTable(view)
            spark.catalog.dropTempView(view)


@query("partition_add_drop", """
    SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus""")
def partition_add_drop(spark, sf):
    with temporary_database(spark) as db:
        name = f"{db}.t"
        TableCatalog(spark).create(name, _orders(spark, sf), partition_by=["o_orderstatus"])
        spark.sql(f"ALTER TABLE {name} ADD PARTITION (o_orderstatus = 'X')")
        spark.sql(f"ALTER TABLE {name} DROP PARTITION (o_orderstatus = 'F')")
        _expect(spark.sql(f"SHOW PARTITIONS {name}").count() == 3, "expected partitions O, P and X")
        return materialize(spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))


@query("table_rename_drop", ALL_ORDERS)
def table_rename_drop(spark, sf):
    with temporary_database(spark) as db:
        catalog = TableCatalog(spark)
        catalog.create(f"{db}.old_name", _orders(spark, sf), cache=MEMORY)
        catalog.create(f"{db}.gone", _orders(spark, sf), cache=MEMORY)
        catalog.rename(f"{db}.old_name", f"{db}.new_name")
        catalog.drop(f"{db}.gone")
        names = {t.name for t in spark.catalog.listTables(db) if not t.isTemporary}
        _expect(names == {"new_name"} and catalog.is_cached(f"{db}.new_name"), f"unexpected tables {names}")
        return materialize(_totals(spark.table(f"{db}.new_name")))


@query("cache_reload", """
    SELECT 'a' AS t, count(*) AS n FROM orders UNION ALL SELECT 'b', count(*) FROM customer""")
def cache_reload(spark, sf):
    with temporary_database(spark) as db:
        catalog = TableCatalog(spark)
        catalog.create(f"{db}.a", _orders(spark, sf), cache=MEMORY)
        catalog.create(f"{db}.b", table(spark, sf, "customer"), cache=MEMORY)
        catalog.create(f"{db}.c", _orders(spark, sf))
        for t in ("a", "b"):
            spark.catalog.uncacheTable(f"{db}.{t}")  # as after a restart: property kept, cache empty
        _expect(sorted(catalog.reload(db)) == [f"{db}.a", f"{db}.b"], "wrong tables reloaded")
        count = lambda t: spark.table(f"{db}.{t}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
        return materialize(count("a").union(count("b")))


@query("database_scoped_tables", """
    SELECT 'one' AS db, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'two', count(*) FROM orders WHERE o_orderstatus <> 'F'""")
def database_scoped_tables(spark, sf):
    o = _orders(spark, sf)
    with temporary_database(spark) as one, temporary_database(spark) as two:
        catalog = TableCatalog(spark)
        catalog.create(f"{one}.same_name", o.where("o_orderstatus = 'F'"), cache=MEMORY)
        catalog.create(f"{two}.same_name", o.where("o_orderstatus <> 'F'"), cache=MEMORY)
        count = lambda db, tag: spark.table(f"{db}.same_name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(tag).alias("db"), "n")
        return materialize(count(one, "one").union(count(two, "two")))


@query("create_like", "SELECT o_orderkey AS okey, o_totalprice, o_orderstatus FROM orders")
def create_like(spark, sf):
    with temporary_database(spark) as db:
        catalog = TableCatalog(spark)
        catalog.create(f"{db}.model", _orders(spark, sf), partition_by=["o_orderstatus"])
        spark.sql(f"CREATE TABLE {db}.copy LIKE {db}.model TBLPROPERTIES ('made' = 'like')")
        catalog.insert(f"{db}.copy", spark.table(f"{db}.model"))
        return materialize(spark.table(f"{db}.copy")).withColumnRenamed("o_orderkey", "okey")


@query("show_describe")
def show_describe(spark, sf):
    with temporary_database(spark) as db:
        name = f"{db}.t"
        TableCatalog(spark).create(name, _orders(spark, sf), partition_by=["o_orderstatus"])
        lines = []
        for command in (f"SHOW TABLES IN {db}", f"SHOW PARTITIONS {name}", f"SHOW COLUMNS IN {name}",
                        f"SHOW TBLPROPERTIES {name}", f"SHOW CREATE TABLE {name}", f"DESCRIBE {name}"):
            told = spark.sql(command)
            text = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in told.columns])
            lines.append(told.select(F.lit(" ".join(command.split()[:2])).alias("command"), text.alias("line")))
        out = lines[0]
        for more in lines[1:]:
            out = out.union(more)
        return materialize(out)


@query("show_describe_check", """
    SELECT 'SHOW COLUMNS' AS command, 4 AS n, true AS told UNION ALL SELECT 'SHOW PARTITIONS', (SELECT count(DISTINCT o_orderstatus) FROM orders), true
    UNION ALL SELECT 'SHOW TABLES', 1, true UNION ALL SELECT 'SHOW TBLPROPERTIES', 1, true UNION ALL SELECT 'SHOW CREATE', 1, true""")
def show_describe_check(spark, sf):
    """What the commands must say of a partitioned table with a property."""
    with temporary_database(spark) as db:
        name = f"{db}.t"
        o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
        TableCatalog(spark).create(name, o, partition_by=["o_orderstatus"])
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('owner.team' = 'mills')")
        status = o.select(F.concat(F.lit("o_orderstatus="), "o_orderstatus").alias("p")).distinct()
        shown = spark.sql(f"SHOW PARTITIONS {name}")
        say = lambda command, df, told: df.agg(F.lit(command).alias("command"), F.count(F.lit(1)).alias("n"), F.every(told).alias("told"))
        parts = [
            say("SHOW COLUMNS", spark.sql(f"SHOW COLUMNS IN {name}"), F.col("col_name").isin(o.columns)),
            say("SHOW PARTITIONS", shown.join(F.broadcast(status), shown["partition"] == status["p"], "left"), F.col("p").isNotNull()),  # three states
            say("SHOW TABLES", spark.sql(f"SHOW TABLES IN {db}"), F.col("tableName") == "t"),
            say("SHOW TBLPROPERTIES", spark.sql(f"SHOW TBLPROPERTIES {name}").where("key = 'owner.team'"), F.col("value") == "mills"),
            say("SHOW CREATE", spark.sql(f"SHOW CREATE TABLE {name}"), F.col("createtab_stmt").contains("PARTITIONED BY (o_orderstatus)")),
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.union(more)
        return materialize(out)


@query("truncate_repair", """
    SELECT 'found' AS step, count(*) AS n FROM orders UNION ALL SELECT 'truncated', 0""")
def truncate_repair(spark, sf):
    path = new_dir(spark, "repair")
    with temporary_database(spark) as db:
        o = _orders(spark, sf)
        o.where("o_orderstatus <> 'P'").write.partitionBy("o_orderstatus").parquet(path)
        spark.sql(f"CREATE TABLE {db}.t (o_orderkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING) "
                  f"USING parquet PARTITIONED BY (o_orderstatus) LOCATION '{path}'")
        o.where("o_orderstatus = 'P'").drop("o_orderstatus").write.parquet(f"{path}/o_orderstatus=P")
        spark.sql(f"MSCK REPAIR TABLE {db}.t")
        found = materialize(spark.table(f"{db}.t").agg(F.count(F.lit(1)).alias("n")).select(F.lit("found").alias("step"), "n"))
        TableCatalog(spark).create(f"{db}.u", o)
        spark.sql(f"TRUNCATE TABLE {db}.u")
        gone = materialize(spark.table(f"{db}.u").agg(F.count(F.lit(1)).alias("n")).select(F.lit("truncated").alias("step"), "n"))
        return found.union(gone)
