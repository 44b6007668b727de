"""Scalar-function queries, each over a whole table."""

from pyspark.sql import functions as F

from millrace.functions import casts, collections, dates, numbers, text
from millrace.plans.registry import Registry, table
from millrace.sources.scans import spread_small

R = Registry()
query = R.query


@query("fn_arithmetic", """
    SELECT o_orderkey, o_custkey + 3 AS plus, o_custkey - o_orderkey AS minus, o_custkey * 2 AS times,
           o_custkey / nullif(d, 0) AS quotient, (0 - o_custkey) // nullif(d, 0) AS whole,
           (0 - o_custkey) % nullif(d, 0) AS rest, ((0 - o_custkey) % nullif(d, 0) + d) % nullif(d, 0) AS pmod,
           -o_totalprice AS negated, +o_totalprice AS same
    FROM (SELECT *, CAST(length(o_orderpriority) - 5 AS BIGINT) AS d FROM orders) t""")
def fn_arithmetic(spark, sf):
    d = (F.length("o_orderpriority") - 5).cast("bigint")
    c, k, p = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        k, (c + 3).alias("plus"), (c - k).alias("minus"), (c * 2).alias("times"),
        numbers.divide(c, d).alias("quotient"), numbers.int_divide(-c, d).alias("whole"),
        numbers.remainder(-c, d).alias("rest"), numbers.positive_mod(-c, d).alias("pmod"),
        (-p).alias("negated"), F.positive(p).alias("same"),
    )


@query("fn_bitwise", """
    SELECT o_orderkey, o_custkey & o_orderkey AS both_bits, o_custkey | o_orderkey AS any_bits,
           xor(o_custkey, o_orderkey) AS one_bit, ~o_custkey AS flipped FROM orders""")
def fn_bitwise(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k, c.bitwiseAND(k).alias("both_bits"), c.bitwiseOR(k).alias("any_bits"),
        c.bitwiseXOR(k).alias("one_bit"), F.bitwise_not(c).alias("flipped"),
    )


@query("fn_rounding", """
    SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down,
           round(c_acctbal) AS r0, round(c_acctbal, -2) AS r2, CAST(sign(c_acctbal) AS DOUBLE) AS s FROM customer""")
def fn_rounding(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", F.abs(b).alias("a"), F.ceil(b).alias("up"), F.floor(b).alias("down"),
        F.round(b).alias("r0"), F.round(b, -2).alias("r2"), F.sign(b).alias("s"),
    )


@query("fn_exp_log", """
    SELECT l_returnflag, round(sum(exp(l_discount)), 6) AS ex, round(sum(ln(l_quantity)), 6) AS n,
           round(sum(ln(l_quantity) / ln(3)), 6) AS l3, round(sum(log2(l_quantity)), 6) AS l2,
           round(sum(log10(l_quantity)), 6) AS l10, round(sum(pow(l_quantity, 1.5)), 4) AS pw,
           round(sum(sqrt(l_extendedprice)), 4) AS sq, round(max(exp(1.0) + pi()), 9) AS consts,
           count(CASE WHEN l_discount > 0 THEN ln(l_discount) END) AS n_log
    FROM lineitem GROUP BY l_returnflag""")
def fn_exp_log(spark, sf):
    q, s = F.col("l_quantity"), lambda c, d, name: F.round(F.sum(c), d).alias(name)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        s(F.exp("l_discount"), 6, "ex"), s(F.ln(q), 6, "n"), s(F.log(3.0, q), 6, "l3"), s(F.log2(q), 6, "l2"),
        s(F.log10(q), 6, "l10"), s(F.pow(q, F.lit(1.5)), 4, "pw"), s(F.sqrt("l_extendedprice"), 4, "sq"),
        F.round(F.max(F.e() + F.pi()), 9).alias("consts"),
        F.count(numbers.log_or_null(F.col("l_discount"))).alias("n_log"),
    )


@query("fn_trig", """
    SELECT l_orderkey, l_linenumber, l_quantity, round(sin(l_quantity), 9) AS s, round(cos(l_quantity), 9) AS c,
           round(tan(l_discount), 9) AS t, round(asin(l_discount), 9) AS a, round(acos(l_discount), 9) AS b,
           round(atan(l_quantity), 9) AS g, round(degrees(l_discount), 9) AS deg, round(radians(l_quantity), 9) AS rad
    FROM lineitem""")
def fn_trig(spark, sf):
    r = lambda c, name: F.round(c, 9).alias(name)
    q, d = "l_quantity", "l_discount"
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", q, r(F.sin(q), "s"), r(F.cos(q), "c"), r(F.tan(d), "t"), r(F.asin(d), "a"),
        r(F.acos(d), "b"), r(F.atan(q), "g"), r(F.degrees(d), "deg"), r(F.radians(q), "rad"),
    )


@query("fn_radix", """
    SELECT o_orderkey, bin(o_custkey) AS b, hex(o_custkey) AS h, hex(encode(o_orderstatus)) AS hs,
           decode(unhex(hex(encode(o_orderpriority)))) AS back, upper(to_base(o_custkey, 36)) AS b36, o_custkey AS from16
    FROM orders""")
def fn_radix(spark, sf):
    c = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.bin(c).alias("b"), F.hex(c).alias("h"), F.hex("o_orderstatus").alias("hs"),
        F.unhex(F.hex("o_orderpriority")).cast("string").alias("back"),
        F.conv(c.cast("string"), 10, 36).alias("b36"), F.conv(F.hex(c), 16, 10).cast("bigint").alias("from16"),
    )


@query("fn_rand_hash")
def fn_rand_hash(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.rand(7).alias("r"), F.hash("o_orderkey", "o_orderstatus").alias("h")
    )


@query("fn_string_shape", """
    SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, trim(s) AS t, ltrim(s) AS lt, rtrim(s) AS rt,
           lpad(p_type, 9, '*') AS lp, rpad(p_type, 4, '-') AS rp, repeat(' ', 3) || p_type AS sp,
           repeat(p_type, 2) AS rep, reverse(p_name) AS rev
    FROM (SELECT *, '  ' || p_name || ' ' AS s FROM part) t""")
def fn_string_shape(spark, sf):
    s = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return table(spark, sf, "part").select(
        "p_partkey", F.lcase("p_brand").alias("lo"), F.ucase("p_name").alias("up"), F.trim(s).alias("t"),
        F.ltrim(s).alias("lt"), F.rtrim(s).alias("rt"), F.lpad("p_type", 9, "*").alias("lp"),
        F.rpad("p_type", 4, "-").alias("rp"), F.concat(F.call_function("space", F.lit(3)), "p_type").alias("sp"),
        F.repeat("p_type", 2).alias("rep"), F.reverse("p_name").alias("rev"),
    )


@query("fn_string_search", """
    SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS len, CAST(instr(p_name, 'e') AS BIGINT) AS pos,
           CAST(CASE WHEN instr(substr(p_name, 3), 'e') > 0 THEN instr(substr(p_name, 3), 'e') + 2 ELSE 0 END AS BIGINT) AS pos3,
           substr(p_name, 2, 4) AS mid, right(p_name, 3) AS tail,
           CAST(coalesce(list_position(['ECONOMY', 'PROMO', 'LARGE'], p_type), 0) AS BIGINT) AS in_set,
           CAST(ascii(p_name) AS BIGINT) AS code, [p_brand, p_type, p_name][1 + (p_size > 20)::INT] AS chosen,
           CAST(coalesce(list_position(['PROMO', 'SMALL'], p_type), 0) AS BIGINT) AS fld
    FROM part""")
def fn_string_search(spark, sf):
    n = F.col("p_name")
    big = lambda c, name: c.cast("bigint").alias(name)
    return table(spark, sf, "part").select(
        "p_partkey", big(F.length(n), "len"), big(F.instr(n, "e"), "pos"), big(F.locate("e", n, 3), "pos3"),
        F.substring(n, 2, 4).alias("mid"), F.substr(n, F.lit(-3)).alias("tail"),
        big(F.find_in_set("p_type", F.lit("ECONOMY,PROMO,LARGE")), "in_set"), big(F.ascii(n), "code"),
        F.elt(1 + (F.col("p_size") > 20).cast("int"), "p_brand", "p_type", "p_name").alias("chosen"),
        text.field(F.col("p_type"), F.lit("PROMO"), F.lit("SMALL")).alias("fld"),
    )


@query("fn_string_build", """
    SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS joined, x || '!' AS with_null,
           concat_ws('/', o_orderstatus, x, o_orderpriority) AS skipped, translate(o_orderpriority, '-EI', '_ei') AS tr,
           format('{:,.2f}', o_totalprice) AS fn, printf('%05d|%s', o_custkey, o_orderstatus) AS pf
    FROM (SELECT *, nullif(o_orderstatus, 'P') AS x FROM orders) t""")
def fn_string_build(spark, sf):
    x = F.expr("nullif(o_orderstatus, 'P')")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").alias("joined"),
        F.concat(x, F.lit("!")).alias("with_null"), F.concat_ws("/", "o_orderstatus", x, "o_orderpriority").alias("skipped"),
        F.translate("o_orderpriority", "-EI", "_ei").alias("tr"), F.format_number("o_totalprice", 2).alias("fn"),
        F.printf(F.lit("%05d|%s"), "o_custkey", "o_orderstatus").alias("pf"),
    )


@query("fn_regex", """
    SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked,
           string_split(url, '/')[4] AS third, CAST(len(regexp_split_to_array(url, '[/?&.]')) AS BIGINT) AS pieces
    FROM pages""")
def fn_regex(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(u, "^(https?)://([^/]+)", 2).alias("host"),
        F.regexp_replace(u, "[0-9]+", "#").alias("masked"), F.get(F.split(u, "/"), F.lit(3)).alias("third"),
        F.size(F.split(u, "[/?&.]")).cast("bigint").alias("pieces"),
    )


@query("fn_text_split", """
    SELECT p_partkey, p_name || '|' || p_type AS sentences, p_brand AS b, CAST(p_size AS VARCHAR) AS s,
           CAST(NULL AS VARCHAR) AS none FROM part""")
def fn_text_split(spark, sf):
    spoken = F.sentences(F.concat("p_name", F.lit(". "), "p_type"))
    pairs = F.str_to_map(F.concat(F.lit("brand="), "p_brand", F.lit(";size="), F.col("p_size").cast("string")), F.lit(";"), F.lit("="))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.transform(spoken, lambda w: F.array_join(w, " ")), "|").alias("sentences"),
        collections.entry(pairs, F.lit("brand")).alias("b"), collections.entry(pairs, F.lit("size")).alias("s"),
        collections.entry(pairs, F.lit("color")).alias("none"),
    )


URL_SQL = """regexp_extract(url, '^([a-z]+)://', 1) AS {p}, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS {h},
           regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS {a},
           nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS {q}, nullif(regexp_extract(url, '#(.*)$', 1), '') AS {r},
           nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS {g}"""


@query("fn_parse_url", "SELECT page_id, " + URL_SQL.format(p="protocol", h="host", a="path", q="query", r="ref", g="page_no") + " FROM pages")
def fn_parse_url(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", text.url_part(u, "PROTOCOL").alias("protocol"), text.url_part(u, "HOST").alias("host"),
        text.url_part(u, "PATH").alias("path"), text.url_part(u, "QUERY").alias("query"),
        text.url_part(u, "REF").alias("ref"), text.url_part(u, "QUERY:page").alias("page_no"),
    )


@query("fn_json", """
    SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, props->>'missing' AS missing FROM events""")
def fn_json(spark, sf):
    p = F.col("props")
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object(p, "$.k").cast("bigint").alias("k"), F.get_json_object(p, "$.missing").alias("missing")
    )


@query("fn_xpath", """
    SELECT c_custkey, c_name AS xs, c_acctbal AS xd, CAST(c_acctbal AS DOUBLE) > 5000 AS xb,
           CAST(c_nationkey AS BIGINT) AS xi, CAST(c_custkey AS BIGINT) AS xl, CAST(c_nationkey AS BIGINT) AS xh,
           CAST(CAST(c_nationkey AS FLOAT) AS DOUBLE) AS xf, c_mktsegment || '+' || c_name AS xa
    FROM customer""")
def fn_xpath(spark, sf):
    tag = lambda name, col: F.concat(F.lit(f"<{name}>"), F.col(col).cast("string"), F.lit(f"</{name}>"))
    xml = F.concat(F.lit("<c>"), tag("v", "c_mktsegment"), tag("v", "c_name"), tag("b", "c_acctbal"),
                   tag("n", "c_nationkey"), tag("k", "c_custkey"), F.lit("</c>"))
    c = spread_small(table(spark, sf, "customer")).select("c_custkey", xml.alias("x"))
    return c.selectExpr(
        "c_custkey", "xpath_string(x, 'c/v[2]') AS xs", "xpath_double(x, 'c/b') AS xd",
        "xpath_boolean(x, 'c/b > 5000') AS xb", "CAST(xpath_int(x, 'c/n') AS BIGINT) AS xi",
        "xpath_long(x, 'c/k') AS xl", "CAST(xpath_short(x, 'c/n') AS BIGINT) AS xh",
        "CAST(xpath_float(x, 'c/n') AS DOUBLE) AS xf", "array_join(xpath(x, 'c/v/text()'), '+') AS xa",
    )


@query("fn_date_parts", """
    SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d,
           CAST(day(ts) AS BIGINT) AS dom, CAST(week(ts) AS BIGINT) AS w, CAST(hour(ts) AS BIGINT) AS h,
           CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s FROM events""")
def fn_date_parts(spark, sf):
    big = lambda f, name: f("ts").cast("bigint").alias(name)
    return table(spark, sf, "events").select(
        "event_id", big(F.year, "y"), big(F.month, "m"), big(F.day, "d"), big(F.dayofmonth, "dom"),
        big(F.weekofyear, "w"), big(F.hour, "h"), big(F.minute, "mi"), big(F.second, "s"),
    )


@query("fn_date_arith", """
    SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 45 AS VARCHAR) AS later,
           CAST(CAST(o_orderdate AS DATE) - 10 AS VARCHAR) AS earlier,
           CAST(CAST(o_orderdate AS DATE) - DATE '1996-02-29' AS BIGINT) AS days,
           CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders""")
def fn_date_arith(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(d, 45).cast("string").alias("later"), F.date_sub(d, 10).cast("string").alias("earlier"),
        F.datediff(d, F.lit("1996-02-29").cast("date")).cast("bigint").alias("days"), d.cast("string").alias("d"),
    )


@query("fn_epoch", """
    SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, epoch_us(ts) AS us,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS back, strftime(ts, '%Y/%m/%d') AS day FROM events""")
def fn_epoch(spark, sf):
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id", dates.epoch_seconds(F.col("ts")).alias("sec"), dates.epoch_micros(F.col("ts")).alias("us"),
        F.from_unixtime(F.unix_timestamp(shown)).alias("back"),
        F.from_unixtime(F.to_unix_timestamp(shown, F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy/MM/dd").alias("day"),
    )


@query("fn_timestamp", """
    SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hr,
           ts > TIMESTAMP '2024-01-15 12:00:00' AS late, CAST(CAST(ts AS DATE) AS VARCHAR) AS d,
           try_cast(props AS TIMESTAMP) IS NULL AS bad_is_null FROM events""")
def fn_timestamp(spark, sf):
    hour = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:00:00"))
    return table(spark, sf, "events").select(
        "event_id", F.date_format(hour, "yyyy-MM-dd HH:mm:ss").alias("hr"),
        (F.col("ts") > F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))).alias("late"),
        F.col("ts").cast("date").cast("string").alias("d"),
        casts.soft_cast(F.col("props"), "timestamp").isNull().alias("bad_is_null"),
    )


@query("fn_conditional", """
    SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size,
           CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS simple_case,
           CASE WHEN x IS NULL THEN 'none' WHEN o_totalprice < 1000 THEN 'tiny' ELSE x END AS searched,
           coalesce(x, y, '?') AS c, coalesce(x, 'P?') AS n
    FROM (SELECT *, nullif(o_orderstatus, 'P') AS x, nullif(o_orderpriority, '5-LOW') AS y FROM orders) t""")
def fn_conditional(spark, sf):
    o = table(spark, sf, "orders").selectExpr(
        "*", "nullif(o_orderstatus, 'P') AS x", "nullif(o_orderpriority, '5-LOW') AS y"
    )
    return o.selectExpr(
        "o_orderkey", "if(o_totalprice > 250000, 'big', 'small') AS size",
        "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS simple_case",
        "CASE WHEN x IS NULL THEN 'none' WHEN o_totalprice < 1000 THEN 'tiny' ELSE x END AS searched",
        "coalesce(x, y, '?') AS c", "nvl(x, 'P?') AS n",
    )


@query("fn_cast", """
    SELECT c_custkey, try_cast(c_name AS INTEGER) AS bad_int, try_cast(substr(c_name, 10) AS BIGINT) AS good_int,
           CAST(trunc(c_acctbal) AS BIGINT) AS cut, CAST(CAST(c_nationkey AS TINYINT) AS BIGINT) AS tiny,
           CAST(CAST(c_nationkey AS SMALLINT) AS BIGINT) AS small, CAST(CAST(c_nationkey AS FLOAT) AS DOUBLE) AS f,
           CAST(c_nationkey AS DOUBLE) AS dbl, CAST(c_custkey AS VARCHAR) AS txt, c_nationkey <> 0 AS flag,
           hex(encode(c_mktsegment)) AS bin, CAST(NULL AS VARCHAR) AS nothing
    FROM customer""")
def fn_cast(spark, sf):
    n = F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        "c_custkey", casts.soft_cast(F.col("c_name"), "int").alias("bad_int"),
        casts.soft_cast(F.substr("c_name", F.lit(10)), "bigint").alias("good_int"),
        F.col("c_acctbal").cast("bigint").alias("cut"), n.cast("tinyint").cast("bigint").alias("tiny"),
        n.cast("smallint").cast("bigint").alias("small"), n.cast("float").cast("double").alias("f"),
        n.cast("double").alias("dbl"), F.col("c_custkey").cast("string").alias("txt"), n.cast("boolean").alias("flag"),
        F.hex(F.col("c_mktsegment").cast("binary")).alias("bin"), F.lit(None).cast("string").alias("nothing"),
    )


@query("fn_decimal", """
    SELECT o_orderstatus, CAST(sum(d) AS VARCHAR) AS total, CAST(max(d) AS VARCHAR) AS top,
           CAST(min(CAST(d * 2 AS DECIMAL(14, 2))) AS VARCHAR) AS doubled, count(CASE WHEN d > 123456.78 THEN 1 END) AS n
    FROM (SELECT o_orderstatus, CAST(o_totalprice AS DECIMAL(12, 2)) AS d FROM orders) t GROUP BY o_orderstatus""")
def fn_decimal(spark, sf):
    d = F.col("o_totalprice").cast("decimal(12,2)")
    return table(spark, sf, "orders").select("o_orderstatus", d.alias("d")).groupBy("o_orderstatus").agg(
        F.sum("d").cast("string").alias("total"), F.max("d").cast("string").alias("top"),
        F.min((F.col("d") * 2).cast("decimal(14,2)")).cast("string").alias("doubled"),
        F.count_if(F.col("d") > F.lit("123456.78").cast("decimal(12,2)")).alias("n"),
    )


@query("fn_array", """
    SELECT p_partkey, array_to_string(list_sort(a), ',') AS sorted, list_contains(a, 'ring') AS has_ring,
           CAST(len(a) AS BIGINT) AS n, CAST(CASE WHEN p_type = 'PROMO' THEN -1 ELSE len(a) END AS BIGINT) AS n_or_minus,
           a[1] AS first_item, a[10] AS tenth
    FROM (SELECT p_partkey, p_type, string_split(p_name, ' ') || [p_brand] AS a FROM part) t""")
def fn_array(spark, sf):
    words = F.split("p_name", " ")
    a = F.concat(words, F.array("p_brand"))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.sort_array(a), ",").alias("sorted"), F.array_contains(a, "ring").alias("has_ring"),
        F.size(a).cast("bigint").alias("n"),
        collections.size(F.when(F.col("p_type") != "PROMO", a)).cast("bigint").alias("n_or_minus"),
        collections.item(a, 0).alias("first_item"), collections.item(a, 9).alias("tenth"),
    )


@query("fn_map", """
    SELECT p_partkey, 'brand,type' AS ks, array_to_string(list_sort([p_brand, p_type]), ',') AS vs, p_type AS t,
           CAST(NULL AS VARCHAR) AS missing, CAST(2 AS BIGINT) AS n FROM part""")
def fn_map(spark, sf):
    m = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.sort_array(F.map_keys(m)), ",").alias("ks"),
        F.array_join(F.sort_array(F.map_values(m)), ",").alias("vs"), collections.entry(m, F.lit("type")).alias("t"),
        collections.entry(m, F.lit("color")).alias("missing"), collections.size(m).cast("bigint").alias("n"),
    )


@query("fn_struct", """
    SELECT s_suppkey, s_name AS by_position, s_acctbal AS by_name, s_name || '@' || s_nationkey AS both_fields FROM supplier""")
def fn_struct(spark, sf):
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "struct(s_name, s_acctbal) AS a", "named_struct('who', s_name, 'land', s_nationkey, 'bal', s_acctbal) AS b"
    ).selectExpr("s_suppkey", "a.s_name AS by_position", "b.bal AS by_name", "concat(b.who, '@', b.land) AS both_fields")


@query("fn_reflect", """
    SELECT s_suppkey, CAST(s_acctbal AS VARCHAR) AS r, CAST(greatest(s_nationkey, 7) AS VARCHAR) AS j FROM supplier""")
def fn_reflect(spark, sf):
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "reflect('java.lang.String', 'valueOf', s_acctbal) AS r",
        "java_method('java.lang.Math', 'max', s_nationkey, 7) AS j",
    )
