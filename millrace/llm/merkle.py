"""A Merkle manifest of a table, and each row's proof climbed by a recursive query.

Leaves are numbered in the order of source and id without a sort in one task:
rows are dealt by range, and a row's number is its place in its partition after
the sizes of the partitions before. A node covers consecutive leaves, so its
identifier is its level and the number of its first leaf.

Levels are built from below, three nodes to a run; per source first, then over
the sources' subroots. A block of ``fanout ** DEPTH`` consecutive leaves is one row,
whose levels are arrays. The levels above become rows of nodes, linked to their
parents, with the siblings before and after. A Spark recursive query then ascends
from every block: each step appends the run's siblings to the path and folds them
into the hash of each of the block's leaves.

All leaves meet in few nodes near the top. A node has one row per piece of
``PIECE`` blocks' worth of leaves under it, so no key of the climb's join has more
rows than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.scratch import new_name
from millrace.skew import checked_broadcast

FANOUT = 3
DEPTH = 3  # levels inside a block
PIECE = 64  # blocks that climb through one copy of a node
LEVEL = 1 << 56  # node identifier: level * LEVEL + number of the first leaf
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(column: Column) -> Column:
    """A field as its UTF-8 byte count, ``:`` and value; ``-`` for NULL."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def without_breaks(text: Column) -> Column:
    return F.translate(text, "\n", "")


def chosen_by_id(key: Column) -> Column:
    """Rows that are tampered with: 2 divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 2 == 0, F.lit(False))


@contextmanager
def _unbounded_recursion(spark: SparkSession) -> Iterator[None]:
    """Spark stops recursive queries at 1,000,000 rows unless told otherwise."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in the given order) and ``part``, the
    range it lies in. Ranges and places are written once, then counted."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("part").count()  # one row per partition
    before = sizes.selectExpr("part", "sum(count) OVER (ORDER BY part) - count AS before")
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.expr(f"before + place % {1 << 33}")).drop("place", "before")


def _leaves(docs: DataFrame, tampered: Column, changed: Column, fields: tuple[str, ...], id_column: str, source_column: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, sources): leaf rows with their number, the number their source
    starts at and its size; and one row per part and source that meet."""
    cells = {c: F.col(f"`{c}`") for c in fields}
    leaf = digest(*[encoded(c) for c in cells.values()])
    other = digest(*[encoded(changed if name == "text" else c) for name, c in cells.items()])
    # Sources as keys that are never NULL: NULL first, then by bytes.
    source = F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("key"), source.alias("source_key"), leaf.alias("leaf"),
        F.when(tampered, other).otherwise(leaf).alias("tampered_leaf"), F.monotonically_increasing_id().alias("row"),
    )
    # The row's number comes last, so that copies of one row spread over ranges; they are alike.
    ranked = _ranked(stored(rows, "merkle-rows"), ["source_key", "key", "leaf", "row"], "merkle-ranges").drop("row")
    met = stored(ranked.groupBy("part", "source_key").agg(F.min("rank").alias("low"), F.count(F.lit(1)).alias("c")), "merkle-parts")
    sizes = met.groupBy("source_key").agg(F.min("low").alias("start"), F.sum("c").alias("n"))
    met = stored(met.select("part", "source_key").join(sizes, "source_key"), "merkle-sources")
    return stored(ranked.join(checked_broadcast(met), ["part", "source_key"]), "merkle-leaves"), met


def _levels(nodes: DataFrame, level: int, fanout: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """(runs of every level, tops of every level, next free level number). Nodes
    have start (of their tree), n (nodes of this level), at, id, first, last, hash."""
    runs, tops = [], []
    width = nodes.agg(F.max("n")).first()[0] or 0
    while width:
        tops.append(nodes.where("n = 1"))
        if width == 1:
            break
        member = F.struct("at", "id", "first", "last", "hash")
        met = nodes.where("n > 1").groupBy("start", F.expr(f"at div {fanout}").alias("at")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members")  # at most `fanout`
        )
        met = met.withColumn("n", F.expr(f"(n + {fanout - 1}) div {fanout}"))
        met = met.withColumn("first", F.expr("members[0].first")).withColumn("last", F.expr("element_at(members, -1).last"))
        met = met.withColumn("id", F.lit(level * LEVEL) + F.col("first"))
        met = stored(met.withColumn("hash", F.sha2(F.array_join("members.hash", "").cast("binary"), 256)), f"merkle-level-{level}")
        runs.append(met)
        nodes, level, width = met.drop("members"), level + 1, -(-width // fanout)
    return runs, tops, level


def _blocks(leaves: DataFrame, fanout: int, depth: int) -> DataFrame:
    """One row per block: start, n (blocks of the source), at, part, first, last,
    its leaves, and from its own levels its hash, each leaf's folded hash and path."""
    width, join = fanout**depth, "array_join({}, '')".format
    at = F.expr(f"(rank - start) div {width}").alias("at")
    rows = leaves.groupBy("start", at).agg(
        F.max("n").alias("leaves_n"), F.min("part").alias("part"), F.array_sort(F.collect_list(F.struct("rank", "key", "leaf", "tampered_leaf"))).alias("leaves")
    )  # at most `width` leaves
    rows = rows.withColumn("n", F.expr(f"(leaves_n + {width - 1}) div {width}"))
    rows = rows.withColumn("first", F.expr("leaves[0].rank")).withColumn("last", F.expr("element_at(leaves, -1).rank"))
    rows = rows.withColumn("l0", F.col("leaves.leaf")).withColumn("f0", F.col("leaves.tampered_leaf")).withColumn("p0", F.transform("leaves", lambda _: F.lit("")))
    sha = "sha2(cast({} as binary), 256)".format
    for k in range(depth):
        # A source smaller than a block ends where one node is left.
        more = F.expr(f"leaves_n > {width} OR size(l{k}) > 1")
        place, node = f"((i div {fanout**k}) % {fanout})", f"(i div {fanout**k})"
        before = join(f"slice(l{k}, {node} - {place} + 1, {place})")
        after = join(f"slice(l{k}, {node} + 2, {fanout - 1} - {place})")
        up = F.expr(f"transform(sequence(0, (size(l{k}) - 1) div {fanout}), j -> {sha(join(f'slice(l{k}, {fanout} * j + 1, {fanout})'))})")
        folded = F.expr(f"transform(f{k}, (f, i) -> {sha(f'concat({before}, f, {after})')})")
        path = F.expr(f"transform(p{k}, (p, i) -> concat(p, {before}, {after}))")
        rows = rows.withColumns({f"l{k + 1}": F.when(more, up).otherwise(F.col(f"l{k}")), f"f{k + 1}": F.when(more, folded).otherwise(F.col(f"f{k}")), f"p{k + 1}": F.when(more, path).otherwise(F.col(f"p{k}"))})
    done = F.arrays_zip(F.col("leaves.key").alias("key"), F.col("leaves.leaf").alias("leaf"), F.col(f"p{depth}").alias("path"))
    return rows.select("start", "n", "at", "part", "first", "last", F.expr(f"l{depth}[0]").alias("hash"), F.transform(F.col(f"f{depth}"), F.unhex).alias("folded"), done.alias("leaves"))


def _linked(runs: DataFrame, piece: int) -> DataFrame:
    """Node rows: id, piece, parent and the siblings' digests before and after."""
    each = runs.select(F.col("id").alias("parent"), "members.hash", F.posexplode("members").alias("k", "m"))
    joined = lambda part: F.unhex(F.array_join(F.expr(part), ""))
    return each.select(
        F.col("m.id").alias("id"), "parent",
        joined("slice(hash, 1, k)").alias("before"), joined("slice(hash, k + 2, size(hash))").alias("after"),
        F.explode(F.expr(f"sequence(m.first div {piece}, m.last div {piece})")).alias("piece"),
    )


CLIMB = """
WITH RECURSIVE climb AS (
  SELECT first, piece, first AS node, 0 AS step, folded, CAST('' AS BINARY) AS siblings FROM {blocks}
  UNION ALL
  SELECT c.first, c.piece, n.parent, c.step + 1,
         transform(c.folded, f -> unhex(sha2(CAST(lower(concat(hex(n.before), hex(f), hex(n.after))) AS BINARY), 256))),
         concat(n.before, n.after)
  FROM climb c JOIN {nodes} n ON n.id = c.node AND n.piece = c.piece)
SELECT first, step, folded, siblings FROM climb
"""


def climb(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(first, folded, siblings) of each (first, piece, folded) block: what folding
    up to the root makes of its leaves, and the digests met, level by level."""
    spark = blocks.sparkSession
    names = {k: new_name(f"merkle_{k}") for k in ("blocks", "nodes")}
    blocks.createOrReplaceTempView(names["blocks"])
    nodes.createOrReplaceTempView(names["nodes"])
    try:
        with _unbounded_recursion(spark):
            steps = stored(spark.sql(CLIMB.format(**names)), "merkle-climb")
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)
    path = F.array_sort(F.collect_list(F.struct("step", "siblings")))  # one entry per level
    met = steps.groupBy("first").agg(F.max_by("folded", "step").alias("folded"), path.alias("path"))
    return met.select("first", "folded", F.lower(F.array_join(F.transform("path", lambda p: F.hex(p["siblings"])), "")).alias("siblings"))


def manifest(
    docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, fields: tuple[str, ...] = FIELDS,
    id_column: str = "doc_id", source_column: str = "source", fanout: int = FANOUT, depth: int = DEPTH, piece: int = PIECE,
) -> DataFrame:
    """One row per row of ``docs``: the id column, leaf, subroot (of its source),
    root, siblings (the proof's digests as one hex text), folded_root, verified.

    A leaf is the digest of ``fields``. Leaves of a source are in the order of
    ids, every ``fanout`` consecutive nodes become their digest until one is left,
    the subroot; subroots in the order of sources give the root in the same way.
    The proof folds the leaf, of ``changed`` instead of the text where ``tampered``
    holds, with the original siblings. By default rows chosen by their ids lose
    the line breaks of their texts.

    NULL fields are ``-``; NULL ids come first in their source and are never
    chosen by default; NULL is a source of its own, the first. Rows of one id and
    source are ordered by their leaves; rows equal in all fields are leaves of
    their own. Empty texts are values of no bytes. An empty table gives no rows.
    Other columns of ``docs`` play no part.
    """
    tampered = chosen_by_id(F.col(id_column)) if tampered is None else F.coalesce(tampered, F.lit(False))
    changed = without_breaks(F.col("text")) if changed is None else changed
    leaves, sources = _leaves(docs, tampered, changed, fields, id_column, source_column)
    blocks = stored(_blocks(leaves, fanout, depth), "merkle-blocks")
    runs, tops, level = _levels(blocks.select("start", "n", "at", F.col("first").alias("id"), "first", "last", "hash"), 1, fanout)
    if not tops:
        empty = docs.select(F.col(id_column), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "siblings", "folded_root")])
        return empty.withColumn("verified", F.lit(False)).where("false")
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.unionByName(top)
    subroots = stored(subroots.select("start", "id", "first", "last", "hash"), "merkle-subroots")
    ranked = _ranked(subroots, ["first"], "merkle-subroot-ranges").withColumnRenamed("rank", "at")
    trees = ranked.select(F.lit(0).cast("long").alias("start"), F.lit(subroots.count()).cast("long").alias("n"), "at", "id", "first", "last", "hash")
    upper, peak, _ = _levels(trees, level + 1, fanout)
    root = peak[-1].first()["hash"]
    share = piece * fanout**depth
    base = blocks.select("first", F.expr(f"first div {share}").alias("piece"), "folded")
    linked = [_linked(r, share) for r in runs + upper]
    if linked:
        nodes = linked[0]
        for more in linked[1:]:
            nodes = nodes.unionByName(more)
        climbed = climb(base, stored(nodes, "merkle-nodes"))
    else:  # one block is all there is
        climbed = base.select("first", "folded", F.lit("").alias("siblings"))
    # A source in a part: no more rows of one of them than the part has.
    named = sources.join(subroots.select("start", F.col("hash").alias("subroot")), "start").select("part", "start", "subroot")
    out = blocks.drop("folded", "hash").join(checked_broadcast(named), ["part", "start"]).join(climbed, "first")
    out = out.select("subroot", "siblings", "folded", F.posexplode("leaves").alias("place", "row"))
    folded = F.lower(F.hex(F.get("folded", F.col("place"))))
    return out.select(
        F.col("row.key").alias(id_column), F.col("row.leaf").alias("leaf"), "subroot", F.lit(root).alias("root"),
        F.concat("row.path", "siblings").alias("siblings"), folded.alias("folded_root"), (folded == F.lit(root)).alias("verified"),
    )
