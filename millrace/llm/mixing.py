"""Mixing sources to target weights by hierarchical budgets.

A tree of domain, language and source. A node's budget in tokens goes to its
children by weight; no child gets more than it can supply (its tokens times the
epochs allowed). What one child cannot supply goes to its siblings by weight,
and leaves the node only when all of it is used up: shortages are settled among
siblings before ancestors. Within a leaf whole epochs are taken first, then the
prefix of one more epoch in a seeded order whose tokens fit the rest.

The leaf's order is the MD5 of seed, epoch and id. Running totals never sort a
whole leaf: tokens are summed by leaf and leading digits of the digest (about
``BUCKET_ROWS`` rows each, however large the leaf), the sums are accumulated, and
only the one bucket of a leaf that the budget ends in is looked at row by row.
All numbers are whole, so results do not depend on the order of sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import packed, rows_with, stored, word_count

LEVELS = ("domain", "lang", "source")
BUCKET_ROWS = 4096
#: Default weights; a node that is not named has weight 1. Keys are paths from the top.
WEIGHTS = {"web": 4, "books": 3, "code": 2, "forum": 1, "web/en": 3, "books/en": 3, "code/en": 3, "forum/en": 3}


def domain_of(source: Column) -> Column:
    """The domain of a source, from the number its name ends in: n mod 4 is web,
    books, code or forum; other names are web."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    names = F.array(*[F.lit(n) for n in ("web", "books", "code", "forum")])
    return F.when(number == "", F.lit("web")).otherwise(F.get(names, F.pmod(number.cast("int"), F.lit(4))))


def _weight(path: Column, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, path), F.lit(1)).cast("long")


def _share(nodes: DataFrame, parents: list[str], weights: Mapping[str, int], name: str) -> DataFrame:
    """Give each node its part of ``budget`` of its parent (water filling).

    Children are taken by rising capacity per weight. One is filled up if its
    capacity is at most what is left, split by the weights that are left; the
    first that isn't and all after it share the rest by weight, rounded down.
    """
    path = F.concat_ws("/", *parents, name)
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name).asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("weight", _weight(path, weights))
    n = (
        n.withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("c_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("weight").over(by) - F.col("w_before"))
        .withColumn("b_left", F.col("budget") - F.col("c_before"))
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    full = wide("capacity") * wide("w_left") <= wide("weight") * wide("b_left")
    n = n.withColumn("full", full)
    rest_w = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    rest_b = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0))
    n = n.withColumn("rest_w", rest_w).withColumn("rest_b", rest_b)
    part = F.floor(wide("weight") * wide("rest_b") / wide("rest_w")).cast("long")
    given = F.when(F.col("full"), F.col("capacity")).otherwise(F.least("capacity", part))
    return n.withColumn("budget", given).drop("weight", "w_before", "c_before", "w_left", "b_left", "full", "rest_w", "rest_b")


def budgets(leaves: DataFrame, total: int, weights: Mapping[str, int] = WEIGHTS, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(levels…, tokens, capacity, budget) of every leaf. ``leaves`` has the levels,
    ``tokens`` and ``capacity`` (tokens times epochs); ``total`` is the top's budget."""
    done = None
    for depth, name in enumerate(levels):
        parents = list(levels[:depth])
        nodes = leaves.groupBy(*parents, name).agg(F.sum("capacity").alias("capacity"))
        if done is None:
            nodes = nodes.withColumn("budget", F.lit(int(total)).cast("long"))
        else:
            nodes = nodes.join(done, parents)
        done = _share(nodes, parents, weights, name).select(*parents, name, "budget")
    return leaves.join(done, list(levels))


def mix(
    docs: DataFrame, share: float = 0.5, total: int | None = None, weights: Mapping[str, int] = WEIGHTS,
    max_epochs: int = 2, seed: int = 17, tokens: Column | None = None, domain: Column | None = None,
    id_column: str = "doc_id", row_key: Column | None = None, cut: bool = False,
) -> DataFrame:
    """The documents of the mixture: one row per document and epoch it is taken in.

    Columns: id, domain, lang, source, n_tokens, epoch (from 0). ``total`` tokens
    are wanted, by default ``share`` of all tokens (rounded down). Tokens are
    words unless ``tokens`` says otherwise; domains come from ``domain_of``.

    Without ``cut`` documents stay whole, and a leaf's last epoch ends before the
    first one that passes its budget. With it that document is taken, too, up to
    the tokens that are left: each leaf gives its budget to the token. One more
    column, ``taken``, has the number of tokens to take from the row's start.

    NULL languages and sources count as the text ``unknown``. Documents without
    tokens (NULL or empty texts) cost nothing and come in every whole epoch of
    their leaf, and in the last as far as the budget reaches. Rows that repeat an
    id follow each other, ordered by tokens, and are chosen row by row. A NULL id
    is ordered as an empty one. An empty table gives no rows. ``row_key`` is
    carried along as one more column.
    """
    lang, source = (F.coalesce(F.col(c), F.lit("unknown")) for c in ("lang", "source"))
    base = docs.select(
        F.col(id_column).alias("id"), (domain_of(F.col("source")) if domain is None else domain).alias("domain"),
        lang.alias("lang"), source.alias("source"), (word_count() if tokens is None else tokens).cast("long").alias("n_tokens"),
        *([] if row_key is None else [row_key.alias("row_key")]),
    )
    base = stored(base, "mix-tokens")
    sums = base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    leaves = stored(sums.withColumn("capacity", F.col("tokens") * max_epochs), "mix-leaves")
    if total is None:
        every = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
        total = math.floor(every * share)
    given = budgets(leaves, total, weights)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    plan = given.select(*LEVELS, whole.alias("epochs"), (F.col("budget") - whole * F.col("tokens")).alias("rest"), "n_rows", "tokens")
    # One row per leaf: joined by its key, copied only where its measured size allows (AQE's own rule).
    plan = stored(plan, "mix-plan")
    rows = base.join(plan, list(LEVELS))
    taken = rows.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int") - 1)))
    columns = ["id", *LEVELS, "n_tokens", "epoch", *([] if row_key is None else ["row_key"]), *(["taken"] if cut else [])]
    taken = taken.withColumn("taken", F.col("n_tokens")).select(columns)
    taken = taken.unionByName(_prefixes(rows.where("rest > 0"), seed, cut).select(columns))
    return taken.withColumnRenamed("id", id_column)


def _prefixes(rows: DataFrame, seed: int, cut: bool = False) -> DataFrame:
    """Rows in seeded order whose running tokens stay within ``rest`` of their
    leaf; with ``cut`` the row that passes it as well, with the tokens ``taken``."""
    # Digits so that a bucket has about BUCKET_ROWS rows: 16^digits >= n_rows / BUCKET_ROWS.
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("n_rows") / BUCKET_ROWS) / math.log(16))).cast("int")
    epoch = F.col("epochs").cast("int")
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    keyed = rows.withColumn("epoch", epoch).withColumn("digest", F.md5(name.cast("binary")))
    keyed = keyed.withColumn("bucket", F.substring("digest", F.lit(1), digits))
    leaf = list(LEVELS)
    buckets = keyed.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.max("rest").alias("limit"))
    before = F.sum("in_bucket").over(Window.partitionBy(*leaf).orderBy("bucket")) - F.col("in_bucket")
    marks = buckets.withColumn("start", before).where("start <= limit")
    marks = marks.withColumn("inside", F.col("start") + F.col("in_bucket") <= F.col("limit"))
    placed = keyed.join(marks.select(*leaf, "bucket", "start", "inside"), [*leaf, "bucket"])
    within = Window.partitionBy(*leaf, "bucket").orderBy("digest", "n_tokens")
    ending = placed.where("NOT inside").withColumn("reached", F.col("start") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    ending = ending.where("reached <= rest" + " OR reached - n_tokens < rest" * cut)
    ending = ending.withColumn("taken", F.least("n_tokens", F.expr("rest - reached + n_tokens"))).drop("reached")
    return placed.where("inside").withColumn("taken", F.col("n_tokens")).unionByName(ending)


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each once, columns as they
    are. A row is known by its id (NULL or not), text, language, source and
    tokens; of rows equal in all of these as many stay as the mixture takes."""
    tokens = options.get("tokens")
    parts = [F.col(c).cast("string").alias(c) for c in (id_column, "text", "lang", "source") if c in docs.columns]
    parts += [] if tokens is None else [tokens.cast("long").alias("_tokens")]
    key = F.sha2(F.to_json(F.struct(*parts)), 256)  # NULL fields are left out, so the key is never NULL
    mixed = mix(docs, id_column=id_column, row_key=key, **options)
    taken = stored(mixed.groupBy("row_key", "epoch").count().groupBy("row_key").agg(F.max("count").alias("n")), "mix-taken")
    rows = packed(docs, row_key=key)
    repeated = rows.groupBy("row_key").count().where("count > 1")
    some = stored(repeated.join(taken, "row_key").where("count > n").select("row_key", "n"), "mix-some")
    if not some.limit(1).count():
        return rows_with(rows, taken.select("row_key"), ["row_key"]).select("own.*")
    out = rows_with(rows, taken.join(some, "row_key", "left_anti").select("row_key"), ["row_key"])
    # Rows of one key are equal in all that counts: which of them stay is told by their place among the copies.
    numbered = rows.join(some, "row_key").withColumn("at", F.row_number().over(Window.partitionBy("row_key").orderBy("row_key")))
    return out.select("own.*").unionByName(numbered.where("at <= n").select("own.*"))
