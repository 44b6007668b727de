"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every input partition hashes its texts and cuts its documents into blocks.
   For each block and each owner (a range of fingerprints) it sends the sorted,
   distinct fingerprints as one Golomb code, about 1.5 bytes more than
   log2(range / count) / 8 per document, never texts or identifiers.
2. An owner merges the lists of all blocks and answers each with a bitmap: one
   bit per fingerprint of the list, set if it occurs elsewhere or twice there.
3. The bitmaps meet the blocks' identifiers, which stayed in a table beside the
   codes. Documents whose bit is set are suspects.
4. Only suspects' texts are shuffled. Per digest they meet as a smallest and a
   largest text (combined before the shuffle, so a hot text sends one row per
   task): equal bytes prove the group. Digests with different texts are split by
   the texts themselves.

Fingerprints of a block are distinct, so a text that a third of all rows share
adds one entry per block to its owner, not one per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import golomb
from millrace.llm.common import SPACES, packed, rows_with, stored, text_of

BLOCK_ROWS = 65_536  # documents whose fingerprints travel together
OWNER_ROWS = 1_000_000  # fingerprints that one owner merges at a time
SENT = "sender int, block int, owner int, codes binary, twice binary, ids binary, places binary"
ANSWER = "sender int, block int, owner int, bits binary"


def normalised(column: str = "text") -> Column:
    """The text with each run of white space as one space; NULL counts as empty."""
    return F.regexp_replace(text_of(column), SPACES, " ")


def _owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    return ((prints >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _sent_blocks(owners: int, block_rows: int):
    """Map side: (id, digest) batches of one partition to coded blocks."""

    def block(sender: int, number: int, ids: list[np.ndarray], prints: list[np.ndarray]) -> pa.RecordBatch:
        rows, prints = np.concatenate(ids), np.concatenate(prints)
        order = np.argsort(prints, kind="stable")
        rows, prints = rows[order], prints[order]
        distinct, place, counts = np.unique(prints, return_inverse=True, return_counts=True)
        owner = _owner_of(distinct, owners).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(cuts[1:], len(distinct))
        out: dict[str, list] = {k.split()[0]: [] for k in SENT.split(", ")}
        row_cuts = np.searchsorted(place, np.append(cuts, len(distinct)))
        for i, (a, b) in enumerate(zip(cuts, ends)):
            r = slice(row_cuts[i], row_cuts[i + 1])
            for k, v in zip(out, (
                sender, number, int(owner[a]), golomb.encode(distinct[a:b]),
                np.packbits(counts[a:b] > 1, bitorder="little").tobytes(),
                rows[r].astype(np.int64).tobytes(), (place[r] - a).astype(np.uint32).tobytes(),
            )):
                out[k].append(v)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sender, number, size = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        prints: list[np.ndarray] = []
        for batch in batches:
            ids.append(batch.column("row_id").to_numpy(zero_copy_only=False))
            prints.append(batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += batch.num_rows
            if size >= block_rows:
                yield block(sender, number, ids, prints)
                ids, prints, size, number = [], [], 0, number + 1
        if size:
            yield block(sender, number, ids, prints)

    return send


def _answers(lists: pd.DataFrame) -> pd.DataFrame:
    """Owner side: one bitmap for each list that came in."""
    codes = [golomb.decode(c) for c in lists["codes"]]
    sizes = [len(c) for c in codes]
    local = [np.unpackbits(np.frombuffer(t, np.uint8), count=n, bitorder="little") for t, n in zip(lists["twice"], sizes)]
    _, place, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    again = (counts[place] > 1) | (np.concatenate(local) > 0)
    parts = np.split(again, np.cumsum(sizes)[:-1])
    bits = [np.packbits(p, bitorder="little").tobytes() for p in parts]
    return lists[["sender", "block", "owner"]].assign(bits=bits)


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for bits, ids, places in zip(frame["bits"], frame["ids"], frame["places"]):
            place = np.frombuffer(places, np.uint32)
            flags = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
            yield pd.DataFrame({"row_id": np.frombuffer(ids, np.int64)[flags[place] > 0]})


def signatures(docs: DataFrame, id_column: str = "doc_id", digest_chars: int = 64) -> DataFrame:
    """(id, text_sha256, digest, row_id) of every document, written once.

    ``digest_chars`` shortens the digest that groups suspects (tests use that to
    provoke collisions). ``row_id`` numbers rows, so that ids may repeat.
    """
    sha = F.sha2(normalised().cast("binary"), 256)
    signed = docs.select(F.col(id_column).alias("id"), sha.alias("text_sha256"))
    return stored(
        signed.select("*", F.expr(f"left(text_sha256, {int(digest_chars)})").alias("digest"),
                      F.monotonically_increasing_id().alias("row_id")),
        "signatures",
    )


def suspects(signed: DataFrame, block_rows: int = BLOCK_ROWS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """row_id of the documents whose fingerprint occurs more than once."""
    owners = max(16, -(-signed.count() // owner_rows))
    prints = signed.select("row_id", F.xxhash64("digest").alias("print"))
    # Stored before both uses: owners and the return trip must see the same blocks, whatever task runs again.
    blocks = stored(prints.mapInArrow(_sent_blocks(owners, block_rows), SENT), "fingerprints")
    answers = (
        blocks.select("sender", "block", "owner", "codes", "twice").groupBy("owner").applyInPandas(_answers, ANSWER)
    )
    told = blocks.select("sender", "block", "owner", "ids", "places").join(answers, ["sender", "block", "owner"])
    return told.select("bits", "ids", "places").mapInPandas(_suspects, "row_id long")


def duplicate_groups(
    docs: DataFrame, id_column: str = "doc_id", digest_chars: int = 64,
    block_rows: int = BLOCK_ROWS, owner_rows: int = OWNER_ROWS,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of white space is one space. Of
    equal texts the smallest id stays. NULL texts are empty texts, and empty
    texts are equal. Rows that repeat an id and its text count in group_size and
    are all marked like their first. A NULL id is larger than any other. An
    empty table gives no rows. Other columns of ``docs`` play no part.
    """
    signed = signatures(docs, id_column, digest_chars)
    found = stored(suspects(signed, block_rows, owner_rows).join(signed, "row_id").select("id"), "suspects")
    texts = docs.select(F.col(id_column).alias("id"), normalised().alias("norm"))
    # Ids may repeat with other texts; those come along as groups of one.
    near = rows_with(texts, found.select("id").distinct(), ["id"])
    if found.where("id IS NULL").limit(1).count():
        near = near.unionByName(texts.where("id IS NULL"))
    near = near.withColumn("digest", F.expr(f"left(sha2(cast(norm as binary), 256), {int(digest_chars)})"))
    verified = stored(
        near.groupBy("digest").agg(
            F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
            (F.min("norm") == F.max("norm")).alias("same"),
        ),
        "verified",
    )
    groups = verified.where("same AND group_size > 1").drop("same")
    out = signed.join(groups, "digest", "left")
    mixed = verified.where("NOT same").select("digest")
    if mixed.limit(1).count():  # different texts under one digest: the texts themselves decide
        split = rows_with(near, mixed, ["digest"]).groupBy("digest", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "norm").agg(
            F.min("id").alias("_keep"), F.count(F.lit(1)).alias("_size")
        )
        out = out.join(split.drop("norm"), ["digest", "text_sha256"], "left")
        keep, size = F.coalesce("_keep", "keep_id"), F.coalesce("_size", "group_size")
    else:
        keep, size = F.col("keep_id"), F.col("group_size")
    size = F.coalesce(size, F.lit(1)).cast("long")
    keep = F.when(size > 1, keep).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_column), keep.alias("keep_id"), size.alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def _row_key(id_column: str, sha: Column) -> Column:
    """Id and text digest as one string that is never NULL."""
    text = F.col(id_column).cast("string")
    return F.concat_ws("/", sha, F.when(text.isNotNull(), F.concat(F.lit("="), text)))


def deduplicate(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of equal texts
    the row with the smallest id, once even if that row is repeated."""
    groups = stored(duplicate_groups(docs, id_column), "exact-groups").where("group_size > 1")
    keys = groups.select(_row_key(id_column, F.col("text_sha256")).alias("key"), "kept")
    gone = keys.where("NOT kept").select("key").distinct()
    repeated = keys.where("kept").groupBy("key").count().where("count > 1").select("key")
    sha = F.sha2(normalised().cast("binary"), 256)
    rest = rows_with(packed(docs, key=_row_key(id_column, sha)), gone, ["key"], "left_anti")
    if repeated.limit(1).count():
        once = rows_with(rest, repeated, ["key"]).dropDuplicates(["key"])
        rest = rows_with(rest, repeated, ["key"], "left_anti").unionByName(once)
    return rest.select("own.*")
