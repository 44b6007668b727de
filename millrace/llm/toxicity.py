"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

1. A bounded sample of labelled documents (``MAX_LABELLED`` rows, those with the
   smallest hash of their id) is taken from the rows that may be learned from.
2. A lexicon of word beginnings is learned from the sample: beginnings of 4 to 8
   letters that clearly more toxic than clean documents hold, next to a short
   list of known insults.
3. Dense features per text: lexicon densities, how near a second-person word
   stands to a hit, capitals, punctuation, obfuscated words and obfuscated hits.
4. Spark's gradient-boosted trees learn from three quarters of the sample; on the
   last quarter an isotonic regression turns their score into a probability.

Scoring is one pass over the texts, in Arrow batches, without any shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored, text_of
from millrace.skew import checked_broadcast

MAX_LABELLED = 12_000  # labelled rows a model is fitted on
MAX_LEXICON = 1_000  # learned beginnings that are kept
SHORTEST, LONGEST = 4, 8  # letters of a beginning
# A short list of plain insults; the rest is learned.
INSULTS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile",
    "dumb", "filthy", "vermin", "cretin", "degenerate", "jerk", "bastard",
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch tu te toi ton ta vous votre usted ti tus".split())
FEATURES = (
    "insults", "learned_strong", "learned_weak", "weight", "best", "hits", "near_you", "you", "upper", "shouting",
    "exclaim", "symbols", "obfuscated", "hidden_hits", "size",
)
WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
MIXED = re.compile(r"(?<!\S)(?=\S{0,20}[A-Za-z])[A-Za-z]+[0-9@$*!|+]+[A-Za-z0-9@$*!|+]*")
PLAIN = str.maketrans("013457@$!|+", "oieastasiit", "*")


def learnable(id_column: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, mod 3, isn't 1."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 != 1


def sample_labelled(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", max_rows: int = MAX_LABELLED) -> DataFrame:
    """(id, text, label) of at most ``max_rows`` labelled documents that may be
    learned from, those with the smallest hash of their id. Rows without an id or
    label are left out, and of repeated ids one row of each table counts."""
    known = labels.select(F.col(id_column).alias("id"), F.col("toxic").cast("double").alias("label"))
    known = known.where("id IS NOT NULL AND label IS NOT NULL").where(learnable("id")).groupBy("id").agg(F.max("label").alias("label"))
    present = docs.select(F.col(id_column).alias("id")).join(checked_broadcast(known), "id").distinct()
    # Bounded by max_rows, so safe to copy to every executor.
    chosen = F.broadcast(present.orderBy(F.xxhash64("id"), "id").limit(max_rows))
    rows = docs.select(F.col(id_column).alias("id"), text_of().alias("text")).join(chosen, "id")
    label = F.first("label").alias("label")  # one per id
    return rows.groupBy("id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"), label)


def learn_lexicon(sample: DataFrame, least: int = 6, most: int = MAX_LEXICON) -> dict[str, float]:
    """Beginnings of words with the log ratio of the shares of toxic and clean
    documents that hold them; at most ``most``, each in ``least`` toxic documents."""
    totals = sample.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["toxic"] or 0.0, totals["n"] - (totals["toxic"] or 0.0)
    if not toxic or not clean:
        return {}
    words = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))
    word = sample.select("id", "label", F.explode(words).alias("word")).where(F.length("word") >= SHORTEST)
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    begins = word.select("id", "label", F.explode(F.transform(sizes, lambda n: F.substring("word", F.lit(1), n))).alias("start")).distinct()
    counted = begins.groupBy("start").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    kept = counted.where(F.col("t") >= least).withColumn("w", weight).where("w >= 1.2")
    strength = (F.col("t") / toxic - F.col("c") / clean).alias("gain")
    rows = kept.select("start", "w", strength).orderBy(F.desc("gain"), "start").limit(most).collect()
    return {r["start"]: float(r["w"]) for r in rows}


def text_features(text: str, lexicon: dict[str, float], starts: frozenset[str]) -> list[float]:
    """The values of ``FEATURES`` for one text; an empty text gives zeros."""
    low = text.lower()
    words = WORD.findall(low)
    n = len(words)
    per = 1000.0 / (n + 20)
    insults = strong = weak = 0
    weight = best = 0.0
    places: list[int] = []
    for i, w in enumerate(words):
        if w[:SHORTEST] in starts:
            if w in _INSULTS:
                insults += 1
                places.append(i)
            value = 0.0
            for k in range(min(len(w), LONGEST), SHORTEST - 1, -1):
                value = lexicon.get(w[:k], 0.0)
                if value:
                    break
            if value >= 3:
                strong += 1
                places.append(i)
            elif value:
                weak += 1
            weight += value
            if value > best:
                best = value
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if you and places:
        at = np.searchsorted(you, places)
        padded = np.array([-(10**9), *you, 10**9])
        gap = np.minimum(np.asarray(places) - padded[at], padded[at + 1] - np.asarray(places))
        near = int((gap <= 5).sum())
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = len(raw) + 1
    counts = np.bincount(raw, minlength=128) if len(raw) else np.zeros(128, np.int64)
    upper = counts[65:91].sum() / size
    exclaim = (counts[33] + counts[63]) / size
    symbols = (counts[35:39].sum() + counts[42] + counts[64]) / size
    shouting = len(SHOUT.findall(text)) * per if upper > 0.02 else 0.0
    mixed = MIXED.findall(text) if symbols or counts[33] or counts[48:58].any() or counts[124] or counts[43] else []
    hidden = 0
    for token in mixed:
        plain = token.lower().translate(PLAIN)
        if plain in _INSULTS or any(plain[:k] in lexicon for k in range(LONGEST, SHORTEST - 1, -1)):
            hidden += 1
    return [
        insults * per, strong * per, weak * per, weight * per, best, float(len(places)), near * per, len(you) * per,
        float(upper), shouting, float(exclaim), float(symbols), len(mixed) * per, hidden * per, math.log1p(n),
    ]


_INSULTS = frozenset(INSULTS)


def with_features(rows: DataFrame, lexicon: dict[str, float], text_column: str = "text") -> DataFrame:
    """``rows`` with the text replaced by the columns ``FEATURES``."""
    starts = frozenset(w[:SHORTEST] for w in (*lexicon, *INSULTS))
    kept = [f for f in rows.schema.fields if f.name != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            table = np.array([text_features(t or "", lexicon, starts) for t in texts]).reshape(len(texts), len(FEATURES))
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(table[:, k]) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + list(FEATURES))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{f} double" for f in FEATURES])
    return rows.mapInArrow(run, schema)


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon, trees, calibration, constant: float | None = None) -> None:
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a column text) with the text replaced by ``score``, 0 to 1."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        kept = [c for c in rows.columns if c != "text"]
        if self.constant is not None:
            return rows.select(*kept, F.lit(self.constant).alias("score"))
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(with_features(rows, self.lexicon))
        scored = self.trees.transform(ready).withColumn("_chance", F.element_at(vector_to_array("probability"), -1))
        scored = self.calibration.transform(scored)
        return scored.select(*kept, F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", max_rows: int = MAX_LABELLED, rounds: int = 20) -> Model:
    """A model from the labelled documents that may be learned from. With one
    class only, or no labelled row, every score is that class's share (0 if none)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    sample = stored(sample_labelled(docs, labels, id_column, max_rows), "toxicity-sample")
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        return Model({}, None, None, next(iter(classes), 0.0))
    lexicon = learn_lexicon(sample)
    rows = with_features(sample.select("id", "label", "text"), lexicon)
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(4))), "toxicity-features")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(rows)
    learn, check = rows.where("part > 0"), rows.where("part = 0")
    if learn.select("label").distinct().count() < 2 or check.select("label").distinct().count() < 2:
        learn = check = rows  # too few rows to hold a quarter back
    # One partition: the sample is bounded, and many small tasks cost more than they do.
    trees = GBTClassifier(
        featuresCol="_vector", labelCol="label", predictionCol="_class",
        maxIter=rounds, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=7,
    ).fit(learn.select("label", "_vector").coalesce(2))
    raw = trees.transform(check).withColumn("_chance", F.element_at(vector_to_array("probability"), -1))
    calibration = IsotonicRegression(featuresCol="_chance", labelCol="label", predictionCol="_score").fit(raw.select("_chance", "label"))
    return Model(lexicon, trees, calibration)


def judge(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_column: str = "doc_id", max_rows: int = MAX_LABELLED
) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from ``threshold`` on).

    Inputs of the score are the text alone. NULL counts as an empty text, which
    has a score too. Rows that repeat are scored alike; a NULL id counts as not
    held out. Without any labelled row scores are 0. An empty table gives no
    rows. Other columns of ``docs`` play no part.
    """
    model = fit(docs, labels, id_column, max_rows)
    scored = model.score(docs.select(F.col(id_column).alias("id"), text_of().alias("text")))
    return scored.select(
        F.col("id").alias(id_column), F.coalesce(~learnable("id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
