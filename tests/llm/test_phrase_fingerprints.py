"""Fingerprints decide which phrases are counted by text, and lose none that is frequent."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from millrace.llm import phrases

EVERYTHING = phrases.Filter(np.full(1 << 4, np.uint64(2**64 - 1)), 10)


def words_of(texts):
    words, raw = phrases.Words(), [t.encode() for t in texts]
    words.add(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.zeros(len(raw), np.int64))
    return words


@pytest.mark.parametrize("bits", [0, 3])
@pytest.mark.parametrize("least", [2, 7, 400])
def test_sums_of_fingerprints_are_the_counts(bits, least):
    rng = np.random.default_rng(least)
    blocks = [[" ".join(f"w{i}" for i in rng.zipf(1.5, 40) % 50) for _ in range(30)] for _ in range(3)] + [["hot hot hot"] * 200, ["lone word"]]
    true, rows = Counter(), []
    for texts in blocks:
        found = phrases.Found(words_of(texts), ["en"], 3, phrases.Filters(EVERYTHING))
        for k, at in enumerate(found.places, 1):
            for m in found.marks(at, k):
                true[int(m)] += 1
        for batch in phrases._sent(bits, least, 3, SimpleNamespace(value=phrases.Filters(EVERYTHING)))(words_of(texts), ["en"]):
            rows += batch.to_pylist()
    got = Counter()
    for _, lists in pd.DataFrame(rows).groupby("owner"):
        got.update(phrases._often(bits, least)(lists)["mark"].tolist())
    marks = phrases._mixed(phrases._prints(np.array([m for m, n in true.items() if n >= least], np.uint64))).view(np.int64)
    assert got == Counter(marks.tolist()) and len(got) < len(true)
    assert len({r["owner"] for r in rows}) == 1 << bits


def test_rare_phrases_are_not_sent_as_texts(spark):
    """All words are frequent, so every phrase is counted; hardly any is frequent itself."""
    rng = np.random.default_rng(5)
    rows = [(" ".join(f"w{i}" for i in rng.integers(0, 200, 100)) + ", new york city", "en") for _ in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = {r["phrase"]: r["f"] for r in phrases.frequent_phrases(df, 40, sample=1).where("words > 1").collect()}
    assert got == {"new york": 200, "york city": 200, "new york city": 200}
    texts = df.select("lang", "text")
    finalists = phrases._finalists(texts, 5, EVERYTHING, 0, 40, 5000)

    def sent(filters):
        return texts.mapInArrow(phrases._count({1, 2, 3}, spark.sparkContext.broadcast(filters), 5000), phrases.COUNTS_SQL).count()

    assert sent(phrases.Filters(EVERYTHING, finalists=finalists)) * 10 < sent(phrases.Filters(EVERYTHING))
