"""The most frequent texts, counted beside groups of the others."""

import random
from collections import Counter

import pytest

from millrace.operators import sketches as S
from millrace.operators import text_aggregates as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def top(data, k):
    return sorted(Counter(w for w in data if w is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("slots", [1, 4096])
@pytest.mark.parametrize("proposed", [[], ["absent", None, "x3", "x1", "x1"], [f"x{i}" for i in range(40)]])
def test_proposals_never_change_the_result(spark, slots, proposed):
    rng = random.Random(slots)
    data = [f"x{min(int(rng.paretovariate(0.8)), 300)}" for _ in range(6000)] + [None, "", ""] * 5 + ["tie a", "tie b"] * 9
    items = spark.createDataFrame([(w,) for w in data], "`a b` string").repartition(3)
    given = spark.createDataFrame([(p,) for p in proposed], "item string")
    for k in (12, 10_000):
        assert [tuple(r) for r in S.most_frequent(items, given, k, slots).collect()] == top(data, k)
    assert S.most_frequent(items.where("false"), given, 5, slots).count() == 0


def test_rare_ngrams_are_not_counted_one_by_one(spark):
    # 30 frequent pairs beside 9,000 that occur once: the result comes from the counts per slot, texts are not grouped.
    rng = random.Random(4)
    texts = [" ".join(f"hot{i} end{i}. " * 2 for i in rng.sample(range(30), 20)) + f"r{n}a r{n}b r{n}c r{n}d" for n in range(3000)]
    words = X.sentence_words(spark.createDataFrame([(t,) for t in texts], "t string").repartition(4), "t")
    want = top([f"{a} {b}" for t in texts for s in t.split(".") for a, b in zip(s.split(), s.split()[1:])], 20)
    for got in (X.top_ngrams(words, 2, 20), S.frequent_exactly(X.ngrams(words, 2), 20)):
        assert [tuple(r) for r in got.collect()] == want
        assert "Generate" not in plan(got)


def test_a_sample_without_words_proposes_nothing(spark):
    words = X.sentence_words(spark.createDataFrame([("the cat sat. the cat ran",), (None,)], "t string"), "t")
    none = words.where("false")
    assert [tuple(r) for r in X.top_ngrams(words, 2, 2, none).collect()] == [("the cat", 2), ("cat ran", 1)]
    assert [tuple(r) for r in X.top_context_ngrams(words, ["the", None], 2, none).collect()] == [("cat", 2)]
