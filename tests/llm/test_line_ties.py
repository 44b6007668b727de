"""Repeated lines by words: groups of near copies make rows by their lines, not by their pairs, however they are cut."""

import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from millrace.llm import line_dedup
from millrace.scratch import scratch_root


def removed(spark, rows, **sizes):
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), words=1, **sizes)
    return {r.doc_id: r.removed for r in got.collect()}


def by_pairs(rows):
    sets = [(i, k, set(x.split())) for i, t in sorted(rows) for k, x in enumerate(t.split("\n")) if x.split()]
    gone = {i: [] for i, _ in rows}
    for j, (i, k, s) in enumerate(sets):
        if any(100 * len(s & o) >= 75 * len(s | o) for _, _, o in sets[:j]):
            gone[i].append(k)
    return gone


def families(seed, size):
    """Lines near one another and, mostly, short of a match with the first of them; some long ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        lines = []
        for _ in range(rng.randint(1, 3)):
            kind, n = rng.randrange(4), rng.choice([3, 8, 20, 60, 200])
            words = [f"w{kind}x{k}" for k in range(n)]
            for _ in range(rng.randint(0, max(1, n // 6))):
                words[rng.randrange(n)] = f"v{rng.randrange(30)}"
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    return rows


def test_near_copies_make_no_rows_by_pairs(spark):
    root = scratch_root(spark).removeprefix("file:")
    before, shared = set(os.listdir(root)), [f"s{k}" for k in range(12)]
    rows = [(i, " ".join([*shared, f"own{i}" if i % 2 else f"both{i // 4}"])) for i in range(300)]  # any two match
    assert removed(spark, rows) == {i: [0] if i else [] for i in range(300)}
    made = {f: spark.read.parquet(f"{root}/{f}").count() for f in set(os.listdir(root)) - before}
    assert made and max(made.values()) <= 5 * len(rows), made


@pytest.mark.parametrize("pairs, sizes", [(500_000, {}), (7, {"part": 60}), (1, {"part": 300, "block": 40, "owner_bytes": 500})])
def test_lines_are_the_same_however_cut(spark, monkeypatch, pairs, sizes):
    monkeypatch.setattr(line_dedup, "PAIRS", pairs)
    monkeypatch.setattr(line_dedup, "MESSAGES", pairs)
    rows = families(5, 60)
    want = by_pairs(rows)
    assert any(want.values()) and removed(spark, rows, **sizes) == want


def test_signatures_never_rule_out_what_can_match():
    rng = np.random.default_rng(3)
    texts = []
    for n in [1, 3, 40, 41, 79, 80, 81, 161, 320, 330, 700]:
        words = [f"w{k}" for k in range(n)]
        texts += [" ".join(words), " ".join(words[: n - n // 7] + [f"o{n}x{k}" for k in range(int(rng.integers(n // 8 + 1)))])]
    (sets,) = line_dedup._line_sets(pa.array(texts))
    words = [set(sets.tokens[a : a + n].tolist()) for a, n in zip(sets.starts.tolist(), sets.n.tolist())]
    order = rng.permutation(len(words))
    signs = line_dedup._Signs(np.frombuffer(b"".join(sets.signs()[0]), np.uint64), sets.n, order)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(order)), np.arange(len(order))))
    apart = np.array([len(words[order[x]] ^ words[order[y]]) for x, y in zip(a.tolist(), b.tolist())])
    assert signs.within(a, b, apart).all()
    assert not signs.within(a, b, np.zeros(len(a), np.int64))[apart > 0].all()


@pytest.mark.parametrize("seed", range(4))
def test_earliest_in_a_component(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 60, 12) for _ in range(5)]
    sets = [np.unique(np.where(rng.random(12) < 0.15, rng.integers(0, 60, 12), base[k % 5])).astype(np.uint64) for k in range(150)]
    ids = rng.permutation(100)[rng.integers(0, 100, 150)]  # some twice: never each other's match
    comps = np.arange(150) % 5 // 2
    got = line_dedup.earliest_in_tile(pd.DataFrame({"id": ids, "comp": comps, "tokens": [s.tobytes() for s in sets]}))
    want = []
    for i, c, s in zip(ids.tolist(), comps.tolist(), sets):
        near = [j for j, d, o in zip(ids.tolist(), comps.tolist(), sets) if c == d and j < i and 100 * len(np.intersect1d(s, o)) >= 75 * len(np.union1d(s, o))]
        want += [(i, min(near))] if near else []
    assert sorted(zip(got["id"].tolist(), got["first"].tolist())) == sorted(want) and want
