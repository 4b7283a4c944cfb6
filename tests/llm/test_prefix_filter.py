"""The filter of large keys in near-duplicate detection: it keeps every pair that is similar, and drops what shares a passage only."""

from __future__ import annotations

import random

import pytest

from dpspark.llm import neardup


@pytest.mark.parametrize("counters", [4, 18])
def test_no_similar_pair_is_lost(spark, monkeypatch, counters):
    monkeypatch.setattr(neardup, "COUNTERS", counters)
    rng = random.Random(6)
    new = lambda: rng.getrandbits(63) - (1 << 62)
    passage, base = [new() for _ in range(40)], [new() for _ in range(60)]
    rows = []
    for i in range(60):
        rows.append((1, i, sorted({*passage, *(new() for _ in range(50))})))
    for i in range(60, 140):
        own = base[:]
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(60)] = new()
        rows.append((1 + i % 2, i, sorted(set(own))))
    rows += [(3, 200, [5]), (3, 201, [5]), (3, 202, [7]), (4, 203, [5])]
    df = spark.createDataFrame([(g, n, s) for g, n, s in rows], "group long, node long, shingles array<long>")
    kept = {(r["group"], r["node"]) for r in neardup._with_rare_shingle(df.select("group", "node"), df.select("node", "shingles"), 80).collect()}
    similar = set()
    for g, n, s in rows:
        for h, m, t in rows:
            if g == h and n < m and len(set(s) & set(t)) * 100 >= 80 * len(set(s) | set(t)):
                similar |= {(g, n), (h, m)}
    assert similar <= kept and {(3, 200), (3, 201)} <= kept
    if counters == 18:
        assert not {(1, i) for i in range(60)} & kept and (3, 202) not in kept and (4, 203) not in kept


def test_an_empty_group(spark):
    df = spark.createDataFrame([], "group long, node long, shingles array<long>")
    assert neardup._with_rare_shingle(df.select("group", "node"), df.select("node", "shingles"), 80).count() == 0
