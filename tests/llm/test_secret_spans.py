"""Entropy spans of the secret scan against brute force, and texts that a backtracking scan would not survive."""

from __future__ import annotations

import base64
import collections
import math
import random
import re

from dpspark.llm import secrets

WORDS = ("example", "sample", "dummy", "placeholder", "changeme", "xxxx")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def candidates(t: str) -> list[tuple[int, int]]:
    """Maximal runs of parts between separators, without the parts that begin or end with an example word; 20 characters or more."""
    out = []
    for run in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
        kept, at = [], run.start()
        for part in re.findall(r"[A-Za-z0-9]+|[+/_=-]+", run[0]):
            low = part.lower()
            if part[0].isalnum() and (low.startswith(WORDS) or low.endswith(WORDS)):
                kept.append([])
            else:
                kept = kept or [[]]
                kept[-1] += [(at, at + len(part))]
            at += len(part)
        out += [(k[0][0], k[-1][1]) for k in kept if k]
    return [(a, b) for a, b in out if b - a >= 20]


def allowed(c: str) -> bool:
    """Words and numbers joined by separators, UUIDs, a short piece again and again."""
    parts = re.split(r"[-_/+=]", c)
    if parts[0] and all(p == "" or p.isalpha() or p.isdigit() for p in parts):
        return True
    if UUID.fullmatch(c):
        return True
    return any(len(c) - n * (k := next(k for k in range(len(c) // n + 1) if c[k * n : k * n + n] != c[:n] or (k + 1) * n > len(c))) <= 4 and k >= 3 for n in range(1, 5))


def brute(t: str) -> list[str]:
    out = []
    for a, b in candidates(t):
        c = t[a:b]
        if not (re.search("[0-9]", c) and re.search("[A-Za-z]", c)) or allowed(c):
            continue
        least = 3.0 if re.fullmatch("[0-9a-fA-F]+", c) else 3.5 if re.fullmatch("[0-9a-z+/_=-]+|[0-9A-Z+/_=-]+", c) else 3.7
        spans: list[list[int]] = []
        for i in range(len(c) - 19):
            n = collections.Counter(c[i : i + 20]).values()
            if -sum(x / 20 * math.log2(x / 20) for x in n) >= least - 1e-9:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + 20
                else:
                    spans.append([i, i + 20])
        out += [f"entropy:{a + x}:{a + y}" for x, y in spans]
    return out


def entropies(spark, rows: list[tuple[int, str]]) -> dict[int, list[str]]:
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("entropy")] for r in secrets.scan(df).collect()}


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    got = entropies(spark, rows)
    assert got == {i: brute(t) for i, t in rows} and any(got.values())


def test_random_candidates(spark):
    rng = random.Random(11)
    pieces = ["abc", "-", "_", "/", "=", "+", "example", "SAMPLE", "xxxx", "0123", "deadbeef", " ", "é", "123e4567-e89b-12d3-a456-426614174000", "abab", "Zq3sampleX9v", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = []
    for i in range(1000):
        t = ""
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            t += rng.choice(pieces) if kind < 0.4 else "".join(rng.choice(rng.choice(["0123456789abcdef", "abcdefghij0123456789", "ABCxyz0189+/", "".join(map(chr, range(48, 123)))])) for _ in range(rng.randint(1, 40)))
        rows.append((i, t))
    rows.append((1000, "".join(rng.choice("aB3x") + rng.choice("yzQ7") * rng.randint(1, 14) for _ in range(500))))
    rows.append((1001, "".join("a" * rng.randint(20, 60) + base64.b64encode(rng.randbytes(18)).decode() for _ in range(80))))
    got, want = entropies(spark, rows), {i: brute(t) for i, t in rows}
    assert got == want and sum(map(bool, got.values())) > 300


def test_words_inside_a_secret(spark):
    got = entropies(spark, [(1, "key=Zq3sampleX9vB2nM7kLpR4tYw8"), (2, "docs/sample-app/key=aB3dE5gH7jK9mN1pQ3sT5vW7yZ"), (3, "sampleX9vB2nM7kLpR4tYw8Zq3"), (4, "Q" * 70 + "example" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ")])
    assert got[1] and got[2] and not got[3] and got[4]


def test_very_long_candidates(spark):
    """10 MB of slugs, 10 MB of one lower-case run (a class test a character would be quadratic), 1 MB of Base64: no stack, linear time."""
    text = base64.b64encode(random.Random(3).randbytes(750_000)).decode()
    got = entropies(spark, [(1, "abc-123-" * (10 << 17)), (2, "a1" * (5 << 20)), (3, text), (4, "x" + text[:50_000].lower())])
    assert not got[1] and not got[2]
    covered = sum(int(x.split(":")[2]) - int(x.split(":")[1]) for x in got[3])
    assert covered > 0.99 * len(text)
    assert got[3][:1] == brute(text[: int(got[3][0].split(":")[2]) + 40])[:1]
