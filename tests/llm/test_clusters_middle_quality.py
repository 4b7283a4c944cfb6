"""Centroid clusters, fill-in-middle and the quality classifier against brute force and SQL, on small and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dpspark.llm import centroids, middle, quality, queries
from dpspark.llm.common import table
from dpspark.llm.words import SPACES, words
from tests.conftest import same
from tests.llm.test_operators import LONG, docs, empty, odd, prose  # noqa: F401

VECTORS = "vec_id long, embedding array<double>"


def by_hand(rows: list[tuple], k: int, rounds: int, dim: int, seed: int = 3) -> list[tuple]:
    """The clusters by Python integers alone."""
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in fine]
    order = sorted(range(len(ints)), key=lambda j: ((0, hashlib.sha256(f"{seed}:{ints[j][0]}".encode()).hexdigest()) if ints[j][0] is not None else (1, ""), fine[j][1]))
    centres = [ints[j][1] for j in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in ints]
        for n in range(len(centres)):
            mine = [v for (_, v), o in zip(ints, own) if o == n]
            if mine:
                centres[n] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in ints]
    inertia = [sum(d for _, d, n in found if n == c) for c in range(len(centres))]

    def long(x):
        return x if x < 1 << 63 else None

    return sorted((repr(i), n, long(d), long(inertia[n]), long(sum(inertia)), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found)


def found(spark, rows, k=3, rounds=4, dim=3) -> list[tuple]:
    out = centroids.cluster(spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit("own"), "data": F.lit(1), "ids": F.lit(2)}), k, rounds, dim)
    return sorted((repr(r["vec_id"]), *r[1:]) for r in out.collect())


def test_clusters_sql(spark, sf_dir, duck):
    assert same(queries.op11_centroid_clusters(spark, sf_dir).toPandas(), duck.execute(centroids.SQL).df())


@pytest.mark.parametrize("size", [1.0, 3e3, 1e5, 1e9, 1e18, 1e200, 1e306])
def test_clusters_of_every_size(spark, size):
    """Products, 64-bit and Python integers give what integers by hand give; near ties included."""
    rng = random.Random(5)
    rows = [(i, [rng.choice((1, 1, 1, size)) * rng.choice((rng.uniform(-1, 1), 0.5)) for _ in range(3)]) for i in range(40)]
    assert found(spark, rows) == by_hand(rows, 3, 4, 3)


def test_clusters_odd(spark):
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [1.0, 2.0, 3.0, 4.0]),
            (8, [0.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.0]), (8, [5.0, 0.0, -0.0]), (None, [1.0, 1.0, 1.0]), (None, [-1.0, -2.5, 1e-9]), (9, [-0.0005, 0.0, 3.0]), (10, [2.0, 2.0, 2.0])]
    assert found(spark, rows) == by_hand(rows, 3, 4, 3) and len(found(spark, rows)) == 7
    # fewer vectors than centroids, ties, none at all
    assert found(spark, rows[7:9], k=5) == by_hand(rows[7:9], 5, 4, 3)
    assert found(spark, rows[:7]) == [] and found(spark, []) == []


def test_exact_bounds():
    """The products' bound is where float64 sums are still integers; at it products and Python integers agree."""
    for dim in (1, 3, 64, 1000):
        m = centroids.bound(dim, 1 << 53)
        assert 4 * dim * m * m < 1 << 53
        x = np.array([[m] * dim, [-m] * dim, [m - 1] + [m] * (dim - 1)], float)
        assert (centroids.by_product(x, x) == centroids.by_integers(x.astype(object).astype(int).astype(object), x.astype(object).astype(int).astype(object)).astype(np.int64)).all()


def test_a_distant_centroid_keeps_others_on_products(monkeypatch):
    """One vector beyond any bound becomes a centroid; the others don't go to Python's integers for it."""
    sizes = []
    monkeypatch.setattr(centroids, "by_integers", lambda x, c, f=centroids.by_integers: sizes.append(len(x)) or f(x, c))
    block = np.vstack([np.random.default_rng(1).normal(size=(50, 4)), [[1e30] * 4]])
    centres = centroids.integers(block[[0, 1, 50]]).tolist()
    got = np.zeros(51, int)
    for at, near in centroids.nearest(block, centres):
        got[at] = near.cluster
    exact = centroids.by_integers(centroids.integers(block), np.array(centres, object))
    assert got.tolist() == [min(range(3), key=row.__getitem__) for row in exact.tolist()] and sizes[0] == 1


def test_sums_pass_longs():
    total = centroids.Sums.zero(1, 1)
    block = np.array([[2.0**61 / 1024]] * 40)
    for _ in range(2):
        total.add(block.tobytes(), [[0]], 1024)
    both = total.merge(total)
    assert both.n[0] == 160 and both.total[0][0] == 160 * 2**61 and both.inertia[0] == 160 * 2**122


def lines(t: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+", t)


def middled(doc_id, t: str) -> tuple:
    u = lines(t)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return len(u), "plain", None, None, t
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middle_sql(spark, sf_dir, duck):
    got = queries.op12_fill_in_middle(spark, sf_dir).toPandas()
    assert same(got, duck.execute(middle.SQL).df()) and set(got["form"]) >= {"psm", "spm", "plain"} - ({"plain"} if (got["form"] != "plain").all() else set())


def test_middle_odd(spark, odd):  # noqa: F811
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab\n<PSM>é𝕏 \r \x85") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    more = [(100 + i, t) for i, t in enumerate(texts)] + [(900, "x" * 3_000_000), (901, "\n" * 200_000), (902, "a <P> b"), (903, "<S"), (904, "<P\n>"), (905, "tail<\n<\n<S\nM>")]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    for doc_id, text, n, form, prefix, mid, output, back in (
        middle.fill_in_middle(rows.withColumns({"n": F.lit(1), "output": F.lit(2), "form": F.lit(3)})).withColumn("back", middle.restored(F.col("output"), F.col("form")))
        .join(rows.withColumnRenamed("text", "t").distinct(), "doc_id").select("doc_id", "t", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    ):
        assert back == (text or "") and (n, form, prefix, mid, output) == middled(doc_id, text or "")
    assert middle.fill_in_middle(rows).count() == rows.count()
    none = {r["output"]: r for r in middle.fill_in_middle(rows.where("doc_id IS NULL")).collect()}
    assert none[""]["form"] == "plain" and none[middled(None, "no id at all")[4]]["n"] == 1
    assert middle.digest(middle.fill_in_middle(empty(rows))).count() == 0


def test_middle_rates(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    share = dict(middle.fill_in_middle(rows, seed=9, rate=40, spm=25).groupBy("form").count().collect())
    assert abs(share["plain"] - 2400) < 200 and abs(share["spm"] - 400) < 100


# quality


def test_gradient_is_the_loss_slope():
    rng = np.random.default_rng(3)
    x, first, y = rng.integers(0, 255, (9, quality.WIDTH)).astype(np.uint8), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    weights = quality.Weights.new(0.7, 1)

    def loss(flat):
        w = quality.Weights(flat)
        p = quality.attention(w, quality.layer(w, x), first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = quality.gradient(weights, x, first, y)
    for at in [*rng.choice(len(g), 60, replace=False), *range(len(g) - 200, len(g), 7), len(g) - 1]:
        step = np.zeros(len(g))
        step[at] = 1e-4
        assert abs((loss(weights.flat + step) - loss(weights.flat - step)) / 2e-4 - g[at]) < 1e-5


def test_attention_is_a_weighted_mean():
    weights, h = quality.Weights.new(0.5, 2), np.random.default_rng(0).normal(size=(7, quality.HIDDEN))
    f = quality.attention(weights, h, np.array([0, 3]))
    for a, b, bag in ((0, 3, 0), (3, 7, 1)):
        e = [(np.tanh(h[i] @ weights.of("v")) / (1 + np.exp(-(h[i] @ weights.of("u"))))) @ weights.of("w") for i in range(a, b)]
        soft = np.exp(e) / np.exp(e).sum()
        assert np.allclose(f["a"][a:b], soft) and np.allclose(f["z"][bag], soft @ h[a:b])


def brute_features(t: str) -> list[list[int]]:
    """Passages of one text, word by word and byte by byte."""
    w = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())]
    low = [x[2].lower() for x in w]
    data, kinds, out, tri = t.encode(), len(quality.KINDS), [], {}
    for i in range(len(low) - 2):
        tri.setdefault(tuple(low[i : i + 3]), i)
    kind = lambda b: next((k for k, own in enumerate(quality.KINDS) if b in own), kinds)
    cuts = list(range(0, len(w), quality.PASSAGE)) or [0]
    hashes = words(pa.array([t]), SPACES).hash.tolist()
    for c in cuts:
        own = range(c, min(c + quality.PASSAGE, len(w)))
        row, n = np.zeros(quality.WIDTH), max(len(own), 1)
        if len(own):
            end = w[own[-1] + 1][0] if own[-1] + 1 < len(w) else len(data)
            span = data[w[c][0] : end]
            for x, y in zip(span, span[1:]):
                row[kind(x) * (kinds + 1) + kind(y)] += 1 / (len(span) - 1)
            for i in own:
                row[quality.PAIRS + hashes[i] % quality.BUCKETS] += 1 / n
            row = np.sqrt(row)
            size = [w[i][1] - w[i][0] for i in own]
            times = [sum(low[j] == low[i] for j in own) for i in own]
            first = [w[i][2][0] for i in own]
            row[quality.PAIRS + quality.BUCKETS :] = [
                1, math.log1p(n) / math.log1p(quality.PASSAGE), sum(min(s, 40) / 40 for s in size) / n, sum(s > 20 for s in size) / n, sum(s <= 2 for s in size) / n,
                sum(65 <= b <= 90 for b in first) / n, sum(48 <= b <= 57 for b in first) / n, sum(i > 0 and low[i] == low[i - 1] for i in own) / n,
                sum(i + 2 < len(low) and tri[tuple(low[i : i + 3])] != i for i in own) / n, len({low[i] for i in own}) / n, max(times) / n, min(len(span), 4096) / 4096,
            ]
        out.append(np.round(row * 255).astype(int).tolist())
    return out


def test_passages_are_encoded_whole(monkeypatch):
    monkeypatch.setattr(quality, "AT_ONCE", 3)
    texts = [prose(1, 200), "", "  \n ", "One  two\nTHREE 3", prose(2, 64), "a a a b a a a", "é" * 5000 + " ¡x! | y ###", " lead " + prose(3, 500) + " tail \n"]
    w = words(pa.array(texts), SPACES)
    got = np.concatenate([*quality.encoded(w)]).astype(int)
    want = [row for t in texts for row in brute_features(t)]
    assert quality.passages(w)[1].tolist() == [max(1, -(-len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) // 64)) for t in texts]
    assert np.abs(got - np.array(want)).max() <= 1


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op13_quality(spark, d).toPandas()
    assert sorted(got["doc_id"]) == sorted(r[0] for r in table(spark, d, "documents").select("doc_id").collect())
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    both = got.merge(table(spark, d, "labels").toPandas(), on="doc_id").query("held_out")
    assert (both.query("quality == 1")["predicted"] == 1).mean() >= 0.97 and (both.query("quality == 0")["predicted"] == 0).mean() >= 0.8


def test_held_out_labels_are_not_read(spark, sf_dir):
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    other = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(None))
    renamed = d.withColumns({"lang": F.lit("?"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0)})
    a, b = (quality.rated(x, y).toPandas().sort_values("doc_id", ignore_index=True) for x, y in ((d, marks), (renamed.repartition(7), other)))
    assert np.allclose(a["score"], b["score"], atol=1e-9)


def test_attention_finds_the_bad_passage(spark):
    """One passage of junk in a long good document is where the weight is, though only documents are labelled."""
    rng = random.Random(4)
    junk = " ".join(rng.choice(("buy!!", "###", "NOW!!", "$$$")) for _ in range(64))
    rows = []
    for i in range(300):
        parts = [prose(1000 + 10 * i + j, 64) for j in range(6)]
        if i % 3 == 0:
            parts[rng.randrange(6)] = junk
        rows.append((i, " ".join(parts), int(i % 3 != 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r["doc_id"]: r for r in quality.score(df, quality.fit(df.where("doc_id < 200"), df.select("doc_id", "quality"))).collect()}
    bad = [i for i in range(200, 300) if i % 3 == 0]
    assert all((got[i]["score"] < 0.3) == (i % 3 == 0) for i in range(200, 300))
    assert sum(rows[i][1].split()[64 * got[i]["weightiest"]] in junk.split() for i in bad) >= 0.9 * len(bad)


def test_quality_odd(spark, odd):  # noqa: F811
    labels = spark.createDataFrame([(3, 0), (4, 1), (7, 1), (8, 1), (9, 0), (None, 1), (5, None), (6, 7), (77, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model).toPandas()
    assert len(got) == odd.count() and got["score"].between(0, 1).all() and got["weight"].between(0, 1).all()
    blank = got[got["doc_id"].isin([1, 2, 3])]["score"]
    assert blank.nunique() == 1 and got[got["doc_id"] == 4]["score"].nunique() == 1
    assert got[got["doc_id"] == 5]["n_passages"].iloc[0] == -(-len(LONG.split()) // 64)
    assert quality.rated(empty(odd), labels).count() == 0
    # labels of one class, or none; 7 and 8 have one text
    assert set(quality.score(odd, quality.fit(odd, labels.where("quality = 1"))).toPandas()["score"]) == {(2 + 0.5) / 3}
    assert set(quality.score(odd, quality.fit(odd, empty(labels))).toPandas()["score"]) == {0.5}
