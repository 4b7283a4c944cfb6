"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, of which only the bag has a label. Every
passage of the whole text is encoded: shares of pairs of character classes, of
hashed words, and densities (repeats, capitals, distinct words ...) go through a
learned layer. Gated attention gives each passage its weight, the weighted mean
of the encodings represents the document, and a logistic unit scores it; layer,
gates and unit are learned together from the documents' labels.

Learning runs as Spark jobs: encoded passages of a bounded sample of labelled
documents are written once; in each round every shard takes gradient steps from
the common weights, and the shards' weights are averaged. Shards and the order
in them go by hashes of ids, so a lost task comes out alike when it is run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import shared_dir, text_rows, written
from dpspark.llm.words import SPACES, Words, chunks, mix, runs, words

#: Words of a passage; passages that are encoded at once.
PASSAGE, AT_ONCE = 64, 4096
#: Labelled documents that are learnt from at most, and those of a shard.
MAX_LABELLED, SHARD, SHARDS_MOST = 8_000, 500, 16
ROUNDS, STEPS, BATCH, RATE, DECAY = 6, 120, 32, 0.02, 1e-4
HIDDEN, GATES, BUCKETS = 24, 12, 128
THRESHOLD = 0.3
_U = np.uint64

#: Character classes that stand side by side in pairs; bytes of none are one class more.
KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:?", b"'\"()[]{}", b"!", b"|", b"#", b"$%&*@^~`", b"-_/\\+=<>", bytes(range(128, 256)))
CLASS = np.full(256, len(KINDS), np.int64)
for _k, _bytes in enumerate(KINDS):
    CLASS[list(_bytes)] = _k
PAIRS = (len(KINDS) + 1) ** 2
DENSITIES = 12
WIDTH = PAIRS + BUCKETS + DENSITIES


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each passage and one more at the end, passages of each text); a text without words has one without any."""
    n = np.diff(w.first)
    each = np.maximum(1, -(-n // PASSAGE))
    text = np.repeat(np.arange(len(n)), each)
    place = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    return np.append(np.minimum(w.first[text] + place * PASSAGE, w.first[text + 1]), len(w.hash)), each


def _repeats(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word: is it the one before it; do it and the next two occur earlier in its text."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    three, at = runs(w.hash, w.first, 3)
    _, lead = np.unique(three ^ mix(text[at].astype(_U)), return_index=True)
    seen = np.zeros(len(w.hash), bool)
    seen[at] = True
    seen[at[lead]] = False
    return again, seen


def encoded(w: Words) -> Iterator[np.ndarray]:
    """Features of the passages as bytes (a share of 1 is 255), AT_ONCE passages at a time."""
    first, each = passages(w)
    again, seen = _repeats(w)
    kind = CLASS[w.data]
    size = w.end - w.start
    capital, digit = (np.isin(kind[w.start], k) if len(w.hash) else np.zeros(0, bool) for k in (1, 2))
    text = np.repeat(np.arange(len(each)), each)
    begin = np.append(w.start, len(w.data))[first]
    # a passage's bytes end with its text's
    begin, finish = begin[:-1], np.minimum(begin[1:], w.offsets[text + 1])
    for lo in range(0, len(text), AT_ONCE):
        hi = min(lo + AT_ONCE, len(text))
        out = np.zeros((hi - lo, WIDTH), np.float32)
        a, b = begin[lo:hi], np.maximum(begin[lo:hi], finish[lo:hi])
        part = np.repeat(np.arange(hi - lo), b - a)
        at = np.arange(len(part)) + np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a)
        if len(at):
            pair = kind[at[:-1]] * (len(KINDS) + 1) + kind[at[1:]]
            same = part[1:] == part[:-1]
            counts = np.bincount(part[:-1][same] * PAIRS + pair[same], minlength=(hi - lo) * PAIRS).reshape(-1, PAIRS)
            out[:, :PAIRS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        s, e = first[lo], first[hi]
        n = np.diff(first[lo : hi + 1])
        of = np.repeat(np.arange(hi - lo), n)
        some = np.maximum(n, 1)
        bucket = (w.hash[s:e] % _U(BUCKETS)).astype(np.int64)
        out[:, PAIRS : PAIRS + BUCKETS] = np.sqrt(np.bincount(of * BUCKETS + bucket, minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS) / some[:, None])

        def share(x: np.ndarray, of=of, some=some, k=hi - lo) -> np.ndarray:
            return np.bincount(of, x, minlength=k) / some

        # words of a passage by (passage, hash)
        order = np.lexsort((w.hash[s:e], of))
        new = np.ones(len(order), bool)
        new[1:] = (w.hash[s:e][order][1:] != w.hash[s:e][order][:-1]) | (of[order][1:] != of[order][:-1])
        lead = np.flatnonzero(new)
        times, top = np.diff(np.append(lead, len(order))), np.zeros(hi - lo)
        np.maximum.at(top, of[order][lead], times)
        length = size[s:e].astype(float)
        d = out[:, PAIRS + BUCKETS :]
        for k, x in enumerate((
            n > 0, np.log1p(n) / np.log1p(PASSAGE), share(np.minimum(length, 40) / 40), share(length > 20), share(length <= 2), share(capital[s:e]),
            share(digit[s:e]), share(again[s:e]), share(seen[s:e]), np.bincount(of[order][lead], minlength=hi - lo) / some, top / some, np.minimum(b - a, 1 << 12) / (1 << 12),
        )):
            d[:, k] = x
        yield np.round(out * 255).astype(np.uint8)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents with their encoded passages."""
    for batch in batches:
        for part in chunks(batch):
            w = words(part["text"])
            x = np.concatenate([*encoded(w)])
            cut = np.append(0, np.cumsum(passages(w)[1]))
            data = [x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part["shard"], part["turn"], part["good"], pa.array(data, pa.binary())], names=["shard", "turn", "good", "data"])


@dataclass
class Weights:
    """The parts of one vector of parameters."""

    flat: np.ndarray

    SHAPES = {"layer": (WIDTH, HIDDEN), "bias": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "w": (GATES,), "unit": (HIDDEN,), "offset": (1,)}

    @classmethod
    def new(cls, rate: float, seed: int = 0) -> Weights:
        """Small random weights, with the offset of a text of which nothing is known."""
        rng = np.random.default_rng(seed)
        parts = [rng.normal(0, (2.0 / shape[0]) ** 0.5 if len(shape) == 2 else 0.3, shape) for shape in cls.SHAPES.values()]
        out = cls(np.concatenate([p.reshape(-1) for p in parts]))
        out.of("bias")[:], out.of("offset")[:] = 0.0, np.log(rate / (1 - rate))
        return out

    def of(self, name: str) -> np.ndarray:
        at = 0
        for k, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            if k == name:
                return self.flat[at : at + n].reshape(shape)
            at += n
        raise KeyError(name)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def layer(weights: Weights, x: np.ndarray) -> np.ndarray:
    """Encodings of passages x WIDTH features, given as bytes."""
    return np.tanh((x.astype(np.float32) / 255) @ weights.of("layer") + weights.of("bias"))


def attention(weights: Weights, h: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """p: each bag's score; a: each passage's attention; h: encodings of passages; first: each bag's first passage."""
    size = np.diff(np.append(first, len(h)))
    t, g = np.tanh(h @ weights.of("v")), _sigmoid(h @ weights.of("u"))
    e = (t * g) @ weights.of("w")
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    a = e / np.repeat(np.add.reduceat(e, first), size)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"t": t, "g": g, "a": a, "z": z, "size": size, "p": _sigmoid(z @ weights.of("unit") + weights.of("offset"))}


def gradient(weights: Weights, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the mean log loss of bags with labels ``y``, by all parameters."""
    h, out = layer(weights, x), Weights(np.zeros_like(weights.flat))
    f = attention(weights, h, first)
    ds = (f["p"] - y) / len(y)
    out.of("unit")[:], out.of("offset")[:] = f["z"].T @ ds, ds.sum()
    dz = np.repeat(ds[:, None] * weights.of("unit"), f["size"], axis=0)
    da = (dz * h).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["size"]))
    out.of("w")[:] = (f["t"] * f["g"]).T @ de
    both = de[:, None] * weights.of("w")
    dt, dg = both * f["g"] * (1 - f["t"] ** 2), both * f["t"] * f["g"] * (1 - f["g"])
    out.of("v")[:], out.of("u")[:] = h.T @ dt, h.T @ dg
    dh = (f["a"][:, None] * dz + dt @ weights.of("v").T + dg @ weights.of("u").T) * (1 - h**2)
    out.of("layer")[:], out.of("bias")[:] = x.astype(np.float32).T @ dh / 255, dh.sum(axis=0)
    return out.flat


def steps(flat: np.ndarray, bags: list[np.ndarray], y: np.ndarray, seed: int, rate: float) -> np.ndarray:
    """STEPS of Adam on random batches of bags, from ``flat`` on."""
    weights, rng = Weights(flat.copy()), np.random.default_rng(seed)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for k in range(1, STEPS + 1):
        pick = rng.choice(len(bags), min(BATCH, len(bags)), replace=False)
        size = np.array([len(bags[i]) for i in pick])
        x = np.concatenate([bags[i] for i in pick])
        g = gradient(weights, x, np.append(0, np.cumsum(size)[:-1]), y[pick]) + DECAY * weights.flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights.flat -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return weights.flat


def _round(flat: np.ndarray, number: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        bags = [np.frombuffer(d, np.uint8).reshape(-1, WIDTH) for d in rows["data"]]
        moved = steps(flat, bags, rows["good"].to_numpy(float), 1000 * number + int(rows["shard"].iloc[0]), RATE / (1 + number))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "n": [len(rows)], "weights": [moved.tobytes()]})

    return run


@dataclass
class Model:
    """weights: None where one class, or none, is labelled; every text then has ``rate``."""

    weights: Weights | None
    rate: float = 0.5


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels`` (doc_id, quality 0 or 1) on ``docs``.

    At most ``MAX_LABELLED`` labelled documents (by the hash of their id) are
    learnt from; of equal texts with equal labels one. Of an id with both labels the better counts.
    """
    folder = shared_dir(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id IS NOT NULL AND good IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = text_rows(docs).join(F.broadcast(marked), "doc_id")
    same = rows.groupBy(F.sha2("text", 256).alias("digest"), "good").agg(F.min("doc_id").alias("doc_id"))
    chosen = written(same.groupBy("doc_id").agg(F.max("good").alias("good")), folder, "chosen")
    found = {r["good"]: r["count"] for r in chosen.groupBy("good").count().collect()}
    n = sum(found.values())
    if len(found) < 2:
        return Model(None, (found.get(1, 0) + 0.5) / (n + 1.0))
    shards = max(1, min(SHARDS_MOST, n // SHARD))
    turn = F.xxhash64("doc_id", F.lit(13))
    dealt = text_rows(docs).join(F.broadcast(chosen), "doc_id").select("text", "good", F.pmod(turn, F.lit(shards)).cast("int").alias("shard"), turn.alias("turn"))
    bags = written(dealt.mapInArrow(_bags, "shard int, turn long, good int, data binary"), folder, "bags")
    weights = Weights.new((found[1] + 0.5) / (n + 1.0))
    for k in range(ROUNDS):
        moved = bags.groupBy("shard").applyInPandas(_round(weights.flat, k), "shard int, n long, weights binary").toPandas().sort_values("shard")
        weights = Weights(np.average([np.frombuffer(w, float) for w in moved["weights"]], axis=0, weights=moved["n"]))
    return Model(weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each text's quality: doc_id, score (0 to 1), n_passages, weightiest (that passage's number), weight (its attention).

    A null, empty or blank text is one passage without words. Repeated rows and
    null ids are scored row by row, equal texts alike; other columns are ignored;
    an empty table gives no row. Very long texts are encoded a few passages at a time.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", "n_passages", "weightiest", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in chunks(batch):
                w = words(part["text"])
                each = passages(w)[1]
                first = np.append(0, np.cumsum(each)[:-1])
                if m.weights is None:
                    p, a = np.full(len(part), m.rate), np.repeat(1.0 / each, each)
                else:
                    f = attention(m.weights, np.concatenate([layer(m.weights, x) for x in encoded(w)]), first)
                    p, a = f["p"], f["a"]
                top = np.array([int(a[s : s + k].argmax()) for s, k in zip(first, each, strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(p, pa.float64()), pa.array(each, pa.int64()), pa.array(top), pa.array(a[first + top], pa.float64())], names=names)

    return text_rows(docs).mapInArrow(run, "doc_id long, score double, n_passages long, weightiest long, weight double")


def held_out(doc_id):
    """Rows whose labels are kept for the test."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every text's score by a model that learns from the labels of rows that are not held out, and whether it is kept."""
    out = score(docs, fit(docs, labels.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "weightiest", "weight")
