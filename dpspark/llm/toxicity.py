"""Toxic passages: maximum-scoring segments over token log-odds.

A word is known by itself and by its beginnings of four to eight bytes, so that
inflected and made-up words of a kind count together. For each such token the
log-odds between toxic and clean labelled texts are smoothed by a Dirichlet
prior, whose mean is the token's share of all texts. A word scores the log-odds,
of either sign, of its most significant token; words without such a token make
up one category, whose log-odds they score. Every maximal segment of a text is
found in one pass; by extreme-value theory its score gives how many segments as
good chance would bring to a text of this length, and all that are better than
chance are put together by the law of their sum. A logistic curve that allows
for wrong labels turns this into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import shared_dir, text_rows, written
from dpspark.llm.neardup import shingle_sets
from dpspark.llm.words import PUNCT, Words, chunks, mix, powers, words

BEGINNINGS = (4, 5, 6, 7, 8)
#: Labelled rows that are learnt from at most, and parts of these that are scored by a model of the others.
MAX_LABELLED, FOLDS = 50_000, 4
LEAST_COUNT, LEAST_Z, PRIOR = 3, 4.0, 0.02
#: What log-odds may owe to topics and languages, of which one class happens to have more: drawn in by this much.
DOUBT = 1.0
#: Of MINIMA least shingles a copy has SAME in common with one earlier text.
MINIMA, SAME = 8, 5
#: A segment needs words that count against it: this much at least.
LEAST_REST = -0.002
SIGNIFICANT = 0.01
LEVELS, LAMBDAS = np.arange(2.0, 9.0), np.linspace(0.02, 1.0, 50)
THRESHOLD = 0.7
_U = np.uint64


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words x tokens, for each word its row); 0 where a word is too short."""
    _, lead, row = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[lead], w.end[lead] - w.start[lead]
    out = np.zeros((len(lead), len(BEGINNINGS) + 1), _U)
    out[:, -1] = w.hash[lead] | _U(1)
    if len(lead):
        part, done, p = np.zeros(len(lead), _U), 0, powers(max(BEGINNINGS) + 1)
        last = max(len(w.data) - 1, 0)
        for j, n in enumerate(BEGINNINGS):
            for k in range(done, n):
                part = part + (w.data[np.minimum(start + k, last)].astype(_U) + _U(1)) * p[k]
            done = n
            out[:, j] = np.where(size >= n, mix(part + _U(n)) | _U(1), _U(0))
    return out, row.reshape(-1)


def _words(batch: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    """The words of the texts in lower case, and for each byte of these the code points before it."""
    w = words(pc.utf8_lower(batch["text"]), PUNCT, lower=False)
    return w, np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MINIMA of each text's shingles, which copies and near copies share."""
    for batch in batches:
        for part in chunks(batch):
            least = [[int(mix(s ^ _U(j << 32)).min().astype(np.int64)) if len(s) else 0 for j in range(MINIMA)] for s in shingle_sets(part, 4)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "least"])


def _by_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        for fold in range(FOLDS):
            for part in chunks(batch.filter(pc.equal(batch["fold"], fold))):
                yield fold, part


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class that have a token, by fold; of token 0 all their words."""
    for fold, part in _by_fold(batches):
        w, _ = _words(part)
        seen, row = tokens(w)
        toxic = part["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(part)), np.diff(w.first))
        # a word counts once in a text: what one author repeats is no more evidence
        once = np.unique(text * np.int64(max(len(seen), 1)) + row)
        text, row = once // max(len(seen), 1), once % max(len(seen), 1)
        both = np.stack([np.bincount(row, toxic[text] == y, len(seen)) for y in (0, 1)], 1).astype(np.int64)
        token, at = np.unique(seen.reshape(-1), return_inverse=True)
        clean, bad = (np.bincount(at.reshape(-1), np.repeat(both[:, y], seen.shape[1]), len(token)).astype(np.int64) for y in (0, 1))
        if len(token) and token[0] == 0:  # all the words of either class, in place of the tokens that are not there
            clean[0], bad[0] = both.sum(axis=0)
        elif len(token):
            token, clean, bad = np.append(_U(0), token), np.append(both[:, 0].sum(), clean), np.append(both[:, 1].sum(), bad)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.full(len(token), fold)), pa.array(clean), pa.array(bad)], names=["token", "fold", "clean", "bad"])


def _corpus_counts(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            total = np.zeros(len(table) + 1, np.int64)
            for part in chunks(batch):
                w, _ = _words(part)
                seen, row = tokens(w)
                n = np.bincount(row, minlength=len(seen))
                at = np.minimum(np.searchsorted(table, seen), len(table) - 1)
                hit = table[at] == seen
                total[:-1] += np.bincount(at[hit], np.broadcast_to(n[:, None], seen.shape)[hit], len(table)).astype(np.int64)
                total[-1] += len(w.hash)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(table, _U(0)).view(np.int64)), pa.array(total)], names=["token", "n"])

    return run


@dataclass
class Model:
    """token, z, score: by token, sorted; rest: the score of a word without one; lam, k: of the extreme-value law; a, b: of the score."""

    token: np.ndarray
    z: np.ndarray
    score: np.ndarray
    rest: float = 0.0
    lam: float = 1.0
    k: float = 1.0
    a: float = 0.0
    b: float = 0.0
    fitted: bool = True

    def known(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(the score of each word's most significant token, its number among the text's words); NaN for a word without one."""
        if not len(w.hash) or not len(self.token):
            return np.full(len(w.hash), np.nan), np.zeros(len(w.hash), np.int64)
        seen, row = tokens(w)
        at = np.minimum(np.searchsorted(self.token, seen), len(self.token) - 1)
        z = np.where(self.token[at] == seen, np.abs(self.z[at]), 0.0)
        best = z.argmax(axis=1)
        pick = np.arange(len(seen)), best
        return np.where(z[pick] != 0, self.score[at[pick]], np.nan)[row], row

    def of_words(self, w: Words) -> np.ndarray:
        """A score for each word. The n-th time that a text has a toxic word counts an n-th."""
        out, row = self.known(w)
        out = np.where(np.isnan(out), self.rest, out)
        hit = np.flatnonzero(out > 0)
        text = np.searchsorted(w.first, hit, side="right")
        order = np.lexsort((hit, row[hit], text))
        new = np.append(True, (np.diff(row[hit][order]) != 0) | (np.diff(text[order]) != 0))[: len(order)]
        place = np.arange(len(order))
        out[hit[order]] /= place - np.maximum.accumulate(np.where(new, place, 0)) + 1
        return out

    def surprise(self, scores: list[float], n: int) -> float:
        """Minus the log of the chance of segments as good: of the best one, the best two, ... all that beat chance, by the law of their sum.

        For the sum t of the r best normalised scores that chance is about
        exp(-t) * t**(r-1) / (r! * (r-1)!); each further r costs a factor of 2
        for the choice of r.
        """
        x = self.lam * np.sort(np.asarray(scores, float))[::-1] - np.log(self.k * max(n, 1))
        if not len(x):
            return 0.0
        x = x[: max(1, int((x > 0).sum()))]
        r, total = np.arange(1, len(x) + 1), np.cumsum(x)
        logs = np.cumsum(np.log(r))
        chance = total - (r - 1) * np.log(np.maximum(total, 1e-9)) + logs + np.append(0.0, logs[:-1]) - np.log(2.0) * (r - 1)
        return max(0.0, float(chance.max()))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score), in one pass; only positive scores can begin one."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, end, left, right))
    return [(s, e, float(r - lo)) for s, e, lo, r in found]


def _rest(models):
    """Of labelled texts of either class: words, and those without a token of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2), np.int64)
        for fold, part in _by_fold(batches):
            w, _ = _words(part)
            known, _ = models.value[fold].known(w)
            of = np.repeat(part["toxic"].to_numpy(zero_copy_only=False).astype(np.int64), np.diff(w.first))
            total[:, 0] += np.bincount(of, minlength=2)
            total[:, 1] += np.bincount(of[np.isnan(known)], minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["toxic", "n", "unknown"])

    return run


def _tail(models):
    """Of clean texts: words, segments beyond each of LEVELS, and the sum of exp(lambda * score) of the words for each of LAMBDAS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, over, powers = 0, np.zeros(len(LEVELS), np.int64), np.zeros(len(LAMBDAS))
        for fold, part in _by_fold(batches):
            w, _ = _words(part)
            s = models.value[fold].of_words(w)
            n += len(s)
            values, often = np.unique(s, return_counts=True)
            powers += np.exp(np.outer(LAMBDAS, values)) @ often
            for a, b in zip(w.first, w.first[1:], strict=False):
                over += (np.array([x[2] for x in segments(s[a:b])])[:, None] >= LEVELS).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([over.tolist()], pa.list_(pa.int64())), pa.array([powers.tolist()], pa.list_(pa.float64()))], names=["n", "over", "powers"])

    return run


def extreme_values(n: int, over: np.ndarray, powers: np.ndarray) -> tuple[float, float]:
    """lambda and K of the chance K n exp(-lambda s) that n words of clean text have a segment of score s.

    lambda is where the mean of exp(lambda * score) over words is 1 again (1 for
    true log-odds, and at most that here); K is the largest that the segments
    beyond any of LEVELS ask for, of those levels that some segment reaches.
    """
    if not n:
        return 1.0, 1.0
    below = np.flatnonzero(powers / n <= 1.0)
    lam = float(LAMBDAS[below[-1]]) if len(below) else float(LAMBDAS[0])
    met = over > 0
    met[0] = True
    return lam, float(((over + 0.5) * np.exp(lam * LEVELS))[met].max() / n)


def _surprises(models):
    """Of labelled texts: doc_id, label, surprise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, part in _by_fold(batches):
            w, _ = _words(part)
            m = models.value[fold]
            s = m.of_words(w)
            x = [m.surprise([f[2] for f in segments(s[a:b])], int(b - a)) for a, b in zip(w.first, w.first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part["toxic"].cast(pa.int64()), pa.array(x, pa.float64())], names=["toxic", "x"])

    return run


def _scored(model):
    names = ["doc_id", "score", "n_words", "surprise", "passages"]
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in chunks(batch):
                w, points = _words(part)
                s, score, surprise, passages = m.of_words(w), [], [], []
                for i, (a, b) in enumerate(zip(w.first, w.first[1:], strict=False)):
                    found = segments(s[a:b])
                    n = int(b - a)
                    x = m.surprise([f[2] for f in found], n)
                    chance = [m.k * max(n, 1) * np.exp(-m.lam * f[2]) for f in found]
                    zero = points[w.offsets[i]]
                    passages.append([{"start": int(points[w.start[a + f[0]]] - zero), "end": int(points[w.end[a + f[1] - 1]] - zero), "score": f[2], "expected": float(c)} for f, c in zip(found, chance, strict=True) if c <= SIGNIFICANT])
                    surprise.append(float(x))
                    score.append(float(1 / (1 + np.exp(-np.clip(m.a + m.b * x, -700, 700)))) if m.fitted else 0.0)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(score, pa.float64()), pa.array(np.diff(w.first)), pa.array(surprise, pa.float64()), pa.array(passages, pa.list_(passage))], names=names)

    return run


def log_odds(bad, clean, corpus, n_bad: float, n_clean: float, n_corpus: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds, and how significant they are: the signed root of the likelihood ratio, which holds for small counts too.

    The prior weighs PRIOR of either class, so a token that no label has gets 0.
    """
    share = (corpus + 0.5) / (n_corpus + 0.5)
    a, b = bad + PRIOR * n_bad * share + 0.5 * n_bad / (n_bad + n_clean), clean + PRIOR * n_clean * share + 0.5 * n_clean / (n_bad + n_clean)
    return np.log(a / n_bad) - np.log(b / n_clean), signed_root(np, bad, clean, n_bad, n_clean)


def signed_root(of, bad, clean, n_bad: float, n_clean: float):
    """``of`` is numpy or pyspark.sql.functions."""
    total, rate = bad + clean, n_bad / (n_bad + n_clean)
    tiny = 1e-9
    g = 2 * (bad * of.log((bad + tiny) / (total * rate + tiny)) + clean * of.log((clean + tiny) / (total * (1 - rate) + tiny)))
    return of.sign(bad - total * rate) * of.sqrt(of.abs(g))


def _logistic(x: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of 1 and x for targets t by Newton's method, from w on."""
    m = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m.T * (p * (1 - p) + 1e-9)) @ m + 1e-3 * np.eye(2), m.T @ (p - t) + 1e-3 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the chance 1 / (1 + exp(-a - b x)) that a text is toxic, where labels may be wrong.

    Some labels say toxic of clean texts and clean of toxic ones, at rates that
    are found together with the curve by expectation maximisation: without them
    a few toxic labels on texts without any evidence would flatten it.
    """
    # one text of either class is added, a toxic one with as much evidence as the median toxic one
    x, y = np.append(x, [0.0, max(float(np.median(x[y == 1])), 1.0)]), np.append(y, [0, 1]).astype(float)
    scale = max(float(np.median(x[y == 1])), 1.0)
    x = np.minimum(x / scale, 20.0)
    up, down, w = 0.02, 0.02, _logistic(x, np.clip(y, 0.02, 0.98), np.zeros(2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x * w[1] + w[0], -30, 30)))
        given = np.where(y == 1, p * (1 - down) / (p * (1 - down) + (1 - p) * up), p * down / (p * down + (1 - p) * (1 - up)))
        # rates of wrong labels are below a quarter, with a prior of one in a hundred
        up_, down_ = (float(np.clip((a.sum() + 0.1) / (n.sum() + 10), 1e-4, 0.25)) for a, n in (((1 - given) * y, 1 - given), (given * (1 - y), given)))
        moved, (up, down), w = abs(up - up_) + abs(down - down_), (up_, down_), _logistic(x, given, w)
        if moved < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0) / scale)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels`` (doc_id, toxic 0 or 1) on ``docs``.

    At most ``MAX_LABELLED`` labelled rows (by the hash of their id) are learnt
    from; the prior's shares are counted over all of ``docs``. What is
    calibrated are scores of each fold's rows by the tokens of the other folds;
    the model's own tokens are those of all folds. Without labels of both
    classes every text's score is 0.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    none = Model(np.empty(0, _U), np.empty(0), np.empty(0), fitted=False)
    rows = text_rows(docs)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    seen = written(rows.join(F.broadcast(marked), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(FOLDS)).cast("int")), folder, "labelled")
    # of near copies one counts: words that only they share would seem significant
    least = seen.select("doc_id", "text").mapInArrow(_minima, "doc_id long, least array<long>").select("doc_id", F.posexplode("least").alias("j", "least"))
    first = least.groupBy("j", "least").agg(F.min("doc_id").alias("first"))
    copies = least.join(first, ["j", "least"]).where("doc_id <> first").groupBy("doc_id", "first").count().where(f"count >= {SAME}")
    seen = written(seen.join(F.broadcast(copies.select("doc_id").distinct()), "doc_id", "left_anti"), folder, "learnt")

    counts = seen.mapInArrow(_class_counts, "token long, fold long, clean long, bad long")
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in ("clean", "bad") for f in range(FOLDS)]
    counts = written(counts.groupBy("token").agg(*sums), folder, "counts")
    whole = counts.where("token = 0").first()
    if not whole:
        return none
    # of all folds, and of all but one
    total = {c: np.array([whole[f"{c}{f}"] for f in range(FOLDS)], float) for c in ("clean", "bad")}
    total = {c: np.append(n.sum() - n, n.sum()) for c, n in total.items()}
    if not total["bad"][-1] or not total["clean"][-1]:
        return none
    added = {c: sum((F.col(f"{c}{f}") for f in range(FOLDS)), F.lit(0)) for c in ("clean", "bad")}
    firm = F.lit(False)
    for f in range(FOLDS + 1):
        n_clean, n_bad = float(total["clean"][f]), float(total["bad"][f])
        bad, clean = (added[c] if f == FOLDS else added[c] - F.col(f"{c}{f}") for c in ("bad", "clean"))
        if n_clean and n_bad:
            firm = firm | ((F.greatest(bad, clean) >= LEAST_COUNT) & (F.abs(signed_root(F, bad, clean, n_bad, n_clean)) >= LEAST_Z))
    near = counts.where((F.col("token") != 0) & firm).toPandas()
    token = near["token"].to_numpy(np.int64).view(_U)
    order = np.argsort(token)
    token, near = token[order], near.iloc[order]
    if not len(token):
        return none
    corpus = rows.mapInArrow(_corpus_counts(spark.sparkContext.broadcast(token)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(corpus["token"].to_numpy(np.int64).view(_U).tolist(), corpus["n"].tolist(), strict=True))
    share = np.array([n[t] for t in token.tolist()], float)

    def of(f: int) -> Model:
        bad, clean = (near[[f"{c}{g}" for g in range(FOLDS) if g != f]].sum(axis=1).to_numpy(float) for c in ("bad", "clean"))
        n_bad, n_clean = float(total["bad"][f]), float(total["clean"][f])
        if not n_bad or not n_clean:
            return Model(np.empty(0, _U), np.empty(0), np.empty(0))
        delta, z = log_odds(bad, clean, share, n_bad, n_clean, float(n[0]))
        own = (np.abs(z) >= LEAST_Z) & (np.maximum(bad, clean) >= LEAST_COUNT) & (np.abs(delta) > DOUBT)
        return Model(token[own], z[own], delta[own] - np.sign(delta[own]) * DOUBT)

    *apart, model = (of(f) for f in range(FOLDS + 1))
    rest = {r["toxic"]: r for r in seen.mapInArrow(_rest(spark.sparkContext.broadcast(apart)), "toxic long, n long, unknown long").groupBy("toxic").agg(F.sum("n").alias("n"), F.sum("unknown").alias("unknown")).collect()}
    odds = [np.log((rest[y]["unknown"] + 0.5) / (rest[y]["n"] + 1.0)) for y in (0, 1)]
    for m in (*apart, model):
        m.rest = min(float(odds[1] - odds[0]), LEAST_REST)
    tail = seen.where("toxic = 0").mapInArrow(_tail(spark.sparkContext.broadcast(apart)), "n long, over array<long>, powers array<double>").toPandas()
    for m in (*apart, model):
        m.lam, m.k = extreme_values(int(tail["n"].sum()), np.sum(np.stack(tail["over"]), axis=0), np.sum(np.stack(tail["powers"]), axis=0))
    x = seen.mapInArrow(_surprises(spark.sparkContext.broadcast(apart)), "toxic long, x double").toPandas()
    model.a, model.b = calibrate(x["x"].to_numpy(float), x["toxic"].to_numpy(int))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each text's toxicity: doc_id, score (0 to 1), n_words, surprise, passages (start and end in code points, score, expected by chance).

    Null, empty and blank texts have no passage and the lowest score. Ties,
    repeated rows and null ids are scored row by row; other columns are ignored.
    """
    passages = "array<struct<start: long, end: long, score: double, expected: double>>"
    return text_rows(docs).mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id long, score double, n_words long, surprise double, passages {passages}")


def held_out(doc_id):
    """Rows whose labels are kept for the test."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every text's score by a model that learns from the labels of rows that are not held out, and whether it is toxic."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, model).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", F.size("passages").cast("long").alias("n_passages"), "passages")
