"""Benchmark decontamination by spaced seeds.

A mask picks six of up to ten successive words; the hash of the words it picks
is the same in two texts whatever stands in the places that it ignores. Seeds of
all texts are filtered by a bitmap of the benchmark's seeds, whose size is fixed,
and then joined with them. Each hit gives a document, an item and their offset,
along which all words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import shared_dir, text_rows, written
from dpspark.llm.words import PUNCT, chunks, mix, words

#: Any 15 words with up to three substitutions hold one of these in full.
MASKS = ("111111", "1111011", "101100111", "1100010111")
#: With these, so do 6 to 11 words of which as many differ as the least share lets.
SHORT_MASKS, SHORT, LEAST_ITEM = ("11111", "101111", "110111", "111011", "111101"), 12, 6
#: Words that have to agree: so many, or this share of a shorter item.
LEAST_WORDS, LEAST_SHARE = 12, 0.8
#: ... in a stretch of so many words, or over the whole of a shorter item.
STRETCH = 15
BITS = 26
BROADCAST_BYTES = 32 << 20
_U = np.uint64
_ODD = np.random.default_rng(3).integers(0, 1 << 63, 16, np.uint64) | _U(1)


def _words(batch: pa.RecordBatch):
    return words(pc.utf8_lower(batch["text"]), PUNCT, lower=False)


def seeds(hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every place where ``mask`` fits in one text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    total = np.full(n, int(mask, 2), _U)
    for j, c in enumerate(mask):
        if c == "1":
            total += hashes[j : j + n] * _ODD[j]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
    return mix(total[at]), at


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            w = _words(part)
            ids = part["doc_id"].to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(part)), np.diff(w.first))
            length = np.diff(w.first)
            for mask in MASKS + SHORT_MASKS:
                h, at = seeds(w.hash, w.first, mask)
                if mask in SHORT_MASKS:
                    short = (length[text[at]] >= LEAST_ITEM) & (length[text[at]] < SHORT)
                    h, at = h[short], at[short]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[text[at]].astype(np.int64)), pa.array((at - w.first[text[at]]).astype(np.int32))], names=["seed", "item_id", "item_at"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            w = _words(part)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hash.view(np.int64)))], names=["item_id", "words"])


def _doc_seeds(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, _U)
        for batch in batches:
            for part in chunks(batch):
                w = _words(part)
                ids = part["doc_id"].to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(part)), np.diff(w.first))
                for mask in MASKS + SHORT_MASKS:
                    h, at = seeds(w.hash, w.first, mask)
                    place = h >> _U(64 - BITS)
                    hit = (bits[place >> _U(6)] >> (place & _U(63))) & _U(1) == 1
                    h, at = h[hit], at[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[text[at]].astype(np.int64)), pa.array((at - w.first[text[at]]).astype(np.int32))], names=["seed", "doc_id", "doc_at"])

    return run


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, agreeing words) of the run that scores most: one for a word that agrees, minus two for one that does not."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def leak(same: np.ndarray, length: int) -> tuple[int, int, int] | None:
    """(start, end, agreeing words) of the run that makes an item of ``length`` words a leak, if there is one. same: by word along the offset.

    That is the best run if it has enough agreeing words; else of those runs in
    which every stretch of 15 words (the whole of a shorter item) has enough, the
    one with the most, from its first to its last agreeing word. What text or
    item don't have of a stretch doesn't agree.
    """
    need, width = min(LEAST_WORDS, int(np.ceil(LEAST_SHARE * length))), min(STRETCH, length)
    if same.sum() < need:
        return None
    best = best_run(same)
    if best[2] >= need:
        return best
    total = np.concatenate([np.zeros(width, int), np.cumsum(same), np.full(width - 1, same.sum())])
    # stretch i has the words from i - width + 1 to i
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (total[width:] - total[:-width] >= need).astype(np.int8), [0]])))
    every = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        at = np.flatnonzero(same[max(0, a - width + 1) : b]) + max(0, a - width + 1)
        every.append((len(at), -int(at[0]), int(at[-1]) + 1))
    if not every:
        return None
    n, start, end = max(every)
    return -start, end, n


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "matches", "substitutions", "doc_word", "item_word", "item_words"]
    for batch in batches:
        for part in chunks(batch):
            w, rows = _words(part), []
            for i, (doc_id, hits) in enumerate(zip(part["doc_id"].to_pylist(), part["hits"], strict=True)):
                own = w.hash[w.first[i] : w.first[i + 1]]
                for hit in hits.values:
                    item = hit["words"].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    shift = hit["shift"].as_py()
                    a, b = max(0, -shift), min(len(item), len(own) - shift)
                    if b > a:
                        if run := leak(own[a + shift : b + shift] == item[a:b], len(item)):
                            start, end, n = run
                            rows.append((doc_id, hit["item_id"].as_py(), n, end - start - n, a + shift + start, a + start, len(item)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items (item_id, text) found in ``docs`` (doc_id, text), up to substituted words.

    Words are runs of letters, digits and non-ASCII characters in lower case. One
    row per document and item: doc_id, item_id, matches and substitutions (words
    of the best run along the best offset), doc_word and item_word (where it
    starts), item_words (the item's length). A run counts that has 12 agreeing
    words, or 0.8 of a shorter item's words. Every item is found of which a text
    has 12 words of a stretch of 15, or 0.8 of all if it is shorter, in place.

    Items of fewer than six words can't be told from chance and match nothing,
    as do null and empty texts. Rows that share a doc_id or item_id give one row
    with the best run. A row with a null id takes no part; other columns are
    ignored; an empty table on either side gives no row.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    rows, items = text_rows(docs).where("doc_id IS NOT NULL"), text_rows(benchmark, "item_id").where("doc_id IS NOT NULL")
    known = written(items.mapInArrow(_item_seeds, "seed long, item_id long, item_at int").distinct(), folder, "seeds")
    # 64 seeds' bits a row: at most 2 ** 20 rows, however large the benchmark is
    place = F.shiftrightunsigned("seed", 64 - BITS)
    bits = known.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(seed, {64 - BITS}) & 63))")).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    hits = rows.mapInArrow(_doc_seeds(spark.sparkContext.broadcast(bitmap.tobytes())), "seed long, doc_id long, doc_at int")
    shifts = hits.join(known, "seed").groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("seeds"))
    shifts = written(shifts.select("doc_id", "item_id", "shift"), folder, "shifts")
    item_words = items.mapInArrow(_item_words, "item_id long, words array<long>")
    found = written(shifts.join(item_words, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("hits")), folder, "found")
    size = found.agg(F.sum(F.aggregate("hits", F.lit(64).cast("long"), lambda s, h: s + 32 + 8 * F.size(h.words)))).first()[0] or 0
    checked = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "doc_id").select("doc_id", "text", "hits")
    runs = checked.mapInArrow(_verified, "doc_id long, item_id long, matches long, substitutions long, doc_word long, item_word long, item_words long")
    best = F.max(F.struct("matches", (-F.col("substitutions")).alias("few"), (-F.col("doc_word")).alias("at"), (-F.col("item_word")).alias("item_at"), "item_words")).alias("b")
    return runs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.matches", (-F.col("b.few")).alias("substitutions"), (-F.col("b.at")).alias("doc_word"), (-F.col("b.item_at")).alias("item_word"), "b.item_words")
