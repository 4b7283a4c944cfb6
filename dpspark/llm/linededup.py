"""Removing passages that an earlier text has, by winnowing over line hashes.

Passages in running text seldom begin or end where a physical line does, so the
lines that are hashed are running ones: ten words, beginning at every word. In
each window of 41 of them the smallest hash is chosen (the rightmost of equal
ones), so any 50 words that two texts share give them a common fingerprint.

Places of a fingerprint are never paired. Those with the same words around them,
as far as 50 words with the fingerprint reach, form a class; all but its first
place repeat these words. Of lines with several classes, the first place of each
gives the runs of 50 words whose fingerprint it is; a run that has an earlier place repeats in all of
its class. So 50 words are removed if, and only if, an earlier place has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import shared_dir, text_rows, written
from dpspark.llm.neardup import BROADCAST_IDS, among
from dpspark.llm.words import chunks, mix, powers, runs, words

LINE, LEAST = 10, 50
#: Words on either side of a line that runs of LEAST words with it can hold.
SIDE = LEAST - LINE
#: Classes of so many places are sent to them, if they are no more than FREQUENT_MOST.
FREQUENT, FREQUENT_MOST = 500, 100_000
_U = np.uint64
_inverse = np.ones(1, _U)
_LOW = _U((1 << 24) - 1)


def picked(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window, the place in ``hashes`` of its smallest hash, the rightmost of equal ones."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    place = np.arange(len(hashes)).astype(_U)
    least, width = (hashes & ~_LOW) | (_LOW - (place & _LOW)), 1
    while width * 2 <= window:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    least = np.minimum(least[:n], least[window - width : window - width + n])
    return (place[:n] + (((_LOW - (least & _LOW)) - place[:n]) & _LOW)).astype(np.int64)


def winnowed(hashes: np.ndarray, at: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Places that are picked of windows within one text."""
    chosen = picked(hashes, window)
    return np.unique(chosen[text[at[: len(chosen)]] == text[at[window - 1 :]]])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            w = words(part["text"])
            text = np.repeat(np.arange(len(part)), np.diff(w.first))
            hashes, at = runs(w.hash, w.first, LINE)
            chosen = winnowed(hashes, at, text, LEAST - LINE + 1)
            n = w.first[text[at[chosen]]]
            low = np.maximum(at[chosen] - SIDE, n)
            size = np.minimum(at[chosen] + LEAST, w.first[text[at[chosen]] + 1]) - low
            around, place, left = grams(sums(w.hash), low, size), at[chosen] - n, at[chosen] - low
            # in text that repeats itself, every place may be chosen: of equal surroundings in a block, the first two and the last cover the others
            rank = _ranks(text[at[chosen]].astype(_U), around, left.astype(_U), (place // (SIDE + 1)).astype(_U))
            own = np.flatnonzero((rank[0] < 2) | rank[1])
            ids = part["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[chosen][own].view(np.int64)), pa.array(around[own].view(np.int64)), pa.array(left[own].astype(np.int32)), pa.array(size[own].astype(np.int32)), pa.array(ids[text[at[chosen]]][own]), pa.array(place[own].astype(np.int32))], names=["line", "around", "left", "size", "doc_id", "at"])


def _ranks(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many rows before it are equal to it, and whether it is the last of them."""
    n = len(columns[0])
    order = np.lexsort((np.arange(n), *columns))
    new = np.ones(n, bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    lead = np.flatnonzero(new)
    rank, last = np.empty(n, np.int64), np.empty(n, bool)
    rank[order] = np.arange(n) - np.repeat(lead, np.diff(np.append(lead, n)))
    last[order] = np.append(new[1:], True)[:n]
    return rank, last


def sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums, from which ``grams`` gives the hash of any run of words."""
    return np.concatenate([np.zeros(1, _U), np.cumsum(hashes * powers(len(hashes))[: len(hashes)], dtype=_U)])


def grams(total: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of runs of words, wherever these are in a text."""
    global _inverse
    if len(_inverse) < len(total):
        _inverse = np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * len(total), pow(int(powers(2)[1]), -1, 1 << 64), _U)]), dtype=_U)
    return mix((total[start + size] - total[start]) * _inverse[start])


def _runs_of_50(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of 50 words of which the line of a place is the fingerprint, by class."""
    names = ["gram", "around", "left", "doc_id", "start", "d"]
    for batch in batches:
        for part in chunks(batch):
            w = words(part["text"])
            total, n, places = sums(w.hash), np.diff(w.first), part["places"]
            text = np.repeat(np.arange(len(part)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
            at, left, size, around = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in pc.list_flatten(places).flatten())
            # rows that share an id have each other's places
            inside = (at - left + size <= n[text]) & (size >= LEAST)
            text, at, left, size, around = (x[inside] for x in (text, at, left, size, around))
            own = grams(total, w.first[text] + at - left, size).view(np.int64) == around
            text, at, left, size, around = (x[own] for x in (text, at, left, size, around))
            count = size - LEAST + 1
            row = np.repeat(np.arange(len(at)), count)
            start = (at - left)[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            # a run has the same fingerprint wherever it is, so under that one it meets all its places
            hashes, word = runs(w.hash, w.first, LINE)
            mine = np.flatnonzero(word[picked(hashes, SIDE + 1)[np.searchsorted(word, w.first[text[row]] + start)]] == w.first[text[row]] + at[row]) if len(row) else row
            row, start = row[mine], start[mine]
            ids = part["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            gram = grams(total, w.first[text[row]] + start, LEAST).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(around[row]), pa.array(left[row].astype(np.int32)), pa.array(ids[text[row]]), pa.array(start.astype(np.int32)), pa.array((at[row] - start).astype(np.int32))], names=names)


def repeated(total: np.ndarray, first: int, n: int, start: np.ndarray, size: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Marks those of a text's ``n`` words that are in one of the runs; runs that it doesn't have are of rows that share its id."""
    inside = (start >= 0) & (start + size <= n)
    start, size, gram = start[inside], size[inside], gram[inside]
    own = grams(total, first + start, size).view(np.int64) == gram
    depth = np.bincount(start[own], minlength=n + 1) - np.bincount((start + size)[own], minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            w, rows = words(part["text"]), []
            total = sums(w.hash)
            for i, matches in enumerate(part["matches"]):
                a, b = w.first[i], w.first[i + 1]
                text = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
                n, gone = int(b - a), 0
                if matches.is_valid and len(matches.values):
                    marked = repeated(total, int(a), n, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in matches.values.flatten()))
                    gone = int(marked.sum())
                    if gone:
                        starts = w.start[a:b] - w.offsets[i]
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
                        kept, last = [], 0
                        for s, e in zip(edges[::2], edges[1::2], strict=True):
                            kept.append(text[last : starts[s]])
                            last = starts[e] if e < n else len(text)
                        text = b"".join([*kept, text[last:]])
                        text = text.rstrip(b" \t\n\x0b\x0c\r") if marked[-1] else text
                rows.append((text.decode() if part["text"][i].is_valid else None, n, gone))
            texts, n, gone = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part["kept"], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["kept", "text", "n_words", "removed_words"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            n = np.diff(words(part["text"]).first)
            yield pa.RecordBatch.from_arrays([part["kept"], part["text"], pa.array(n, pa.int64()), pa.array(np.zeros(len(n), np.int64))], names=["kept", "text", "n_words", "removed_words"])


def _at_places(met: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """Places with what is known of their class. Classes of very many places go to these; places of the others are shuffled to their class."""
    many = found.where(f"n >= {FREQUENT}")
    if not 0 < many.count() <= FREQUENT_MOST:
        return met.join(found, group)
    others = met.join(F.broadcast(many.select(*group)), group, "left_anti").join(found.where(f"n < {FREQUENT}"), group)
    return others.unionByName(met.join(F.broadcast(many), group), allowMissingColumns=True)


def matches(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, matches): which runs of each text repeat an earlier place, with their hashes."""
    rows, group, place = docs.where("doc_id IS NOT NULL"), ["around", "left"], F.struct("doc_id", "at")
    marks = written(rows.mapInArrow(_fingerprints, "line long, around long, left int, size int, doc_id long, at int"), folder, "marks")
    lines = marks.groupBy("line").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("around").alias("low"), F.max("around").alias("high"), F.min("left").alias("least"), F.max("left").alias("most")).where("first < last")
    lines = written(lines.select("line", F.expr("low < high OR least < most").alias("several")), folder, "lines")
    # few lines go to their places, of which a frequent line has very many
    met = written(marks.join(F.broadcast(lines) if lines.count() <= BROADCAST_IDS else lines, "line"), folder, "met")
    classes = written(met.groupBy(*group).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("size").alias("size"), F.max("several").alias("several"), F.count("*").alias("n")).where(f"size >= {LEAST}"), folder, "classes")
    firsts = classes.where("several").groupBy("first.doc_id").agg(F.collect_list(F.struct("first.at", "left", F.col("size"), "around")).alias("places"))
    firsts = written(firsts, folder, "firsts")
    texts = among(rows, firsts.select("doc_id"), "doc_id", "doc_id").join(firsts, "doc_id").select("doc_id", "text", "places")
    held = written(texts.mapInArrow(_runs_of_50, "gram long, around long, left int, doc_id long, start int, d int"), folder, "held")
    start = F.struct("doc_id", "start")
    known = held.groupBy("gram").agg(F.min(start).alias("first"), F.max(start).alias("last")).where("first < last").select("gram", "first")
    # every run holds the line, so the outermost two cover those between them
    run = F.struct("d", "gram")
    later = held.join(known, "gram").where(start > F.col("first")).groupBy(*group).agg(F.max(run).alias("from"), F.min(run).alias("to"))
    found = written(classes.join(later, group, "left").where("first < last OR from IS NOT NULL").select(*group, "first", "from", "to", "n"), folder, "found")
    span = lambda at, size, gram: F.struct(at.cast("int").alias("start"), size.cast("int").alias("size"), gram.alias("gram"))
    at, left, least = F.col("at"), F.col("left"), F.lit(LEAST)
    spans = F.array(F.when(place > F.col("first"), span(at - left, F.col("size"), F.col("around"))), *(F.when(F.col(c).isNotNull(), span(at - F.col(f"{c}.d"), least, F.col(f"{c}.gram"))) for c in ("from", "to")))
    each = _at_places(met, found, group).select("doc_id", F.explode(F.filter(spans, lambda x: x.isNotNull())).alias("span"))
    return written(each.groupBy("doc_id").agg(F.collect_list("span").alias("matches")), folder, "matches")


def remove_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text) without passages of 50 words or more that an earlier place has.

    Words are runs of anything but ASCII white space, with A-Z in lower case.
    Places are ordered by doc_id and then by position; the first of equal
    passages stays. One row per row of ``docs``: the columns named in ``keep``
    (doc_id and text by default), text as what is left of it, n_words (before)
    and removed_words.

    Null, empty and blank texts stay, as do all texts of fewer than 50 words and
    rows with a null doc_id. Of rows that share a doc_id each is compared with
    the others by its later places only. Columns that are not kept are ignored;
    an empty table gives no row.
    """
    folder = shared_dir(docs.sparkSession)
    found = matches(text_rows(docs), folder)
    keep = keep or ["doc_id", "text"]
    # the columns travel as one, so that no name of theirs can clash with one of ours
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(c) for c in keep if c != "text")).alias("kept"))
    kept = rows.schema["kept"].dataType.simpleString()
    out = [F.col("text").alias(c) if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in keep]
    schema = f"kept {kept}, text string, n_words long, removed_words long"
    if (ids := found.select("doc_id")).count() <= BROADCAST_IDS:  # only texts that change are shuffled
        ids = F.broadcast(ids)
        changed = rows.join(ids, "doc_id", "left_semi").join(found, "doc_id").select("kept", "text", "matches").mapInArrow(_removed, schema)
        # not a null-safe join: a null id has no match and stays
        edited = changed.unionByName(rows.join(ids, "doc_id", "left_anti").select("kept", "text").mapInArrow(_plain, schema))
    else:
        edited = rows.join(found, "doc_id", "left").select("kept", "text", "matches").mapInArrow(_removed, schema)
    return edited.select(*out, "n_words", "removed_words")
