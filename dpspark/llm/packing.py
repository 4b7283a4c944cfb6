"""Packing tokenised documents into fixed windows by minimum bin slack.

Each task streams its documents. A text's full windows leave at once; what is
left of it joins a pool of pieces. While the pool is full, a window starts with
its longest piece, and a dynamic program over the pool's multiset of lengths (a
big integer is the bitset of sums that can be reached) finds the sum closest to
the capacity; how many pieces of each length make it up is read back from the
steps. Nothing is shuffled, and a lost task is simply run again over its rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from struct import pack as pack_ids

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import text_rows

CAPACITY = 4096
POOL = 512
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Words with these characters only are split alike by every Unicode version.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_BATCH = 4 << 20


class WordIds(dict):
    """Ids of a space-separated word as little-endian 32-bit integers, remembered.

    The file's normaliser and pre-tokenizer never look across white space. Plain
    words take the same merges through a faster encoder: a byte that no UTF-8
    text holds stands for the end of a word, and a token's rank is its id.
    """

    LIMIT = 800_000

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        suffix = spec["model"]["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                stem = token.removesuffix(suffix)
                ranks[bytes(byte[c] for c in stem) + b"\xff" * (stem != token)] = i
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.parts = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        if _PLAIN.fullmatch(word) and "<|" not in word:
            low = word.lower()
            ids = self.piece(low.encode() + b"\xff") if low.isalpha() else [i for p in self.parts(low) for i in self.piece(p.encode() + b"\xff")]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        out = pack_ids(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = out
        return out

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def fullest(counts: Counter, room: int) -> Counter:
    """The multiset of lengths, out of ``counts``, whose sum is closest to ``room`` from below."""
    keep, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, share = min(counts[length], room // length), 1
        while left > 0:
            take = min(share, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & keep
            left, share = left - take, share * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return chosen


class Packer:
    """pieces: (doc_id, start, doc_tokens, ids), pooled by length."""

    def __init__(self, capacity: int, pool: int, task: int):
        self.capacity, self.pool, self.sequence = capacity, pool, task << 32
        self.by_length: dict[int, list] = defaultdict(list)
        self.counts: Counter = Counter()
        self.size = self.total = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        n, full = len(ids) // 4, len(ids) // 4 // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            self.emit([(doc_id, at, n, ids[4 * at : 4 * (at + self.capacity)])])
        if full < n:
            self.put((doc_id, full, n, ids[4 * full :]))
        while self.size >= self.pool:
            self.emit(self.window())

    def put(self, piece: tuple) -> None:
        n = len(piece[3]) // 4
        self.by_length[n].append(piece)
        self.counts[n] += 1
        self.size, self.total = self.size + 1, self.total + n

    def take(self, n: int) -> tuple:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n]
        self.size, self.total = self.size - 1, self.total - n
        return self.by_length[n].pop()

    def window(self) -> list[tuple]:
        chosen = [self.take(max(self.counts))]
        room = self.capacity - len(chosen[0][3]) // 4
        for n, times in fullest(self.counts, room).items():
            chosen += [self.take(n) for _ in range(times)]
        return self.topped(chosen, self.capacity)

    def topped(self, chosen: list[tuple], size: int) -> list[tuple]:
        """With the head of a piece that is cut to fill what is left of ``size``."""
        gap = size - sum(len(p[3]) // 4 for p in chosen)
        while gap and self.size:
            doc_id, start, n, ids = self.take(max(self.counts))
            chosen.append((doc_id, start, n, ids[: 4 * gap]))
            if len(ids) > 4 * gap:
                self.put((doc_id, start + gap, n, ids[4 * gap :]))
            gap -= len(chosen[-1][3]) // 4
        return chosen

    def close(self) -> None:
        """The rest, under a window, goes to windows of powers of two, which need no padding."""
        while self.total >= self.capacity:
            self.emit(self.window())
        while self.total:
            self.emit(self.topped([], 1 << (self.total.bit_length() - 1)))

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, n, ids in pieces:
            self.out.append((doc_id, start, len(ids) // 4, n, self.sequence, offset, ids))
            offset += len(ids) // 4
        self.sequence += 1

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, pool: int = POOL, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens, without padding.

    One row per piece: doc_id, start (its document's ids before it), length,
    doc_tokens, sequence_id, offset in the sequence, ids (little-endian unsigned
    32-bit). Every sequence is full, but for a few at each task's end whose
    lengths are powers of two. ``capacity`` is a power of two.

    A null or empty text is its end id alone. A null doc_id stays null; repeated
    rows are packed once each; other columns are ignored; an empty table gives
    no row. Very long texts are cut at multiples of ``capacity``.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    end = end_id.to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        schema = pa.schema(fields)
        ids, packer, waiting = word_ids(public_tokenizers.path(tokenizer)), Packer(capacity, pool, TaskContext.get().partitionId()), 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                coded = ids.of(text.as_py()) + end
                packer.add(doc_id, coded)
                waiting += len(coded) + 64
                if waiting > _BATCH:
                    waiting = 0
                    yield packer.batch(schema)
        packer.close()
        yield packer.batch(schema)

    return text_rows(docs).mapInArrow(packed, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
