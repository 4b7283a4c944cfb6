"""Secrets in texts: known forms, and strings whose sliding-window entropy is high.

DataFrame functions only. A candidate is a long run of key-like characters with
letters and digits; parts of it that begin or end with a word that marks
examples end it. A window of 20 characters slides along it; counts of each
character and the sum of c * log2(c) are carried from window to window, so one
step changes two counts, which are packed into a few longs.
Windows with enough bits that overlap or touch make one span. The threshold
depends on the candidate's class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import text_rows
from dpspark.llm.native import found, let

# The base patterns and the least length of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12

WINDOW, BLOCK = 20, 276
#: Parts between separators that begin or end with a word that marks an example.
_WORDS = "(?i:example|sample|dummy|placeholder|changeme|xxxx)"
EXAMPLE = f"{_WORDS}|[A-Za-z0-9]*+(?<={_WORDS})"
CANDIDATE = f"(?=[A-Za-z0-9+/_=-]{{{WINDOW}}})(?:(?<![A-Za-z0-9])(?!{EXAMPLE})[A-Za-z0-9]++|[+/_=-]++)++"
#: Characters that are counted, and bits that a window needs, by class.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Counters are five bits each, so many of them in a long.
PACKED, BITS = 12, 5
CLASSES = (("hexadecimal", "[0-9a-fA-F]+", 3.0), ("single_case", "[0-9a-z+/_=-]+|[0-9A-Z+/_=-]+", 3.5), ("mixed", ".+", 3.7))
#: What is no secret: words and numbers joined by hyphens or slashes, UUIDs, few distinct characters. Possessive loops take no stack.
ALLOWED = (r"(?:[A-Za-z]++|[0-9]++)(?:[-_/+=](?:[A-Za-z]++|[0-9]++)?+)*+", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(.{1,4})\1{2,}.{0,4}")

_SPANS = "array<struct<first: long, last: long>>"
_SPAN = "array<struct<start: long, rank: int, kind: string, end: long>>"


def _span(kind: str, rank: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))


def _base(text: Column, kind: str, rank: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    every = found(text, pattern, group)
    kept = F.filter(every, lambda m: F.length(m.part) >= least) if least else every
    return F.transform(kept, lambda m: _span(kind, rank, m.start, m.start + F.length(m.text)))


def _plogp(n: int) -> float:
    return n * math.log2(n) if n > 1 else 0.0


#: What one more and one less of a symbol add to the sum of c * log2(c), by its count before.
_MORE = [_plogp(n + 1) - _plogp(n) for n in range(WINDOW + 1)]
_LESS = [_plogp(max(n - 1, 0)) - _plogp(n) for n in range(WINDOW + 1)]


def _peaks(block: Column, most: Column) -> Column:
    """The spans (first, last), ends exclusive, of a string's windows whose sum of c * log2(c) is ``most`` or less."""

    more, less = (F.array(*map(F.lit, x)) for x in (_MORE, _LESS))

    def count(of: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.get(of, x.word), x.shift).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(chars: Column, acc: Column, i: Column) -> Column:
        nothing, new = F.lit(0).cast("long"), F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

        def counted(x: Column) -> Column:
            same = F.coalesce(x.came.code == x.went.code, F.lit(False))
            n = F.transform(acc.n, lambda v, k: v + F.when(k == x.came.word, x.came.one).otherwise(nothing) - F.when(k == x.went.word, x.went.one).otherwise(nothing))
            total = acc.s + F.when(same, 0.0).otherwise(F.get(more, count(acc.n, x.came)) + F.coalesce(F.get(less, count(acc.n, x.went)), F.lit(0.0)))
            return let(F.struct(F.when(same, acc.n).otherwise(n).alias("n"), total.alias("s")), lambda y: opened(y, (i >= WINDOW - 1) & (y.s <= most)))

        def opened(y: Column, hit: Column) -> Column:
            apart = hit & (acc["last"] < i - WINDOW + 1)
            first, last = F.when(apart, i - WINDOW + 1).otherwise(acc["first"]), F.when(hit, i + 1).otherwise(acc["last"])
            spans = F.when(apart & (acc["first"] >= 0), F.concat(acc.spans, new)).otherwise(acc.spans)
            return F.struct(y.n.alias("n"), y.s.alias("s"), first.cast("long").alias("first"), last.cast("long").alias("last"), spans.alias("spans"))

        return let(F.struct(F.get(chars, i).alias("came"), F.get(chars, i - WINDOW).alias("went")), counted)

    def slid(chars: Column) -> Column:
        longs = F.array_repeat(F.lit(0).cast("long"), -(-len(SYMBOLS) // PACKED))
        zero = F.struct(longs.alias("n"), F.lit(0.0).alias("s"), F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"), F.array().cast(_SPANS).alias("spans"))
        ended = lambda a: F.when(a["first"] >= 0, F.concat(a.spans, F.array(F.struct(a["first"].alias("first"), a["last"].alias("last"))))).otherwise(a.spans)
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, lambda acc, i: step(chars, acc, i), ended)

    def placed(c: Column) -> Column:
        code = F.instr(F.lit(SYMBOLS), c) - 1
        return let(code, lambda k: F.struct(k.alias("code"), F.floor(k / PACKED).cast("int").alias("word"), (k % PACKED * BITS).cast("int").alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), (k % PACKED * BITS).cast("int")).alias("one")))

    return let(F.transform(F.filter(F.split(block, ""), lambda c: c != ""), placed), slid)


def _together(spans: Column) -> Column:
    """Ascending ``spans``, those that overlap or touch as one; each end is looked at once."""

    def ends(a: Column) -> Column:
        begins = F.filter(F.transform(a, lambda s, i: F.when((i == 0) | (s["first"] > F.get(a, i - 1)["last"]), s["first"])), lambda x: x.isNotNull())
        finish = F.filter(F.transform(a, lambda s, i: F.when((i == F.size(a) - 1) | (F.get(a, i + 1)["first"] > s["last"]), s["last"])), lambda x: x.isNotNull())
        return F.zip_with(begins, finish, lambda x, y: F.struct(x.alias("first"), y.alias("last")))

    return let(spans, ends)


def _entropy(text: Column) -> Column:
    """Spans of high entropy in candidates that are not allowed."""

    def kept(m: Column) -> Column:
        good = (F.length(m.text) >= WINDOW) & m.text.rlike("[0-9]") & m.text.rlike("[A-Za-z]")
        for pattern in ALLOWED:
            good = good & ~m.text.rlike(f"^(?:{pattern})$")
        return good

    def spans(m: Column) -> Column:
        bits = F.lit(CLASSES[-1][2])
        for _, pattern, least in reversed(CLASSES[:-1]):
            bits = F.when(m.text.rlike(f"^(?:{pattern})$"), F.lit(least)).otherwise(bits)
        # long candidates in blocks that overlap by a window less one
        stride = BLOCK - WINDOW + 1
        blocks = F.regexp_extract_all(m.text, F.lit(f"(?=(.{{{WINDOW},{BLOCK}}})).{{1,{stride}}}"), F.lit(1))
        # a window's entropy is log2(WINDOW) less its sum over WINDOW
        most = WINDOW * (F.lit(math.log2(WINDOW)) - bits) + 1e-9
        peaks = let(most, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(_peaks(b, t), lambda p: F.struct((i * stride + p["first"]).alias("first"), (i * stride + p["last"]).alias("last"))))))
        return F.transform(_together(peaks), lambda p: _span("entropy", 3, m.start + p["first"], m.start + p["last"]))

    return F.flatten(F.transform(F.filter(found(text, CANDIDATE), kept), spans))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in every text of ``docs`` (doc_id, text).

    One row per row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256
    (SHA-256 of the base spans), spans (all of them). A span is kind:start:end
    in code points, its end exclusive, sorted by start and then by kind (assign,
    access, hex, entropy) and joined by commas. The base kinds are matched from
    left to right without overlaps; ``entropy`` spans are added: what windows
    with enough bits cover.

    Null and empty texts have no span. Texts of any length are scanned whole;
    repeated rows and null ids are scanned row by row; other columns are
    ignored; an empty table gives no row.
    """
    text = F.col("text")
    found_ = text_rows(docs).select(
        "doc_id",
        _base(text, "assign", 0, ASSIGN, 2, ASSIGN_LEAST).cast(_SPAN).alias("assign"),
        _base(text, "access", 1, ACCESS).cast(_SPAN).alias("access"),
        _base(text, "hex", 2, HEX).cast(_SPAN).alias("hex"),
        F.when(text.rlike(f"[A-Za-z0-9+/_=-]{{{WINDOW}}}"), _entropy(text)).otherwise(F.array()).cast(_SPAN).alias("entropy"),
    )
    base = _written(F.concat("assign", "access", "hex"))
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found_.select("doc_id", size("assign"), size("access"), size("hex"), size("entropy"), F.sha2(base, 256).alias("base_sha256"), _written(F.concat("assign", "access", "hex", "entropy")).alias("spans"))
