"""Document fingerprints by winnowing, with DataFrame functions only.

The grams of a text are all its runs of 16 characters. Their hashes are those of
a rolling polynomial, which is carried along for all places at once: that of
twice as many characters follows from two of its values. Of every 32
successive grams the one with the smallest hash is chosen, the rightmost of
equal ones, and its place is kept. So any 47 characters that two texts share
give them a common fingerprint. A hash and its place are one long integer, whose
order is that of the choice.

Which grams are chosen depends on the 32 grams around them only. So the
fingerprint of an edited text is that of its parts, but for the seams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dpspark.llm.common import text_rows
from dpspark.llm.native import let
from dpspark.llm.neardup import BROADCAST_IDS

#: Characters of a gram and grams of a window (powers of two); together they span REACH characters.
GRAM, WINDOW = 16, 32
#: Grams of a block, half a window, and the neighbours of a candidate that are looked at one by one.
BLOCK, NEAR = WINDOW // 2, 8
REACH = GRAM + WINDOW - 1
#: The largest prime below 2**30: four products of two remainders are less than 2**63.
PRIME, BASE = (1 << 30) - 35, 1_000_003
_PLACE = 1 << 32
#: Rows that are sorted together to find each document's next one, and how many times as many make a crowd.
BUCKET, CROWDED = 4000, 4
_NONE = "array<long>"


def _hashes(h: Column, n: int) -> Column:
    """Of hashes of all runs of ``n`` characters those of GRAM, by doubling; null where the text ends before the gram does."""
    twice = F.transform(h, lambda x, i: (x * pow(BASE, n, PRIME) + F.get(h, i + n)) % PRIME)
    return let(twice, lambda k: _hashes(k, 2 * n)) if 2 * n < GRAM else twice


def _key(x: Column, i: Column) -> Column:
    return x * _PLACE + (_PLACE - 1 - i)


def _candidates(h: Column, n: Column) -> Column:
    """Keys of the ``n`` grams of which one may be chosen.

    Grams are cut into blocks of half a window. A window spans one of them, the
    gram's own or one next to it, so a gram above the minima of all three has no window.
    """
    least = F.transform(F.sequence(F.lit(1), n - BLOCK + 1, F.lit(BLOCK)), lambda a: F.array_min(F.slice(h, a, F.lit(BLOCK))))
    most = lambda m: F.transform(F.sequence(F.lit(0), F.size(m)), lambda i: F.greatest(F.get(m, i - 1), F.get(m, i), F.get(m, i + 1)))
    # keys differ, so taking away null is all that array_except does, and with no call for each gram
    kept = lambda c: F.array_except(F.transform(h, lambda x, i: F.when(x <= F.get(c, F.shiftright(i, BLOCK.bit_length() - 1)), _key(x, i))), F.array(F.lit(None).cast("long")))
    return let(let(least, most), kept)


def _least_of_windows(c: Column, n: Column) -> Column:
    """Those of the candidates between whose next smaller ones to the left and to the right, or the ends, there is room for a window."""
    missing, below = F.lit(-1).cast("long"), lambda x: lambda y: y < x
    low = lambda k: k.bitwiseAND(F.lit(_PLACE - 1))
    far = WINDOW - 1  # as many larger candidates on one side leave room for a window

    def smaller(x: Column, i: Column, step: int) -> Column:
        """The next smaller candidate; null if there is none, or so far off that there is room on this side alone."""
        found = F
        for t in range(1, NEAR + 1):
            y = F.get(c, i + step * t)
            found = found.when(F.coalesce(y, missing) < x, y)
            if t % 3 == 0:
                found = found.when(step * (low(x) - low(y)) > far, F.lit(None).cast("long"))
        if step < 0:
            return found.otherwise(let(F.filter(F.slice(c, F.greatest(i - far + 1, F.lit(1)), F.least(i, F.lit(far))), below(x)), lambda f: F.get(f, F.size(f) - 1)))
        return found.otherwise(F.get(F.filter(F.slice(c, i + 2, F.lit(far)), below(x)), F.lit(0)))

    def room(x: Column, i: Column) -> Column:
        # null stands for the ends of the text
        return F.coalesce(low(smaller(x, i, -1)), F.lit(_PLACE)) - F.coalesce(low(smaller(x, i, 1)), _PLACE - 1 - n) > WINDOW

    return F.filter(c, room)


def winnowed(text: Column) -> Column:
    """The chosen grams of a text by place, as array of long: hash * 2**32 + 2**32 - 1 - place. A text shorter than a gram is one."""

    def chosen(h: Column) -> Column:
        n = F.size(h) - (GRAM - 1)
        many = let(_candidates(h, n), lambda c: _least_of_windows(c, n.cast("long")))
        return F.when(n > WINDOW, many).otherwise(F.array(F.array_min(F.transform(h, _key))))

    def grams(codes: Column) -> Column:
        one = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * BASE + c) % PRIME)
        return F.when(F.size(codes) >= GRAM, let(_hashes(codes, 1), chosen)).otherwise(F.array(one * _PLACE + (_PLACE - 1)))

    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.when(F.length(text) > 0, let(codes, grams)).otherwise(F.array().cast(_NONE))


def place(key: Column) -> Column:
    return F.lit(_PLACE - 1) - key.bitwiseAND(F.lit(_PLACE - 1))


def _edited(rows: DataFrame) -> DataFrame:
    """``rows`` of ``with_next`` with ``edited`` (text) and ``other``, its chosen grams: those of own and next_own, and anew those at the seam and at the end."""
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select("*", n.alias("n"), (n - cut).alias("left"), F.least(cut, F.length("next_text")).alias("taken"))
    left, taken, edited = F.col("left"), F.col("taken"), F.col("edited")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), left), F.substring(F.col("next_text"), F.lit(1), taken)))
    moved = lambda keys, by: F.transform(keys, lambda k: k - by)
    # what follows the seam is short, or goes on with what the next text has chosen
    short = taken < 3 * REACH
    seam = moved(winnowed(F.substring(edited, left - 2 * REACH + 1, F.when(short, 5 * REACH).otherwise(4 * REACH))), left - 2 * REACH)
    end = moved(winnowed(F.substring(edited, left + taken - 2 * REACH + 1, F.lit(2 * REACH))), left + taken - 2 * REACH)
    before, after = F.filter("own", lambda k: place(k) <= left - REACH), F.filter(seam, lambda k: place(k) > left - REACH)
    parts = F.concat(
        before,
        F.filter(seam, lambda k: (place(k) > left - REACH) & (place(k) < left + WINDOW - 1)),
        moved(F.filter("next_own", lambda k: (place(k) >= WINDOW - 1) & (place(k) <= taken - REACH)), left),
        F.filter(end, lambda k: place(k) > left + taken - REACH),
    )
    return rows.withColumn("other", F.when(left < 3 * REACH, winnowed(edited)).when(short, F.concat(before, after)).otherwise(parts))


def shown(chosen: Column) -> Column:
    """Each chosen gram's hash and, in the last eight digits, its place, in base 16."""
    return F.array_join(F.transform(chosen, lambda k: F.hex(k.bitwiseXOR(F.lit(_PLACE - 1)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Twice the hashes in common by the hashes of both; 1 for two empty texts."""
    only = lambda c: F.array_distinct(F.transform(c, lambda k: F.shiftright(k, 32)))
    both = F.struct(only(a).alias("a"), only(b).alias("b"))
    total = lambda s: F.size(s.a) + F.size(s.b)
    return let(both, lambda s: F.when(total(s) == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(s.a, s.b)) / total(s)))


def bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``bucket``: ranges of doc_id of about BUCKET rows, by their lower ends; of null ids -1 below all others.

    Equal ranges come first; one in which ids crowd is cut into equal ranges
    between its own least and greatest id, until none of several ids is crowded.
    """
    known = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    width = ((known["hi"] or 0) - (known["lo"] or 0)) // max(1, -(-known["n"] // BUCKET)) + 1
    rows = docs.withColumn("bucket", F.col("doc_id") - F.pmod(F.col("doc_id"), F.lit(width).cast("long")))
    while True:
        size = rows.where("doc_id IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        crowds = size.where(f"n > {CROWDED * BUCKET} AND lo < hi").select("bucket", F.floor((F.col("hi") - F.col("lo")) / F.ceil(F.col("n") / BUCKET) + 1).cast("long").alias("width"))
        many = crowds.count()
        if not many:
            return rows
        crowds = F.broadcast(crowds) if many <= BROADCAST_IDS else crowds
        # the ranges of a crowd begin where its own does, so they overlap with no other
        rows = rows.join(crowds, "bucket", "left").withColumn("bucket", F.when(F.col("width").isNull(), F.col("bucket")).otherwise(F.greatest("bucket", F.col("doc_id") - F.pmod(F.col("doc_id"), F.col("width"))))).drop("width")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``own``, ``next_text``, ``next_own``: by descending doc_id, after the last one the first; own: the chosen grams.

    Rows are dealt to buckets of ids; each gets a copy of the first row of the
    bucket after it. Null ids come last.
    """
    rows = bucketed(docs)
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    order = Window.orderBy(F.desc_nulls_last("bucket"))
    # a row for about 4000 documents: each bucket is given the head of the next lower one, the last one that of the highest
    first = F.first("doc_id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("bucket", F.when(F.row_number().over(order) < F.count("*").over(Window.partitionBy(F.lit(0))), F.lead("doc_id").over(order)).otherwise(first).alias("doc_id"))
    wanted = heads.select("doc_id").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.doc_id), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    copies = heads.join(texts, heads.doc_id.eqNullSafe(texts.doc_id)).select("bucket", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("copy"))
    both = rows.select("bucket", "doc_id", "text", F.lit(False).alias("copy")).unionByName(copies).withColumn("own", winnowed(F.col("text")))
    inside = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    found = both.select("*", F.lead("text").over(inside).alias("next_text"), F.lead("own").over(inside).alias("next_own"))
    return found.where(~F.col("copy")).drop("copy", "bucket")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text.

    In the edited text the last third (rounded down) of the code points gives
    way to as many of the next document's first ones, or all of them; documents
    are taken by descending doc_id (of one id, by text), null ids last, and after
    the last comes the first. One row per row: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Null and empty texts have an empty fingerprint; two of these are alike (1),
    one of them and another text are not (0). Fewer characters than a gram are
    one gram, fewer grams than a window have one minimum. Equal texts have equal
    fingerprints. A lone document is its own next one. Other columns are
    ignored; an empty table gives no row.
    """
    rows = _edited(with_next(text_rows(docs))).select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "other", F.col("next_own").alias("next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
