"""Fill-in-middle: a document's lines in three parts, the middle of which goes last.

The tokenizers library's Split pre-tokenizer cuts a text into isolated matches
of a line pattern and gives each match's code-point offsets; nothing is trained.
The number of offsets is the number of lines, and the offsets at two drawn ranks
are where prefix and middle end. Draws come from a hash of the document's id, so
that a task that is run again cuts alike. Rows are worked on where they are:
nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import text_rows
from dpspark.llm.words import chunks

# Units, markers, and the draws' seed and rates (of 100).
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit integers; a null id is drawn for like an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearranged(text: str, splitter, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = [end for _, (_, end) in splitter.pre_tokenize_str(text)]
    n = len(ends)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Every text of ``docs`` (doc_id, text) as a fill-in-middle example.

    One row per row: doc_id, n (lines), form (plain, psm or spm), prefix_chars
    and middle_chars (code points; null if plain), output. ``rate`` of 100
    documents are rearranged, ``spm`` of 100 of these with the suffix first.

    Null and empty texts and texts with a marker stay as they are (null: empty).
    Repeated rows come out alike, a null id is drawn for like an empty one, other
    columns are ignored and an empty table gives no row. A long text is held by
    one task, with one offset a line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        splitter = pre_tokenizers.Split(Regex(UNIT), "isolated")
        for batch in batches:
            for part in chunks(batch):
                ids = part["doc_id"].to_pylist()
                rows = [rearranged(t.as_py(), splitter, draws(seed, i), rate, spm) for i, t in zip(ids, part["text"], strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, part["text"].type)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return text_rows(docs).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from ``output`` and ``form`` alone: no part of a rearranged text holds a marker."""

    def after(marker: str) -> Column:
        return F.substring_index(output, marker, -1)

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, end, 1), start, -1)

    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(examples: DataFrame) -> DataFrame:
    """The examples with hashes in place of their outputs and of the texts rebuilt from these."""
    hashed = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return examples.withColumns(hashed).drop("output")


SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, {', '.join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
