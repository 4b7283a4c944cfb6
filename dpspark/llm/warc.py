"""Web archives: WARC records, read back, and their index merged from sorted runs.

Archives are written by Spark's text writer, whose line separator is the end of
a WARC record, so files go wherever Spark can write. Reading follows each
record's Content-Length. Each archive gives one run of index entries, sorted by
URL key and time; runs are dealt to ranges of keys, and a loser tree merges a
range's runs entry by entry.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import shared_dir, written

#: Payloads of fewer bytes are always stored; so many records make up an archive.
LEAST_BYTES, RECORDS = 1000, 4000
#: Index entries that one task merges, about.
RANGE = 10_000
END = "\r\n\r\n"
#: Digests of 40 characters with an id: 100 MB at most.
BROADCAST_DIGESTS = 1_000_000
#: A page has no date of its own: its id counts seconds from here, over and over again in a hundred years.
EPOCH, CENTURY = 1_577_836_800, 3_155_760_000
INDEX = "urlkey string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
_ENTRY = pa.schema([(n, pa.int64() if n in ("page_id", "refers_to", "payload_bytes", "offset", "length", "rank", "history") else pa.string()) for n in [x.split()[0] for x in INDEX.split(", ")]])


def url_key(url: Column) -> Column:
    """The host's labels from the top down, then the path: no scheme, leading www, port, fragment or letter case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?:]*)", 1), r"^www\d*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?:]*(:\d*)?", ""))


def records(pages: DataFrame, folder: str) -> DataFrame:
    """The WARC record of each row of ``pages`` (page_id, url, html), without the two line ends that close it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "UTF-8"))})
    # only digests that more pages have are joined; of these the largest id has the payload
    large = rows.where(f"size >= {LEAST_BYTES} AND page_id IS NOT NULL")
    kept = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).where("keeper <> least").select("digest", "keeper")
    kept = written(kept, folder, "keepers")
    # few of them go to the payloads; beyond that bound the payloads are shuffled to them
    rows = rows.join(F.broadcast(kept) if kept.count() <= BROADCAST_DIGESTS else kept, "digest", "left")
    revisit = (F.col("size") >= LEAST_BYTES) & (F.col("keeper") > F.col("page_id"))
    # in UTC, whatever the session's time zone is
    second = F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(CENTURY))
    of_day = F.pmod(second, F.lit(86_400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((second - of_day) / 86_400).cast("int"))
    date = F.format_string("%sT%02d:%02d:%02dZ", day.cast("string"), F.floor(of_day / 3600), F.floor(of_day / 60) % 60, of_day % 60)
    clean = F.regexp_replace("url", r"[\x00-\x1f\x7f]", " ")
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    identity = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), identity, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


def write(pages: DataFrame, folder: str) -> str:
    """Archives of ``pages`` below ``folder``, RECORDS records each at most; returns their path."""
    path = f"{folder}/archives"
    records(pages, folder).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path)
    return path


_HEADER = re.compile(rb"([\w-]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record; offset and length are those of the whole record in the file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(data, at, end)}
        last = end + int(head["content-length"])
        if data[at : at + 5] != b"WARC/" or data[last : last + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        yield head, data[end:last], at, last + 4 - at
        at = last + 4


def _entry(head: dict[str, str], block: bytes, archive: str, offset: int, length: int) -> tuple:
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    number = lambda x: None if x == "<urn:page:none>" else int(x[10:-1])
    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
    if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"{archive}: the payload at byte {offset} is not what was written")
    refers = head.get("warc-refers-to")
    return "", head["warc-date"], number(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], number(refers) if refers else None, size, digest, archive, offset, length


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ENTRY), _ENTRY, strict=True)], schema=_ENTRY)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            name = path.as_py().rsplit("/", 1)[-1]
            yield _table([_entry(head, block, name, at, n) for head, block, at, n in parse(content.as_py())])


class LoserTree:
    """Merges sorted lists: each inner node holds the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.place, self.heads = [0] * self.k, [self._head(i, 0) for i in range(self.k)]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _head(self, run: int, place: int):
        return (0, self.key(self.runs[run][place]), run) if place < len(self.runs[run]) else (1, None, run)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x < y if x[0] == y[0] == 0 else x[0] < y[0]

    def _play(self, run: int) -> None:
        winner, node = run, (run + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # the first to come waits for the other side
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[self.tree[0]][0] == 0:
            run = self.tree[0]
            yield self.runs[run][self.place[run]]
            self.place[run] += 1
            self.heads[run] = self._head(run, self.place[run])
            self._play(run)


def _key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of one range: they come one after the other, each in its own order."""
    runs: dict[str, list] = {}
    for batch in batches:
        for row in zip(*(batch[n].to_pylist() for n in _ENTRY.names), strict=True):
            runs.setdefault(row[8], []).append(row)
    out = []
    for row in LoserTree(list(runs.values()), _key):
        out.append(row)
        if len(out) == 10_000:
            yield _table(out)
            out = []
    yield _table(out)


def merged_index(archives: str, folder: str, spark) -> DataFrame:
    """The index of all ``archives``: partitions follow one another by URL key and time, and each is sorted.

    Every archive's entries are first written as a run. Ranges of about RANGE
    entries are cut by URL key, time and id together, so one much captured URL is
    spread over several. What a range has of a run is put in order by Spark,
    which spills; the tree only merges.
    """
    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    entries = files.mapInArrow(_read, INDEX).withColumn("urlkey", url_key(F.col("url")))
    runs = written(entries.sortWithinPartitions("archive", "urlkey", "captured", F.col("page_id").asc_nulls_last(), "offset"), folder, "runs")
    ranges = runs.repartitionByRange(max(1, -(-runs.count() // RANGE)), "urlkey", "captured", F.col("page_id").asc_nulls_last(), "archive", "offset")
    return ranges.sortWithinPartitions("archive", "urlkey", "captured", F.col("page_id").asc_nulls_last(), "offset").mapInArrow(_merged, INDEX)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC archives, reads them back and returns their merged index.

    One row per row of ``pages``: INDEX's columns. Of pages with equal payloads
    of 1000 bytes or more the largest page_id keeps the payload, and the others
    revisit it; refers_to is then its page_id. payload_bytes and payload_digest
    (SHA-1) are those of the full payload, checked against the bytes read back.

    A null html is an empty payload, a null url an empty one. A row with a null
    page_id is stored in full and refers to nothing; rows that share the largest
    page_id are all stored. Other columns are ignored; an empty table gives no
    row. The archives stay in ``folder`` (a new one below spark.checkpoint.dir).
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    return merged_index(write(pages, folder), folder, spark)
