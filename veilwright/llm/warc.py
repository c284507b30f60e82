"""WARC archives of a table of pages, and their index merged from sorted runs.

*Writing.* A record is built as one string in the JVM and written by Spark's
text writer with the record separator as line separator, so archives land
wherever Spark can write. Of equal payloads of at least ``REVISIT_FROM`` bytes
the one with the largest page_id is a response; the others are revisit records
that refer to it and hold its HTTP header only. Pages are written where they are
read, without a shuffle; an archive has as many records as take about
``ARCHIVE_BYTES`` on average. Offsets are those of the unpacked archive.

*Reading.* Archives are read as binary files and parsed record by record by
Content-Length; digests of payloads are computed again and compared.

*Index.* Each archive gives one run of captures, sorted by URL key, timestamp
and page. The runs are dealt to ranges of that order, and within a range they
are merged by a loser tree of as many leaves as there are runs, which gives
capture histories in global order. A URL that has a third of all captures is cut
by timestamp, so no range is larger than others.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_path

REVISIT_FROM = 1000
ARCHIVE_BYTES = 16_000_000
RANGE_ROWS = 100_000
#: Date of page 0; a page's own date is as many seconds later as its id.
EPOCH = 1_700_000_000
_CRLF = "\r\n"


def classified(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, n, sha1, refers_to): refers_to is null for responses."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "sha1": F.sha1("html"), "sha256": F.unhex(F.sha2("html", 256))})
    big = rows.filter(F.col("n") >= REVISIT_FROM)
    same = big.groupBy(F.col("sha256").alias("k"), F.col("n").alias("kn")).agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("last"))
    same = materialise(same.filter("copies > 1 AND last IS NOT NULL").select("k", "kn", "last"), "equal-payloads")
    rows = rows.join(same, (F.col("sha256") == F.col("k")) & (F.col("n") == F.col("kn")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.select("page_id", "url", "html", "n", "sha1", refers.alias("refers_to"))


def _record(n: Column) -> Column:
    """The whole record but for the two line ends after it."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))

    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    at = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod(F.col("page_id"), F.lit(10**9)), F.lit(0)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=UTF-8{_CRLF}"), line("Content-Length", n.cast("string")), F.lit(_CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{_CRLF}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_CRLF),
    )
    return F.concat(head, block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, compression: str = "none") -> None:
    """Write a record per row; archives are compressed as a whole with "gzip". A null html is an empty payload, a null url an empty one, a null page_id is 'none'.

    Of repeated rows with the largest page_id each is a response. An empty table
    gives a folder without records.
    """
    rows = classified(pages, id_col, url_col, html_col)
    n, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(html_col)), F.lit(0))).first()
    most = max(1, archive_bytes * n // max(1, size + 700 * n))
    writer = rows.select(_record(F.col("n")).alias("value")).write.option("lineSep", _CRLF * 2)
    writer.option("maxRecordsPerFile", most).option("compression", compression).text(path)


def url_key(url: str) -> str:
    """Host in reversed order, then path and query: com,example)/path?query."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    return (",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")).lower()


def parse(content: memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, header, block) of each record of an archive."""
    at, end = 0, len(content)
    while at < end:
        head, size = b"", 1024
        while (stop := head.find(b"\r\n\r\n")) < 0:
            if at + len(head) >= end:
                raise ValueError(f"no end of a record's header at byte {at}")
            head, size = bytes(content[at : at + size]), 2 * size
        lines = head[:stop].decode("utf-8").split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        header = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        begin = at + stop + 4
        after = begin + int(header["content-length"])
        if bytes(content[after : after + 4]) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield at, after + 4 - at, header, content[begin:after]
        at = after + 4


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value and value != "none" else None


INDEX = "url_key string, captured_at string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"
_FIELDS = [x.split()[0] for x in INDEX.split(", ")]
_KINDS = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]


def _order(x: tuple) -> tuple:
    return x[0], x[1], x[2] is not None, x[2] or 0, x[8], x[9]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive, in order within it; the digest of each response's payload is proved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, body in zip(b.column(0), b.column(1), strict=True):
                rows = []
                content = memoryview(body.as_buffer())
                if bytes(content[:2]) == b"\x1f\x8b":  # an archive has about ARCHIVE_BYTES unpacked
                    content = memoryview(gzip.decompress(content))
                for offset, length, header, block in parse(content):
                    raw = bytes(block)
                    http, _, payload = raw.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest = header["warc-payload-digest"].removeprefix("sha1:")
                    if header["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: the payload at byte {offset} has another digest")
                    url = header.get("warc-target-uri", "")
                    rows.append((url_key(url), header["warc-date"], _page(header["warc-record-id"]), url, header["warc-type"], n, digest, _page(header.get("warc-refers-to")), name.as_py(), offset, length))
                rows.sort(key=_order)
                cols = zip(*rows, strict=True) if rows else [[] for _ in _FIELDS]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _KINDS, strict=True)], names=_FIELDS)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


class LoserTree:
    """Merge of sorted iterators: each inner node remembers the loser of its match, the winner goes up."""

    def __init__(self, sources: list[Iterator], key):
        self.key, self.sources, self.k = key, sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """-1 beats all while the tree is filled; an ended source loses; ties go to the earlier run."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and x is not None or (x is None and y is None and a < b)
        return x < y or (x == y and a < b)

    def _play(self, i: int) -> None:
        winner, at = i, (i + self.k) // 2
        while at:
            if self._beats(self.loser[at], winner):
                winner, self.loser[at] = self.loser[at], winner
            at //= 2
        self.loser[0] = winner

    def __iter__(self):
        while self.k and self.heads[w := self.loser[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            self._play(w)


def merged_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs in the order of URL key, timestamp and page, in ranges of about ``range_rows``."""
    n = max(1, -(-captures.count() // range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come run by run, each in its own order.
        by_run: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            name = b.column(8)
            edges = [0, *(i for i in range(1, b.num_rows) if name[i] != name[i - 1]), b.num_rows] if b.num_rows else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                by_run.setdefault(name[lo].as_py(), []).append(b.slice(lo, hi - lo))

        def rows(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
            for p in parts:
                yield from zip(*(c.to_pylist() for c in p.columns), strict=True)

        out: list[tuple] = []
        for x in LoserTree([rows(v) for _, v in sorted(by_run.items())], _order):
            out.append(x)
            if len(out) == 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_FIELDS)

    order = ["url_key", "captured_at", "page_id", "archive", "offset"]
    dealt = captures.repartitionByRange(n, *order).sortWithinPartitions("archive", *order[:3], "offset")
    return dealt.mapInArrow(run, INDEX)


def archive_and_index(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write the archives below ``path`` (by default a new folder of the shared ones), read them back and return the merged index."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "archives")
    write_archives(pages, path, **kw)
    return merged_index(materialise(runs(spark, path), "index-runs"))
