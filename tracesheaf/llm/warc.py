"""WARC archives of page tables, read back into globally ordered capture histories.

Writing goes through Spark's text writer: a record is header, blank line and block, and the line separator is the
two CRLF that end a record. Reading parses by Content-Length, never by separator. The index is an external merge: each
archive is parsed once and gives a run of captures, written to the shared folder; runs are dealt by key ranges of bounded size,
sorted where they arrive, and a loser tree merges the runs of each range.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesheaf.llm.common import scratch_path, written

REVISIT_BYTES = 100
#: Records and usual bytes of one archive file at most; captures of one range of the index.
FILE_RECORDS, FILE_BYTES, RANGE_ROWS = 4096, 64 << 20, 200_000
_CRLF = "\r\n"
INDEX = "urlkey string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long, verified boolean"


def surt(url: Column) -> Column:
    """URL key: the host's labels from the right, then path and query, lower case, without scheme, ``www.`` or fragment."""
    u = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(u, r"^([^/?]*)", 1), r"^www\d*\.|:\d+$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(u, r"^[^/?]*(.*)$", 1))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip") -> None:
    """Write one record for each row of ``pages`` under ``path``; payloads are the html in UTF-8, null as empty.

    Of records with equal payloads of at least REVISIT_BYTES bytes, those with the smallest id are responses and the others
    revisits of it; rows that repeat that id are responses as well. A file takes as many records as FILE_BYTES holds of the mean payload. A null id is written as ``-``, is never referred to
    while another id is there, and sorts last. Line ends in URLs are percent-encoded. The capture time is the id in seconds after
    2024-01-01 (null: 0), as the tables hold none.
    """
    body = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    body = body.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha2("html", 256))
    mean = pages.agg(F.avg(F.octet_length(html))).first()[0] or 0
    records_a_file = int(max(1, min(FILE_RECORDS, FILE_BYTES // (mean + 1))))
    keys = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    first = keys.where(F.octet_length("html") >= REVISIT_BYTES).groupBy(F.sha2("html", 256).alias("digest"))
    first = first.agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    rows = body.join(first, "digest", "left").withColumn("revisit", (F.col("n") >= REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(3_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("n"), F.lit(_CRLF * 2))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "html"))
    refers = F.when(F.col("revisit"), F.concat(F.lit(f"{_CRLF}WARC-Refers-To: <urn:page:"), F.col("first"), F.lit(f">{_CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise("")
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit(f"{_CRLF}WARC-Record-ID: "), name,
        F.lit(f"{_CRLF}WARC-Target-URI: "), target, F.lit(f"{_CRLF}WARC-Date: "), at, F.lit(f"{_CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"), refers,
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), F.octet_length(block), F.lit(_CRLF * 2), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", _CRLF * 2).option("compression", compression).option("maxRecordsPerFile", records_a_file).text(path)


class _Stream:
    """Bytes of one archive, inflated as they are asked for."""

    def __init__(self, content: bytes):
        self.rest, self.buffer, self.at = memoryview(content), bytearray(), 0
        self.inflate = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if not len(self.rest):
            return False
        chunk, self.rest = bytes(self.rest[: 1 << 16]), self.rest[1 << 16 :]
        while chunk:
            if self.inflate is None:
                self.buffer += chunk
                break
            self.buffer += self.inflate.decompress(chunk)
            chunk = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                return None
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.at += len(out)
        return out


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, block) of each record; offsets count inflated bytes."""
    s = _Stream(content)
    while (head := s.until(b"\r\n\r\n")) is not None:
        begin = s.at - len(head)
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {begin}")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        n = int(fields["content-length"])
        block = s.take(n)
        if len(block) != n or s.take(4) != b"\r\n\r\n":
            raise ValueError(f"a record is cut short at {begin}")
        yield begin, s.at - begin, fields, block


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            cols: list[list] = [[] for _ in range(10)]
            for begin, length, f, block in records(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
                digest = f["warc-payload-digest"].removeprefix("sha256:")
                whole = f["warc-type"] != "response" or len(payload) == size and hashlib.sha256(payload).hexdigest() == digest
                for c, v in zip(cols, (f["warc-date"], _page(f["warc-record-id"]), f["warc-target-uri"], size, digest, f["warc-type"], _page(f.get("warc-refers-to")), begin, length, whole)):
                    c.append(v)
            n = len(cols[0])
            if n:
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                names = ["ts", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "length", "verified"]
                arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                yield pa.record_batch([*arrays, pa.array([path.as_py()] * n)], names=[*names, "file"])


class LoserTree:
    """k-way merge of sorted lists: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _head(self, i: int):
        return (1, None) if i < 0 or self.at[i] >= len(self.runs[i]) else (0, self.key(self.runs[i][self.at[i]]))

    def _less(self, i: int, j: int) -> bool:
        (x, a), (y, b) = self._head(i), self._head(j)
        return x < y or x == y == 0 and (a < b or a == b and i < j)

    def _play(self, i: int) -> None:
        """Carry run i towards the root; where a match has no opponent yet, it waits there."""
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                if self.filling:
                    self.tree[node] = i
                    return
            elif self._less(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    filling = True

    def __iter__(self):
        self.filling = False
        while self.tree[0] >= 0 and self.at[w := self.tree[0]] < len(self.runs[w]):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


def read_index(spark, path: str, partitions: int | None = None) -> DataFrame:
    """Capture histories of the archives under ``path`` (columns INDEX), in global order of (urlkey, ts, page_id).

    A range holds about RANGE_ROWS captures or fewer (``partitions``: so many ranges); equal keys are cut apart by time, id and place, so a
    hot URL spreads as well. ``verified`` tells whether a response's payload has its stated length and digest. An empty folder gives no rows.
    Offsets and lengths count bytes of the archive as it is inflated; with compression ``none`` they can be sought.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    names = "ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long, verified boolean, file string"
    columns = [c.split()[0] for c in INDEX.split(", ")]
    order = ["urlkey", "ts", "page_id", "file", "offset"]
    runs = written(files.mapInArrow(_captures, names).withColumn("urlkey", surt(F.col("url"))).select(*columns), "runs")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(n, F.col("urlkey"), F.col("ts"), F.asc_nulls_last("page_id"), F.col("file"), F.col("offset"))
    dealt = dealt.sortWithinPartitions("file", "urlkey", "ts", F.asc_nulls_last("page_id"), "offset")  # runs one after the other

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        urlkey, ts, page, file, offset = (table[c].to_pylist() for c in order)
        begins = [0, *[i for i in range(1, len(file)) if file[i] != file[i - 1]], len(file)]
        key = lambda i: (urlkey[i], ts[i], page[i] is None, page[i] or 0, file[i], offset[i])
        merged = list(LoserTree([range(b, e) for b, e in zip(begins, begins[1:])], key))
        yield from table.take(pa.array(merged, pa.int64())).to_batches(max_chunksize=4096)

    return dealt.mapInArrow(merge, INDEX)


def archive(pages: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Write ``pages`` as WARC under ``path`` (default: a new folder in the shared one) and return the index read back from it.

    A payload that does not come back as it was written is an error of the job that reads the index.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **names)
    index = read_index(pages.sparkSession, path)
    broken = F.raise_error(F.concat(F.lit("payload differs in "), "file", F.lit(" at "), F.col("offset").cast("string"))).cast("boolean")
    return index.where(F.when(F.col("verified"), True).otherwise(broken))
