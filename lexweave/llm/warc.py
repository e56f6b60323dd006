"""WARC archives: writing, reading back, and an external merge of their capture indexes.

Writing.  Each page becomes a WARC/1.1 record in a gzip member of its own, so a
record can be read at its offset.  Spark's text writer lays down the bytes, on
any file system and under its commit protocol, so lost tasks leave nothing
behind.  The writer ends each row with a separator: a member ends in a zero byte
whenever its content is below 16 MiB, so rows lack that byte and the separator
is it; after a larger record an empty member follows, which also ends in zero.

A row is a bundle of members, and a file takes a fixed number of rows, so
archives are bounded by bytes: 64 MiB, or more where single records are larger
than a bundle.  The job's commit stands before files get their ending, and
nothing reads them until all have it; a run that fails in between is repeated
in a new folder.

Equal payloads of at least ``REVISIT_BYTES`` are stored once: the smallest key
is the response, others are revisits that refer to it.

Index.  Reading an archive gives its captures; sorted by URL key, time and page,
they are one run.  Spark's range partitioning cuts the key space by whole sort
keys, so one URL's captures may span ranges.  For each range a loser tree merges
the runs' parts (k-way, log2 k comparisons a capture).  Ranges in order, and
positions in them, are the global order.

Defined cases: null html is an empty payload; a null URL is left out of the
record and sorts first; a null key is a capture of its own, always a response;
rows with equal keys are each written, as responses where their key is the
payload's smallest; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, scratch_path, whole_groups

#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Captures in a range of the merged index, about.
RANGE_CAPTURES = 50_000
#: An archive file: so many bundles of records at most, each of so many bytes (or one larger record), and so many records in all.
BUNDLES, BUNDLE_BYTES, ARCHIVE_RECORDS = 16, 4 << 20, 20_000
#: The pages have no capture times: page k counts as captured k seconds after this.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
_SPACE = uuid.UUID("5b2f5f0e-6f5e-4c58-9f0d-0f7a4b0c6d11")


# ---------------------------------------------------------------- records --
def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(key))}>"


def capture_time(key: int | None) -> str:
    return (FIRST_CAPTURE + timedelta(seconds=(key or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path: captures of a site sort together."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + slash + path.split("#", 1)[0]


def _header(fields: list[tuple[str, str | None]], size: int) -> bytes:
    clean = lambda v: "".join(c if c > " " or c == " " else f"%{ord(c):02X}" for c in v)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v) + f"Content-Length: {size}\r\n\r\n").encode()


def response_record(key: object, url: str | None, payload: bytes, digest: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return _header(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", capture_time(key)), ("WARC-Target-URI", url),
            ("WARC-Page-Key", None if key is None else str(key)), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("Content-Type", "application/http; msgtype=response")
        ],
        len(block)
    ) + block + b"\r\n\r\n"


def revisit_record(key: object, url: str | None, digest: str, first: object, first_url: str | None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return _header(
        [
            ("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", capture_time(key)), ("WARC-Target-URI", url),
            ("WARC-Page-Key", str(key)), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first)),
            ("WARC-Refers-To-Target-URI", first_url), ("WARC-Refers-To-Date", capture_time(first)), ("WARC-Refers-To-Page-Key", str(first)),
            ("Content-Type", "application/http; msgtype=response")
        ],
        len(block)
    ) + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as gzip members, the last of which ends in a zero byte."""
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    out = squeeze.compress(record) + squeeze.flush()
    if out[-1]:
        squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
        out += squeeze.compress(b"") + squeeze.flush()
    return out


def members(data: memoryview, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive; empty ones are skipped."""
    at = 0
    while at < len(data):
        unpack, parts, pos = zlib.decompressobj(31), [], at
        while not unpack.eof and pos < len(data):
            parts.append(unpack.decompress(data[pos : pos + step]))
            pos += step
        if not unpack.eof:
            raise ValueError(f"the archive ends within the member at {at}")
        end = min(pos, len(data)) - len(unpack.unused_data)
        content = b"".join(parts)
        if content:
            yield at, end - at, content
        at = end


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record; the block's length is checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


# ---------------------------------------------------------------- writing --
def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write every page as a record into gzip archives under ``path``."""
    source = pages.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload")
    )
    source = source.withColumn("digest", F.sha2("payload", 256))
    light = materialize(source.filter((F.octet_length("payload") >= REVISIT_BYTES) & F.col("key").isNotNull()).select("key", "url", "digest"), "warc-digests")
    firsts = light.groupBy("digest").agg(
        F.min("key").alias("first"), F.min_by("url", "key").alias("first_url"), F.max("key").alias("last")
    ).filter("first <> last").drop("last")
    refers = light.select("key", "digest").join(firsts, "digest").filter("key <> first").distinct()
    dealt = source.join(
        refers.withColumnRenamed("key", "rkey").withColumnRenamed("digest", "rdigest"),
        (F.col("key") == F.col("rkey")) & (F.col("digest") == F.col("rdigest")), "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _header(
            [
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(uuid.uuid4())), ("WARC-Date", capture_time(0)),
                ("Content-Type", "application/warc-fields")
            ],
            0
        ) + b"\r\n\r\n"
        most = max(1, ARCHIVE_RECORDS // BUNDLES)
        out, size = [member(info)], 0

        def bundle() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["value"])

        empty = True
        for batch in batches:
            for k, u, p, d, f, fu in zip(*(batch.column(c) for c in ("key", "url", "payload", "digest", "first", "first_url")), strict=True):
                k, u, f = k.as_py(), u.as_py(), f.as_py()
                record = member(response_record(k, u, p.as_py(), d.as_py()) if f is None else revisit_record(k, u, d.as_py(), f, fu.as_py()))
                if out and (size + len(record) > BUNDLE_BYTES or len(out) >= most) and not empty:
                    yield bundle()
                    out, size = [], 0
                out.append(record)
                size += len(record)
                empty = False
        if not empty:
            yield bundle()

    rows = map_arrow(dealt.select("key", "url", "payload", "digest", "first", "first_url"), run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", BUNDLES).text(path)
    _rename(pages.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Archives get the ending of their kind."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


# ---------------------------------------------------------------- reading --
CAPTURE = "url_key string, captured string, key bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint, length bigint"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, sorted within each archive: the archives' runs.

    ``payload_bytes`` and ``payload_digest`` of a response are those of the
    payload that was read, which must agree with the record's field; a revisit
    has the digest of its field and no size of its own.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        kinds = [pa.int64() if c.endswith("bigint") else pa.string() for c in CAPTURE.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, archive = [], path.as_py().rsplit("/", 1)[-1]
                for offset, length, record in members(memoryview(content.as_buffer())):
                    fields, block = parse(record)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    key, url, size = fields.get("WARC-Page-Key"), fields.get("WARC-Target-URI"), None
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"{archive}: the record at {offset} is damaged")
                    refers = fields.get("WARC-Refers-To-Page-Key")
                    rows.append(
                        (
                            url_key(url), fields["WARC-Date"], key if key is None else int(key), url, size, digest, fields["WARC-Type"],
                            refers if refers is None else int(refers), archive, offset, length
                        )
                    )
                rows.sort(key=sort_key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names
                )

    return map_arrow(files, run, CAPTURE)


def sort_key(row: tuple) -> tuple:
    """URL key, time, page, then the record's place: a total order."""
    return row[0], row[1], -1 if row[2] is None else row[2], row[8], row[9]


# ---------------------------------------------------------------- merging --
class LoserTree:
    """Merge of k sorted lists: inner nodes keep the losers, the root's winner comes out next."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * len(runs)
        self.heads = [self._head(i) for i in range(len(runs))] or [(1,)]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._enter(i)

    def _head(self, i: int) -> tuple:
        """(0, key) of a run's next row, or (1,) at its end: ends lose to all rows."""
        return (0, self.key(self.runs[i][self.at[i]]), i) if self.at[i] < len(self.runs[i]) else (1,)

    def _enter(self, i: int) -> None:
        """Let run ``i`` play from its leaf; while the tree is being filled, it waits at the first free node."""
        winner, node = i, (i + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0:
                self.loser[node] = winner
                return
            if self.heads[other] < self.heads[winner]:
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while self.heads[w := self.loser[0]] != (1,):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self._head(w)
            self._enter(w)


def merge_index(captures: DataFrame) -> DataFrame:
    """All captures with ``range`` and ``position``: together the global order by URL key, time and page.

    ``captures``: sorted runs, one per archive (:func:`read_captures`), stored.
    """
    ranges = int(captures.count() // RANGE_CAPTURES) + 1
    page = F.coalesce("key", F.lit(-1))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["range"]):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(a, b - a).combine_chunks()
                keys = list(zip(*(part.column(c).to_pylist() for c in ("url_key", "captured", "key", "archive", "offset")), range(b - a), strict=True))
                keys = [(u, t, -1 if k is None else k, r, o, i) for u, t, k, r, o, i in keys]
                starts = [i for i in range(b - a) if not i or keys[i][3] != keys[i - 1][3]]
                runs = [keys[i:j] for i, j in zip(starts, [*starts[1:], b - a], strict=True)]
                order = [k[5] for k in LoserTree(runs, key=lambda k: k[:5])]
                out = part.take(pa.array(order)).append_column("position", pa.array(np.arange(len(order))))
                yield from out.combine_chunks().to_batches()

    parts = captures.repartitionByRange(ranges, "url_key", "captured", page, "archive", "offset").withColumn("range", F.spark_partition_id())
    placed = T.StructType([*parts.schema.fields, T.StructField("position", T.LongType())])
    return map_arrow(parts.sortWithinPartitions("archive", "url_key", "captured", page, "offset"), merge, placed)


def capture_histories(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write, read back and merge: every capture in global order, revisits with the size of what they refer to."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, **columns)
    captures = materialize(read_captures(spark, path), "warc-runs")
    merged = materialize(merge_index(captures), "warc-index")
    sizes = merged.filter("record_type = 'response' AND key IS NOT NULL").groupBy("key", "payload_digest").agg(F.max("payload_bytes").alias("referred_bytes"))
    out = merged.join(sizes.select(F.col("key").alias("refers_to"), "payload_digest", "referred_bytes"), ["refers_to", "payload_digest"], "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "referred_bytes")).select(*merged.columns)
