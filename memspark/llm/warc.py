"""WARC archives and a globally ordered capture index.

Writing: each page becomes one WARC/1.1 record, a `response` or, where an earlier page
has the same payload of at least `MIN_REVISIT` bytes, a `revisit` without payload. Every
record is a gzip member of its own, so a reader can seek to it: `record_offset` is the
member's place in the packed file. A task closes an archive at `ARCHIVE_BYTES` of packed
records. An archive's name holds the task's attempt, and only archives that a finished
task has listed are read, so a lost executor leaves at worst a file nobody names.

Reading: a task reads a listed archive member by member and sorts its index rows: a run.
External merge: rows are dealt into key ranges by one exchange, which keeps each run's own
order; in each range a k-way loser tree merges the runs by URL key and capture time. A run
waits in memory or, beyond `HELD_BYTES` of a range, in a scratch file of the task, and the
tree holds one chunk of each run; more than `FAN_IN` runs are merged in several passes.
Range r comes before range r + 1, so the merged index is globally ordered; capture time
and page id are part of the key, so a hot host or URL is split like any other.

Hot payloads: digests are joined without payloads, and the table of revisits is written
out, so the pages meet it by page id and digest, which no group of copies shares.

Nulls: a null html is an empty payload, a null url gives a record without a target and
sorts first, a null page id is never referred to. Equal rows: all copies of the
smallest page id are responses. Payloads under 100 bytes are never revisits. A long page
is one record, held once by its task. A url's line ends are written as %0D and %0A, as
the index has them. Other columns aren't read; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import discard, materialize, remove, shared_path, slices

MIN_REVISIT = 100
GAP = "\r\n\r\n"
#: Packed bytes of one archive, and index bytes aimed at in one merged range.
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 64 << 20
#: Bytes of a range's runs that wait in memory, runs merged at once, and rows of a run held as objects.
HELD_BYTES, FAN_IN, CHUNK = 64 << 20, 256, 256
#: Pages carry no capture time; the archive dates page n to this moment (UTC, midnight) plus n seconds, n modulo DATED.
FIRST_CAPTURE = "2024-01-01 00:00:00"
DATED = 1 << 32
INDEX = "url_key string, capture_ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"
RUN = INDEX + ", seq long"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first_id) of the pages whose payload an earlier one holds."""
    facts = pages.select("page_id", F.octet_length("html").alias("size"), F.sha2("html", 256).alias("digest")).filter(F.col("size") >= MIN_REVISIT).select("page_id", "digest")
    facts = materialize(facts, "warc-digests")
    firsts = facts.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first_id")
    firsts = materialize(firsts, "warc-firsts")  # written out, so AQE can split the rows of a common payload
    out = facts.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()).distinct()
    out = materialize(out, "warc-revisits")
    discard(facts, firsts)
    return out


def records(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One text column `value` with a WARC record per page, its closing CR LF CR LF included."""
    body = pages.select("page_id", "url", "html", F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("digest"))
    known = found.select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), F.col("first_id").alias("refers_to"))
    pages = body.join(known, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    # Days and seconds from the first moment, which is midnight in UTC: no session time zone has a say.
    late = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(DATED))
    day = F.date_add(F.lit(FIRST_CAPTURE[:10]).cast("date"), F.floor(late / 86_400).cast("int")).cast("string")
    two = lambda seconds, unit: F.lpad((F.floor(late % seconds / unit)).cast("string"), 2, "0")
    stamp = F.concat(day, F.lit("T"), two(86_400, 3600), F.lit(":"), two(3600, 60), F.lit(":"), two(60, 1), F.lit("Z"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", stamp),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block)),
    )
    return pages.select(F.concat(head, F.lit(GAP), block, F.lit(GAP)).alias("value"))


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as Arrow knows it, and the path there."""
    for name in ("s3a://", "s3n://"):
        path = path.replace(name, "s3://", 1) if path.startswith(name) else path
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write archives below path; their names, records and packed bytes.

    The pages come as the join on page ids deals them, so no task gets a group of copies.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    found = revisits(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        task = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out = None
        store.create_dir(root, recursive=True)
        for batch in slices(batches, 16):
            for value in batch.column(0):
                if out is None:
                    name = f"part-{task.partitionId():06}-{len(done):04}-{task.taskAttemptId()}.warc.gz"
                    out, count, size = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(value.as_buffer()) + pack.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["archive", "records", "bytes"])

    listed = materialize(records(own, found).mapInArrow(run, "archive string, records long, bytes long"), "warc-listed")
    discard(found)
    return listed


def url_key(url: str | None) -> str:
    """Host labels reversed, then the rest: com,example,www)/path."""
    if url is None:
        return ""
    _, scheme, rest = url.partition("://")
    rest = rest if scheme else url
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def members(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Packed offset and content of each gzip member of a stream; one member is held at a time."""
    at, data = 0, b""
    while data or (data := stream.read(size)):
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data and not (data := stream.read(size)):
                raise ValueError(f"the member at {at} is cut off")
            try:
                parts.append(unpack.decompress(data))
            except zlib.error as e:
                raise ValueError(f"no gzip member at {at}") from e
            used += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        yield at, b"".join(parts)
        at += used


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    if raw[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit")
    return head, block


def index_entry(archive: str, offset: int, head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    said = head["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")).split(b": ")[1])
    if head["WARC-Type"] == "response":
        size, said = len(payload), hashlib.sha256(payload).hexdigest()
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    taken = datetime.strptime(head["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    seconds = (taken - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(seconds=1)
    return (url_key(head.get("WARC-Target-URI")), seconds, number(head["WARC-Record-ID"]), size, said, head["WARC-Type"], number(head.get("WARC-Refers-To")), archive, offset)


def _key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[7], row[8]


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in fields.split(", "))])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_runs(listed: DataFrame, path: str) -> DataFrame:
    """Index rows of the listed archives; those of an archive are a run, `seq` is their order in it."""
    parts = max(1, listed.count())
    schema = _schema(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = sorted((index_entry(name, at, *parse_record(raw)) for at, raw in members(stream)), key=_key)
                for k in range(0, len(rows), 10_000):
                    yield _rows([(*r, k + j) for j, r in enumerate(rows[k : k + 10_000])], schema)

    return listed.select("archive").repartition(parts).mapInArrow(run, RUN)  # round robin: an archive is a task's work


class LoserTree:
    """Merges sorted runs; each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [self._next(i) for i in range(len(self.runs))]
        self.losers = [-1] * self.k
        for i in range(len(self.runs)):
            self._replay(i, building=True)

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (_key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _replay(self, i: int, building: bool = False) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[best := self.losers[0]]) is not None:
            yield head[2]
            self.heads[best] = self._next(best)
            self._replay(best)


class Runs:
    """Sorted runs of one task as Arrow batches, in memory up to a bound, then in a scratch file of the task."""

    def __init__(self, held_bytes: int, chunk: int = CHUNK) -> None:
        self.held_bytes, self.chunk = held_bytes, chunk
        self.runs: list[list] = []
        self.size = 0
        self.scratch = None

    def open(self) -> None:
        self.runs.append([])

    def add(self, batch: pa.RecordBatch) -> None:
        for k in range(0, len(batch), self.chunk):
            part = batch.slice(k, self.chunk)
            if self.size + part.nbytes <= self.held_bytes:
                self.size += part.nbytes
                # A slice would keep its whole batch in memory.
                self.runs[-1].append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema))
                continue
            if self.scratch is None:
                self.scratch = tempfile.TemporaryFile()
            packed = part.serialize()
            at = self.scratch.seek(0, 2)
            self.scratch.write(packed)
            self.runs[-1].append((at, packed.size, part.schema))

    def rows(self, run: list) -> Iterator[tuple]:
        for item in run:
            if isinstance(item, tuple):
                at, size, schema = item
                self.scratch.seek(at)
                item = pa.ipc.read_record_batch(pa.py_buffer(self.scratch.read(size)), schema)
            yield from zip(*(c.to_pylist() for c in item.columns), strict=True)

    def merged(self, schema: pa.Schema, fan_in: int = FAN_IN) -> Iterator[tuple]:
        """All rows in order; while there are more runs than fan_in, that many become one."""
        while len(self.runs) > fan_in:
            some, self.runs = self.runs[:fan_in], self.runs[fan_in:]
            self.open()
            out: list[tuple] = []
            for row in LoserTree([self.rows(r) for r in some]):
                out.append(row)
                if len(out) == 4096:
                    self.add(_rows(out, schema))
                    out = []
            if out:
                self.add(_rows(out, schema))
        yield from LoserTree([self.rows(r) for r in self.runs])


def merge_runs(runs: DataFrame, range_bytes: int = RANGE_BYTES, held_bytes: int = HELD_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """The index in global order of (url_key, capture_ts, page_id): partition by partition, row by row."""
    spark = runs.sparkSession
    size = runs.agg(F.sum(F.octet_length("url_key") + F.octet_length("archive") + 128)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes)
    # Only the exchange knows the key; within a range the rows come run by run, each in its own order.
    ranged = runs.repartitionByRange(parts, "url_key", "capture_ts", F.col("page_id").asc_nulls_last(), "archive", "record_offset").sortWithinPartitions("archive", "seq")
    schema = _schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Runs(held_bytes)
        current = None
        for batch in batches:
            batch = batch.select(schema.names)
            names = batch.column(7).to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if names[a] != current:
                        current = names[a]
                        held.open()
                    held.add(batch.slice(a, b - a))
        out: list[tuple] = []
        for row in held.merged(schema, fan_in):
            out.append(row)
            if len(out) == 4096:
                yield _rows(out, schema)
                out = []
        if out:
            yield _rows(out, schema)

    return ranged.mapInArrow(run, INDEX)


def capture_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write archives of pages below path, read them back and merge their index runs; without a path the archives are scratch."""
    spark = pages.sparkSession
    where = path or shared_path(spark, "warc")
    listed = write_archives(pages.select("page_id", "url", "html"), where)
    runs = materialize(read_runs(listed, where), "warc-runs")
    discard(listed)
    if not path:
        remove(spark, where)
    return merge_runs(runs)
