"""A deterministic sharded WARC writer, and a reader of what it wrote.

Records are range-sorted by page id into shards whose bounds come from the data alone; each shard rolls its files by
compressed size; headers, record ids and digests are made anew from the payload. Tasks write under temporary names and
report them through a written manifest, of which Spark keeps one attempt; only then do the files get their names.
Payloads that occur before (same bytes, at least `least` of them) become revisit records.

The same rows give the same bytes, whatever the partitions of the input. A lost executor costs its tasks' temporary files, never a committed one.

Defined results: a null payload is empty; a null page id sorts first, stays a record, and is a revisit only of a page that has an id;
of repeated rows with one id and payload the first is the response and the others revisit it; an empty table gives no
file; columns other than the three named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import batches, filesystem, fresh_dir, written

MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, nth long"
#: Sampled rows from which the shards' bounds are read: so many a shard, and at least.
BOUND_ROWS, LEAST_ROWS = 16, 8192
#: Bounds that the driver holds. Beyond this many shards (4 TB of payloads by the usual size) a shard grows, and its files do not.
MOST_SHARDS = 65_536
SPACE = uuid.UUID("9b2f6f5e-5a0c-5d0e-8f55-3f6f2b1c7a10")


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{nth}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, nth: int, refers: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, whose Content-Length tells the full payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    own = "null" if page_id is None else str(page_id)
    target = "".join(c for c in url or "" if c > " ") or f"urn:page:{own}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest, nth)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Page-ID: {own}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: {record_id(refers, digest, 0)}", f"WARC-Refers-To-Page-ID: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(raw: bytes, level: int) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Roller:
    """The files of one shard, each at most one record longer than the size to roll at."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, level: int, date: str):
        self.fs, self.path = filesystem(folder)
        self.shard, self.roll, self.level, self.date, self.seq, self.out = shard, roll_bytes, level, date, 0, None

    def add(self, raw: bytes) -> tuple | None:
        if self.out is None:
            self.temporary, self.name = f"_temporary/{uuid.uuid4().hex}", f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.out, self.records, self.bytes, self.sha = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
            info = b"software: sievelake\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, self.name, 0)}\r\nWARC-Date: {self.date}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            self._write(_member(head.encode() + info + b"\r\n\r\n", self.level))
        self._write(_member(raw, self.level))
        self.records += 1
        return self.close() if self.bytes >= self.roll else None

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sha.update(raw)
        self.bytes += len(raw)

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.seq += 1
        return (self.shard, self.seq - 1, self.temporary, self.name, self.records, self.bytes, self.sha.hexdigest())


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_MANIFEST = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("nth", pa.int64())])


def bounds(keys: DataFrame, shard_bytes: int) -> list[int]:
    """The page ids at which shards begin, of about equal bytes; from a sample by hash that grows with the shards."""
    total, n = keys.agg(F.sum("n"), F.count(F.lit(1))).first()
    shards = min(MOST_SHARDS, -(-(total or 0) // shard_bytes))
    if shards < 2:
        return []
    most = max(LEAST_ROWS, BOUND_ROWS * shards)
    sample = keys.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))))
    rows = sorted((r.page_id, r.n + 200) for r in sample.orderBy(F.xxhash64("page_id"), "page_id").select("page_id", "n").limit(most).collect())
    weight, at, out = sum(n for _, n in rows), 0, []
    for page_id, n in rows:
        if at >= weight * (len(out) + 1) / shards and (not out or page_id > out[-1]):
            out.append(page_id)
        at += n
    return out


def shard_of(cuts: list[int], width: int = 256) -> Column:
    """How many of the ascending cuts are at most the page id: counted in one block of `width` cuts, found by the blocks' first ones.

    The cuts are constants made from text, so that a plan with tens of thousands of them stays small.
    """
    numbers = lambda own: F.split(F.lit(",".join(map(str, own))), ",").cast("array<bigint>")
    upto = lambda own: F.size(F.filter(own, lambda b: b <= F.col("page_id")))
    if not cuts:
        return F.lit(0)
    if len(cuts) <= width:
        found = upto(numbers(cuts))
    else:
        block = upto(numbers(cuts[::width]))
        found = F.when(block == 0, 0).otherwise((block - 1) * width + upto(F.slice(numbers(cuts), F.greatest(block - 1, F.lit(0)) * width + 1, F.lit(width))))
    return F.when(F.col("page_id").isNull(), 0).otherwise(found).cast("int")


def write(pages: DataFrame, folder: str, least: int = 100, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, level: int = 5, date: str = "1970-01-01T00:00:00Z", id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Write the archives into the folder (a URI that driver and executors share); the manifest of the named files."""
    spark = pages.sparkSession
    batches(spark)
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(payload_column).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    keys = written(rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n")), "warc-keys")
    cuts = bounds(keys, shard_bytes)
    shard = shard_of(cuts)
    # what revisits what travels as small rows that sort before the pages they speak of, so payloads move once
    first = keys.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null").select("digest", "first")
    marks = keys.join(first, "digest").select("page_id", "digest", "first").distinct()
    both = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first"))
    both = both.unionByName(marks.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first"))
    dealt = both.withColumn("shard", shard).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, mark, nth = None, None, None, 0
        for frame in frames:
            done = []
            columns = [frame.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
            payloads = frame.column(4)
            for i, (page_id, digest, kind, url, first_id, k) in enumerate(zip(*columns, strict=True)):
                if roller is None or roller.shard != k:
                    if roller:
                        done.append(roller.close())
                    roller = _Roller(folder, k, roll_bytes, level, date)
                if (page_id, digest) != at:
                    at, mark, nth = (page_id, digest), None, 0
                if kind == 0:
                    mark = first_id
                    continue
                refers = mark if mark is not None and (mark != page_id or nth) else None
                done.append(roller.add(record(page_id, url, payloads[i].as_py(), digest, nth, refers, date)))
                nth += 1
            if done := [x for x in done if x]:
                yield _rows(done, _MANIFEST)
        if roller and (last := roller.close()):
            yield _rows([last], _MANIFEST)

    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/_temporary", recursive=True)
    manifest = written(dealt.mapInArrow(run, MANIFEST), "warc-manifest")

    def commit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        store, top = filesystem(folder)
        for frame in frames:
            for x in frame.to_pylist():
                if store.get_file_info(f"{top}/{x['temporary']}").type == afs.FileType.File:  # else an earlier attempt has named it
                    store.move(f"{top}/{x['temporary']}", f"{top}/{x['name']}")
                if (there := store.get_file_info(f"{top}/{x['name']}").size) != x["bytes"]:
                    raise OSError(f"{x['name']} has {there} bytes, not {x['bytes']}")
            yield frame

    named = written(manifest.mapInArrow(commit, MANIFEST), "warc-named")
    named.drop("temporary").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    if fs.get_file_info(f"{path}/_temporary").is_file is False:
        fs.delete_dir(f"{path}/_temporary")  # what failed attempts left
    return named


def parse(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    """(first line, headers, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    return first, headers, rest[: int(headers["Content-Length"])]


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, out, raw = zlib.decompressobj(31), [], b""
    while raw or (raw := stream.read(chunk)):
        out.append(z.decompress(raw))
        raw = b""
        if z.eof:
            yield b"".join(out)
            raw, z, out = z.unused_data, zlib.decompressobj(31), []
    if out:
        raise ValueError("the archive ends within a record")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per response or revisit record of the manifest's files; digests are computed again and must agree."""
    spark = manifest.sparkSession
    batches(spark)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for frame in frames:
            for name in frame.column(0).to_pylist():
                found = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for nth, raw in enumerate(members(stream)):
                        _, h, block = parse(raw)
                        if h["WARC-Type"] not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.decode().rpartition("Content-Length: ")[2])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if h["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}, record {nth}: its digest or length does not hold")
                        own, refers = h["WARC-Page-ID"], h.get("WARC-Refers-To-Page-ID")
                        found.append((None if own == "null" else int(own), h["WARC-Target-URI"], size, digest, h["WARC-Type"], int(refers) if refers else None, name, nth))
                        if len(found) == 4096:
                            yield _rows(found, _RECORDS)
                            found = []
                if found:
                    yield _rows(found, _RECORDS)

    # a stated number of tasks, as names are too small for adaptive execution to keep them apart
    files = manifest.count()
    return manifest.select("name").repartition(max(1, min(files, max(256, files // 16))), "name").mapInArrow(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write the archives into a new shared folder and read them back."""
    folder = fresh_dir(spark, "warc")
    return read(write(pages, folder, **options), folder)
