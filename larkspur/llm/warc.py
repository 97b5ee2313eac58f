"""WARC: a deterministic sharded writer, and a reader of its archives.

Records are ordered by page id and digest. Shards are ranges of both with about equal payload bytes, taken from
exact prefix sums, so the same input gives the same shards, files and bytes whatever the number of
executors. A shard's writer streams its sorted rows, regenerates headers and digests, writes one gzip
member per record, rolls to a new file once the compressed size is reached, and moves each file from
a temporary name to its own. The written manifest lists the files with sizes and checksums; only what
it lists counts, so retried or speculative tasks and lost executors leave nothing half done.

Of records with equal payloads the one with the largest page id is the response, others revisit it.

Defined results: null html is the empty payload; a null id is written as such, sorts first, and never
is the one that others refer to if any id is known; of repeated rows with equal id and payload the
first is the response and the others revisit it; a null url becomes a `urn:page:` URI; an empty table
gives no files; extra input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import claim_worker, qualified, scratch_path, slices, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("8d0f6f6e-51b3-4c0f-9a58-5f7e0a6f2b11")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}/{digest}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, html: str | None, winner: int | None, revisit: bool, date: str) -> bytes:
    """One response or revisit record."""
    payload = ("" if html is None else html).encode()
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"
    block = http if revisit else http + payload
    own = _record_id(page, digest) if not revisit else _record_id(page, digest + "/revisit")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(winner, digest)), ("X-Refers-To-Page-Id", str(winner))]
    return _record(fields, block)


class _Roll:
    """Writes gzip members into files of about `roll_bytes`, each moved from a temporary name when it is complete."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, level: int, date: str) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.level, self.date = shard, roll_bytes, level, date
        self.sequence, self.out, self.done = 0, None, []

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.sequence:05d}.warc.gz"
        self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size, self.records, self.sum, self.first = 0, 0, hashlib.sha256(), None
        info = f"software: larkspur\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
        self._member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, self.name)}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def _member(self, record: bytes) -> None:
        squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = squeeze.compress(record) + squeeze.flush()
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def write(self, page: int | None, record: bytes) -> None:
        if self.out is None:
            self._open()
        self.first = page if not self.records else self.first
        self.last = page
        self._member(record)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.root}/{self.name}"
        try:
            self.fs.move(self.temporary, final)
        except OSError:
            # Another attempt of this task has put the same bytes there; names appear whole, so they stay.
            if self.fs.get_file_info(final).type != pyarrow.fs.FileType.File:
                raise
            self.fs.delete_file(self.temporary)
        self.done.append((self.name, self.shard, self.sequence, self.records, self.size, self.sum.hexdigest(), self.first, self.last))
        self.sequence += 1
        self.out = None


def _shard_of(page: Column, digest: Column, bounds: list[tuple[int | None, str]]) -> Column:
    """Number of the range that holds a record: binary search among the ranges' first ids and digests; null ids come first."""
    if len(bounds) < 2:
        return F.lit(0)
    edges = F.from_json(F.lit(json.dumps([{"p": p, "d": d} for p, d in bounds])), "array<struct<p: long, d: string>>")
    own = F.struct(page.alias("p"), digest.alias("d"))
    steps = [1 << i for i in range((len(bounds) - 1).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(edges, lo + s) <= own, F.lit(False)), lo + s).otherwise(lo))


def shard_bounds(info: DataFrame, shard_bytes: int, most_shards: int = 20_000) -> list[tuple[int | None, str]]:
    """First (id, digest) of ranges with about `shard_bytes` of payload each; at most about `most_shards` reach the driver.

    Beyond that ranges are larger, and their writers roll more files; a sorted range is streamed, so memory stays the same.
    """
    total = info.agg(F.sum("size")).first()[0] or 0
    target = max(shard_bytes, -(-total // most_shards), 1)
    known = info.repartitionByRange("page_id", "digest").withColumn("part", F.spark_partition_id()).checkpoint()
    totals = known.groupBy("part").agg(F.sum("size").alias("total"))  # a row per partition
    base = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.sum("size").over(Window.partitionBy("part").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    numbered = known.withColumn("before", before).join(F.broadcast(base), "part").select("page_id", "digest", F.floor((F.col("base") + F.col("before")) / target).alias("shard"))
    first = numbered.groupBy("shard").agg(F.min(F.struct("page_id", "digest")).alias("first")).select("first.*").collect()
    return sorted({(r.page_id, r.digest) for r in first}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit_bytes: int = 0, shard_bytes: int = 16 << 20, roll_bytes: int = 16 << 20, level: int = 1, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """(folder, manifest): writes page_id, url, html; manifest has name, shard, sequence, records, bytes, sha256, first_id, last_id."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "warc"))
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    info = written(rows.select("page_id", "digest", "size"), "warc-info")
    bounds = shard_bounds(info, shard_bytes)
    repeated = info.where(F.col("size") >= least_revisit_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("winner")).where("n > 1 and winner is not null")
    referred = info.join(repeated, "digest").select("page_id", "digest", "winner").distinct()
    nothing = F.lit(None).cast("string")
    shown = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("winner"))
    notes = referred.select("page_id", "digest", F.lit(0).alias("kind"), nothing.alias("url"), nothing.alias("html"), "winner")
    shards = max(1, len(bounds))
    dealt = shown.unionByName(notes).withColumn("shard", _shard_of(F.col("page_id"), F.col("digest"), bounds)).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    names = ["name", "shard", "sequence", "records", "bytes", "sha256", "first_id", "last_id"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("warc")
        roll, note, spent = None, None, False
        for whole in batches:
            for b in slices(iter([whole]), "digest", 40 * 512):
                for shard, page, digest, kind, url, text, winner in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "digest", "kind", "url", "html", "winner"))):
                    if roll is None or roll.shard != shard:
                        if roll is not None:
                            roll.close()
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*roll.done), kinds)], names=names)
                        roll = _Roll(folder, shard, roll_bytes, level, date)
                    if kind == 0:
                        note, spent = (page, digest, winner), False
                        continue
                    refers = note[2] if note is not None and note[:2] == (page, digest) else None
                    revisit = refers is not None and (refers != page or spent)
                    roll.write(page, page_record(page, url, text, refers, revisit, date))
                    if refers is not None:
                        spent = True
        if roll is not None:
            roll.close()
            if roll.done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*roll.done), kinds)], names=names)

    made = dealt.mapInArrow(run, "name string, shard int, sequence int, records long, bytes long, sha256 string, first_id long, last_id long")
    made.write.parquet(f"{folder}/manifest")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/_temporary").type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")  # what lost attempts have left
    return folder, spark.read.schema(made.schema).parquet(f"{folder}/manifest")


def _read_members(stream, chunk: int = 1 << 14) -> Iterator[bytes]:
    """The records of a .warc.gz file, one gzip member each. What is left of a chunk is copied for each member, so chunks are small."""
    pending = b""
    inflate, parts = zlib.decompressobj(31), []
    while True:
        data = pending or stream.read(chunk)
        pending = b""
        if not data:
            break
        parts.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(parts)
            pending, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("WARC file ends inside a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block)"""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("WARC record: wrong length")
    return fields, block


def read_archives(folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri[, payload]) of every record in the listed files; sizes, checksums and digests are verified."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    if with_payload:
        columns, kinds, schema = [*columns, "payload"], [*kinds, pa.binary()], schema + ", payload binary"

    def rows_of(name: str, size: int, digest: str) -> Iterator[tuple]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as raw:
            seen = _Summed(raw)
            for record in _read_members(seen):
                fields, block = parse_record(record)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or fields["WARC-Type"] == "response" and (base32_sha1(payload) != own or len(payload) != length):
                    raise ValueError(f"{name}: a record's digest does not match")
                page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                row = (int(page) if page else None, length, own, fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Target-URI"])
                yield (*row, payload) if with_payload else row
            if (seen.size, seen.sum.hexdigest()) != (size, digest):
                raise ValueError(f"{name}: file does not match the manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("warc")
        for b in batches:
            for name, size, digest in zip(*(b.column(c).to_pylist() for c in ("name", "bytes", "sha256"))):
                held, weight = [], 0
                for row in rows_of(name, size, digest):
                    held.append(row)
                    weight += row[1] if with_payload else 200
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=columns)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=columns)

    listed = manifest.select("name", "bytes", "sha256")
    return listed.repartition(max(1, min(10_000, listed.count()))).mapInArrow(run, schema)


class _Summed(io.RawIOBase):
    """A stream that keeps size and SHA-256 of what was read."""

    def __init__(self, raw) -> None:
        self.raw, self.size, self.sum = raw, 0, hashlib.sha256()

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(n)
        self.size += len(data)
        self.sum.update(data)
        return data


#: DuckDB SQL of the query. DuckDB has no base32, so the digest's 160 bits are spelled in groups of five.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS winner FROM p
), b AS (
  SELECT *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda q:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(x, 1 + g * 5, 5))::BIGINT >> (15 - 5 * q) & 31)::INTEGER, 1)), '')), '') AS digest FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM b
"""
