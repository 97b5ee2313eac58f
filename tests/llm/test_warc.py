import base64
import gzip
import hashlib

import pyarrow.fs
import pytest

from larkspur.llm import warc
from tests.llm.fixtures import ordered

ROWS = [(1, "u1", "a"), (2, "u2", "a"), (3, None, "b"), (None, "x", "a"), (4, "u4\r\nX: y", None), (5, "u5", ""), (5, "u5", ""), (6, "z", "é" * 3000), (7, "z", "é" * 3000), (8, "z", "\r\n\r\nWARC/1.1\r\n"), (None, "only", "null id only"), (None, "only", "null id only")]


def pages(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], "page_id long, url string, html string, digest string, shard string")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute():
    winner = {}
    for page, _, html in ROWS:
        if page is not None:
            winner[html or ""] = max(page, winner.get(html or "", page))
    found, spent = [], set()
    for page, _, html in ROWS:
        text = html or ""
        best = winner.get(text)
        revisit = best is not None and (page != best or (page, text) in spent)
        spent.add((page, text))
        found.append((page, len(text.encode()), digest(text), "revisit" if revisit else "response", best if revisit else None))
    return found


def test_round_trip(spark):
    folder, manifest = warc.write_archives(pages(spark), shard_bytes=3000, roll_bytes=600)
    got = warc.read_archives(folder, manifest, with_payload=True)
    assert ordered(tuple(r)[:5] for r in got.collect()) == ordered(brute())
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    payloads = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert payloads[7] == ("é" * 3000).encode() and payloads[8] == b"\r\n\r\nWARC/1.1\r\n"


def test_same_bytes_from_any_partitioning(spark):
    sums = []
    for df in (pages(spark), pages(spark).repartition(5)):
        _, manifest = warc.write_archives(df, shard_bytes=3000, roll_bytes=600)
        sums.append(sorted(map(tuple, manifest.select("name", "bytes", "sha256", "first_id", "last_id").collect())))
    assert sums[0] == sums[1]


def test_null_ids_and_one_id_are_dealt_to_many_shards(spark):
    for page in (None, 7):
        df = spark.createDataFrame([(page, "u", f"text {i} " * 50) for i in range(200)], "page_id long, url string, html string")
        folder, manifest = warc.write_archives(df, shard_bytes=4000)
        assert manifest.select("shard").distinct().count() > 10
        assert warc.read_archives(folder, manifest).where("record_type = 'response'").count() == 200
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        assert fs.get_file_info(f"{root}/_temporary").type == pyarrow.fs.FileType.NotFound


def test_a_file_that_another_attempt_has_put_there_stays(tmp_path):
    def refused(self, *_):
        raise OSError("exists")

    for _ in range(2):
        roll = warc._Roll(f"file://{tmp_path}", 3, 1 << 20, 1, "1970-01-01T00:00:00Z")
        roll.write(1, warc.page_record(1, "u", "text", None, False, "1970-01-01T00:00:00Z"))
        if list(tmp_path.glob("*.gz")):
            class Fs:
                def __init__(self, fs):
                    self.fs = fs

                def __getattr__(self, name):
                    return refused.__get__(self) if name == "move" else getattr(self.fs, name)

            roll.fs = Fs(roll.fs)
        roll.close()
    assert len(list(tmp_path.glob("*.gz"))) == 1 and not list((tmp_path / "_temporary").iterdir())


def test_files_are_plain_warc(spark):
    folder, manifest = warc.write_archives(pages(spark))
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for r in manifest.collect():
        with fs.open_input_stream(f"{root}/{r.name}", compression=None) as f:
            text = gzip.decompress(f.read())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
        assert text.count(b"\r\nWARC-Record-ID: <urn:uuid:") == r.records + 1
    assert fs.get_file_info(f"{root}/_temporary").type == pyarrow.fs.FileType.NotFound


def test_damage_is_noticed(spark):
    folder, manifest = warc.write_archives(pages(spark))
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    name = manifest.first().name
    with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
        data = bytearray(f.read())
    data[len(data) // 2] ^= 1
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(bytes(data))
    with pytest.raises(Exception):
        warc.read_archives(folder, manifest).collect()


def test_small_payloads_are_never_revisits_on_demand(spark):
    folder, manifest = warc.write_archives(pages(spark), least_revisit_bytes=10)
    kinds = {(r.page_id, r.record_type) for r in warc.read_archives(folder, manifest).collect()}
    assert (1, "response") in kinds and (6, "revisit") in kinds


def test_empty_table(spark):
    folder, manifest = warc.write_archives(pages(spark).where("false"))
    assert manifest.count() == 0 and warc.read_archives(folder, manifest).count() == 0


def test_shards_by_binary_search(spark):
    from pyspark.sql import functions as F

    ids = [(None, "b"), *((i, d) for i in range(-5, 750) for d in ("a", "c"))]
    df = spark.createDataFrame(ids, "id long, d string")
    place = lambda x: (x[0] is not None, x[0] or 0, x[1])
    for bounds in ([], [(5, "b")], [(None, "a"), (0, "b"), (10, "c"), (20, "")], [(i, "b") for i in range(0, 700, 7)]):
        for r in df.withColumn("s", warc._shard_of(F.col("id"), F.col("d"), bounds)).collect():
            assert r.s == max([i for i, b in enumerate(bounds) if place(b) <= place((r.id, r.d))], default=0)
