import base64
import hashlib
import io
import random

import pytest

from tidewatch.llm import common, warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    """(id, size, digest, type, refers_to) of (id, url, html) rows."""
    first, seen, out = {}, set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, _, html in order:
        first.setdefault(html or "", i)
    for i, _, html in order:
        html = html or ""
        revisit = html in seen
        seen.add(html)
        out.append((i, len(html.encode()), digest(html), "revisit" if revisit else "response", first[html] if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (3, "http://a/x y\r\nEvil: 1", "<p>one</p>"), (1, None, "<p>one</p>"), (-7, "http://b", None), (9, "http://b", ""),
    (None, "http://n", "<p>one</p>"), (4, "http://ü", "Grüße" * 10), (5, "u", "five"), (5, "u", "five"), (6, "u", "x" * 300_000),
    (2**62, "u", "last"), (None, None, "only null"),
]


def got(spark, df, **kw):
    path = common.scratch(spark, "warc-test")
    manifest = warc.write(df, path, **kw)
    rows = warc.read(spark, path).collect()
    out = [(int(r.row_id) if r.row_id != "null" else None, r.payload_bytes, r.payload_digest, r.record_type,
            None if r.refers_to is None else int(r.refers_to)) for r in rows]
    files = {r.file: common.get(f"{path}/{r.file}") for r in manifest.collect()}
    return sorted(out, key=repr), files, manifest.collect()


def test_round_trip_with_odd_rows(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, key string, shard int")
    rows, files, manifest = got(spark, df)
    assert rows == expected(ROWS)
    assert len(files) == 1 and sum(m.records for m in manifest) == len(ROWS)


def test_files_depend_on_the_records_alone(spark):
    rows = [(i * 37 % 1000, f"http://h/{i}", f"page {i % 90} " * (i % 50)) for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, files, manifest = got(spark, df, shard_bytes=50_000, file_bytes=2_000)
    b, again, _ = got(spark, df.repartition(7, "html"), shard_bytes=50_000, file_bytes=2_000)
    assert a == b == expected(rows) and files == again
    assert len({m.shard for m in manifest}) > 3 and max(m.bytes for m in manifest) < 2_000 + 600
    for m in manifest:
        assert hashlib.sha256(files[m.file]).hexdigest() == m.sha256
        assert len(list(warc.members(io.BytesIO(files[m.file]), 100))) == m.records + 1


def test_nothing_temporary_is_left(spark):
    path = common.scratch(spark, "warc-test")
    warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    system, root = common.file_system(path)
    from pyarrow import fs

    assert not [f for f in system.get_file_info(fs.FileSelector(root)) if "_temporary" in f.path or f.path.endswith(".tmp")]


def test_empty_table_and_payloads(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert got(spark, df.limit(0))[0] == []
    path = common.scratch(spark, "warc-test")
    warc.write(df, path)
    back = [bytes(r.payload) for r in warc.read(spark, path, payloads=True).collect() if r.record_type == "response"]
    assert sorted(back) == sorted({(r[2] or "").encode() for r in ROWS})


def test_damage_is_noticed():
    data = warc.record(1, "http://a", b"payload", None, 0)
    assert warc.parse(data)[0]["X-Row-Id"] == "1"
    for bad in (data.replace(b"payload", b"paYload"), data[:-1]):
        try:
            warc.parse(bad)
        except ValueError:
            continue
        raise AssertionError


def test_usual_files_roll_and_empty_payloads_are_spread(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = [(i, "u", None if i < 300 else " ".join(r.choice(words) for _ in range(400))) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = common.scratch(spark, "warc-test")
    manifest = warc.write(df, path, shard_bytes=warc.SHARD_BYTES // 512, file_bytes=warc.FILE_BYTES // 512).collect()
    files, records = {}, {}
    for m in manifest:
        files[m.shard] = files.get(m.shard, 0) + 1
        records[m.shard] = records.get(m.shard, 0) + m.records
    # At the usual ratio of sizes files roll inside a shard, and no shard holds the whole run of empty payloads.
    assert max(files.values()) > 1 and max(records.values()) < 200 and sum(records.values()) == 600
    assert warc.read(spark, path).count() == 600


def test_paths_are_qualified(spark):
    conf = spark._jsc.hadoopConfiguration()
    assert common.qualified(spark, "/x/y").startswith("file:/") and common.file_system("file:///x/y")[1] == "/x/y"
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://127.0.0.1:1/")
    try:
        assert common.qualified(spark, "/x/y") == "hdfs://127.0.0.1:1/x/y"
    finally:
        conf.set("fs.defaultFS", before)
    for path in ("/x/y", "x", "odd://host/x"):
        with pytest.raises(Exception, match="names no file system|[Uu]nrecognized|scheme"):
            common.file_system(path)
