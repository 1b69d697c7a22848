"""WARC archives: round trips, ranges, and version lines within payloads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import warc
from fathom.llm.common import new_path
from tests.oracle import agree, connect

SF = "/root/testdata/sf0.001"
FAKE = warc.page_record(999, "http://fake/", b"not a record", "0" * 64, None, warc._DATE)


def test_query(spark):
    agree(warc.op12_warc(spark, SF), warc.OP12_SQL, connect(SF))


def test_jumped():
    draw = random.Random(2)
    for _ in range(300):
        at = sorted(draw.sample(range(200), draw.randrange(0, 40)))
        after = [draw.choice([a for a in [*at, 200, 211] if a > p]) if draw.random() < 0.9 else p + 1000 for p in at]

        def walk(p, links=dict(zip(at, after, strict=True))):
            while p in links:
                p = links[p]
            return p

        got = warc.jumped(np.array(at, dtype=np.int64), np.array(after, dtype=np.int64))
        assert got.tolist() == [walk(p) for p in at]


def evil_rows():
    """Payloads that hold whole records, heads of records that reach beyond the payload, and version lines."""
    draw = random.Random(4)
    long_claim = b"WARC/1.1\r\nContent-Length: 700\r\n\r\n"
    bodies = [FAKE, FAKE * 3, b"x" * 50 + FAKE, long_claim, b"WARC/1.1\r\n" * 50, b"WARC/1.0\r\nA: b\r\n" * 9, b"", b"y" * 99, b"y" * 100, b"\r\n\r\n" + FAKE + b"\r\n\r\n", b"\xff\x00\xfe" * 60]
    rows = [(i, f"http://h/{i} \r\nX: y", draw.choice(bodies) + (b"" if draw.random() < 0.5 else b"%d" % i)) for i in range(120)]
    return [*rows, (400, None, None), (401, None, b"")]


def test_magic_in_payloads_and_ranges(spark):
    rows = evil_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html binary").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("clash")).repartition(3)
    files = warc.write_warc(df, new_path(spark, "warc"), file_bytes=12_000)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    for span in (500, 7777, 1 << 23):
        records = warc.resolved(warc.read_warc(files, range_bytes=span)).withColumn("page_id", warc.page_of("record_id")).collect()
        pages = [r for r in records if r.type != "warcinfo"]
        assert sorted((r.page_id, bytes(r.payload), r.full_bytes) for r in pages) == sorted((i, p or b"", len(p or b"")) for i, _, p in rows)
        assert len(records) - len(pages) == files.count()
    first = {}
    for i, _, p in rows:
        if len(p or b"") >= 100:
            first.setdefault(p, i)
    for r in pages:
        want = first.get(bytes(r.payload), r.page_id)
        assert (r.type, r.refers_to) == (("response", None) if want == r.page_id else ("revisit", f"<urn:page:{want}>"))
    assert {r.url for r in pages if r.page_id == 3} == {"http://h/3%20%0D%0AX:%20y"}
    found = warc.candidates(files, 1000).count()
    assert found > len(rows) + files.count()  # the fakes were candidates


def test_read_folder_and_broken_chain(spark):
    path = new_path(spark, "warc")
    files = warc.write_warc(spark.createDataFrame([(1, "u", "<p>" * 100)], "page_id long, url string, html string"), path)
    again = warc.warc_files(spark, path)
    plain = lambda df: {(r.file.removeprefix("file://"), r.size) for r in df.select("file", "size").collect()}
    assert plain(again) == plain(files)
    assert warc.read_warc(again).count() == 2
    name = files.first().file.removeprefix("file://")
    with open(name, "ab") as f:
        f.write(b"junk")
    with pytest.raises(ValueError, match="before their file does"):
        warc.read_warc(warc.warc_files(spark, path)).count()


def test_edges(spark):
    long = "z" * 100
    rows = [(None, None, long), (5, "u", long), (5, "u", long), (7, "", long), (None, "v", "w" * 200), (None, "v", "w" * 200), (9, "é", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.read_warc(warc.write_warc(df, new_path(spark, "warc"))).where("type <> 'warcinfo'")
    got = sorted((str(warc_id.page_id), warc_id.type, warc_id.of, warc_id.full_bytes) for warc_id in records.select(warc.page_of("record_id").alias("page_id"), "type", warc.page_of("refers_to").alias("of"), "full_bytes").collect())
    assert got == [("5", "response", None, 100), ("5", "response", None, 100), ("7", "revisit", 5, 100), ("9", "response", None, 0), ("None", "response", None, 200), ("None", "response", None, 200), ("None", "revisit", 5, 100)]
    empty = warc.write_warc(df.limit(0), new_path(spark, "warc"))
    assert empty.count() == 0
    assert warc.read_warc(empty).count() == 0
