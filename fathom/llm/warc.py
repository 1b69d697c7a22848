"""WARC archives: writing with revisit records, and reading large files in ranges by verified boundary chains.

Writing: each row is a record with an HTTP response as its block. Of rows with equal payloads of `least` bytes or more the one
with the smallest id is a `response`; the others are `revisit` records (profile identical-payload-digest), which name it and
keep the HTTP head without the payload. A task writes files of some 32 MB, each under a name of its own attempt, and only
files of attempts that Spark commits are listed, so a lost executor leaves no record twice.

Reading: tasks look for the version line in ranges of files. Each place where a whole header stands is a candidate,
whose Content-Length gives its successor; payloads may hold such places too. In its range a task follows successors by pointer
jumping to the first one beyond the range. Those jumps are joined with each other, twice as far in each round, beginning
at the files' starts: what a start reaches are true records, and no candidate within a payload is among them. Then
each range is read along its chain. A chain that ends before its file does is an error.

Null payloads are empty. Rows with equal ids and payloads are all responses if their id is the smallest. A null id comes after all others; records that repeat a payload whose
rows have no id at all are responses. Null URLs leave the header out; blanks and control characters in URLs
are percent-encoded. An empty table gives no files and no records. Columns other than those named are not looked at. Headers have 1 MB at most.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, new_path, small, stored, table

VERSION = b"WARC/1.1\r\n"
_START = re.compile(rb"WARC/1\.[01]\r\n")
#: Whole header lines, and the blank one if it is there.
_HEAD = re.compile(rb"WARC/1\.[01]\r\n(?:(?:[!-9;-~]+:|[ \t])[^\r\n]*\r\n)*+(\r\n)?")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)
LEAST_BYTES, FILE_BYTES, RANGE_BYTES, BATCH_BYTES = 100, 32 << 20, 8 << 20, 4 << 20
_HEADER_BYTES, _STEP = 1 << 20, 1 << 16
_MOST_TASKS = 20_000
_DATE = "1970-01-01T00:00:00Z"
_NAME = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests of repeated payloads are broadcast up to so many.
_MOST_DIGESTS = 500_000

# ---------------------------------------------------------------- writing


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}\r\n".encode(), *(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None), b"Content-Length: %d\r\n\r\n" % len(block)]
    return b"".join([*head, block, b"\r\n\r\n"])


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    name = lambda i: f"<{_NAME}{'' if i is None else i}>"
    clean = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha256:{digest}")]
    again = [] if refers_to is None else [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers_to))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record("revisit" if again else "response", [*fields, *again, ("Content-Type", "application/http; msgtype=response")], http if again else http + payload)


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, payload) with digest and refers_to (null for responses)."""
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    groups = pages.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
    groups = stored(groups.where("times > 1 AND first IS NOT NULL"), "repeated")
    known = small(groups, _MOST_DIGESTS)
    met = pages.join(known.drop("times"), "digest", "left") if known is not groups else looked_up(pages, groups, ["digest"], "times")
    return met.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, date: str = _DATE) -> DataFrame:
    """Writes a record per row to files under path (a URI that driver and executors share). Returns the files: file (URI), size, records."""
    from pyarrow import fs

    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner)

    def write(batches):
        store, inner = fs.FileSystem.from_uri(path)
        held, size, files = [], 0, []

        def flush():
            nonlocal size
            name = f"{uuid.uuid4().hex}.warc"
            head = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            with store.open_output_stream(f"{inner}/{name}") as out:
                out.write(head)
                for x in held:
                    out.write(x)
            files.append((f"{path}/{name}", size + len(head), len(held)))
            held.clear()
            size = 0

        for rows in batches:
            for at in range(rows.num_rows):  # one at a time, so a batch is not held twice
                held.append(page_record(*(rows.column(c)[at].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to")), date))
                size += len(held[-1])
                if size >= file_bytes:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*files, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "size", "records"])

    rows = with_revisits(rows, least).select("page_id", "url", "payload", "digest", "refers_to")
    return stored(rows.mapInArrow(write, "file string, size long, records long"), "archives")


def warc_files(spark: SparkSession, path: str) -> DataFrame:
    """file and size of all .warc files under a folder, for reading archives of others."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), F.col("length").alias("size"))


# ---------------------------------------------------------------- reading


def _header(f, at: int, size: int, have: bytes = b"") -> tuple[bytes, int] | None:
    """The header of the record at a place, with its blank line, and the place after the whole record; None if there is none. have: the first bytes from there on, if known."""
    head = have
    while True:
        lines = _HEAD.match(head)
        if lines and lines[1]:
            head = lines[0]
            break
        other = b"\r\n" in head[lines.end() if lines else 0 : -1]  # a line that no header has
        if other or len(head) >= _HEADER_BYTES or at + len(head) >= size:
            return None
        f.seek(at + len(head))
        head += f.read(min(_STEP, size - at - len(head)))
    length = _LENGTH.search(head)
    if not length:
        return None
    after = at + len(head) + int(length[1]) + 4
    return (head, after) if after <= size else None


def jumped(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each candidate (places, ascending, and their successors), where its chain leaves the candidates."""
    to = np.searchsorted(at, after)
    to[to == len(at)] = 0
    to = np.where(at[to] == after, to, np.arange(len(at))) if len(at) else to
    while (to != to[to]).any():
        to = to[to]
    return after[to]


def _candidates(batches):
    """mapInArrow over ranges (file, size, begin, end): a row per candidate with its successor and the jump out of the range."""
    from pyarrow import fs

    for rows in batches:
        for r in rows.to_pylist():
            store, inner = fs.FileSystem.from_uri(r["file"])
            with store.open_input_file(inner) as f:
                f.seek(r["begin"])
                data = f.read(min(r["size"], r["end"] + _STEP) - r["begin"])
                at, after = [], []
                for m in _START.finditer(data):
                    place = r["begin"] + m.start()
                    if place >= r["end"]:
                        break
                    found = _header(f, place, r["size"], data[m.start() : m.start() + _STEP])
                    if found:
                        at.append(place)
                        after.append(found[1])
            a, b = np.array(at, dtype=np.int64), np.array(after, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(jumped(a, b))], names=["file", "at", "next", "leaves"])


def _dealt(rows: DataFrame, files: DataFrame, range_bytes: int) -> DataFrame:
    """Rows of places in files, spread by them over about a task per range: so few rows mean so much reading that Spark, which goes by their bytes, would put them together."""
    n = files.agg(F.sum(F.expr(f"(size + {range_bytes - 1}) DIV {range_bytes}"))).first()[0] or 1
    return rows.repartition(min(n, _MOST_TASKS), "file", rows.columns[2])


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    cut = files.where("size > 0").select("file", "size", begin.alias("begin")).withColumn("end", F.least(F.col("begin") + range_bytes, F.col("size")))
    return _dealt(cut, files, range_bytes)


def candidates(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All places in files (file, size) where a whole record may begin: file, at, next, leaves (the first place beyond the range that its chain comes to)."""
    return _ranges(files, range_bytes).mapInArrow(_candidates, "file string, at long, next long, leaves long")


def chain_entries(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The true records with which each range's chain begins: file, size, at, end (of the range). Raises if a chain doesn't end where its file does."""
    found = stored(candidates(files, range_bytes).select("file", "at", "leaves"), "candidates")
    # Only a file's start, or a place that some chain comes to from another range, can begin a range.
    met = found.select("file", F.col("leaves").alias("at")).distinct()
    jumps = stored(found.where("at = 0").unionByName(found.where("at > 0").join(met, ["file", "at"], "left_semi")).select("file", "at", F.col("leaves").alias("to")), "jumps")
    reached, n = stored(files.where("size > 0").select("file", F.lit(0).cast("long").alias("at")), "reached"), -1
    while True:
        onward = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = stored(reached.unionByName(onward).distinct(), "reached")
        now = reached.count()
        if now == n:
            break
        n = now
        far = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = stored(jumps.join(far, ["file", "to"], "left").select("file", "at", F.coalesce("far", "to").alias("to")), "jumps")
    ended = reached.join(files, ["file"]).groupBy("file").agg(F.max("at").alias("at"), F.first("size").alias("size")).where("at <> size")
    if broken := ended.limit(3).collect():
        raise ValueError(f"records end before their file does: {[(r.file, r.at, r.size) for r in broken]}")
    end = F.expr(f"least(size, (at DIV {range_bytes} + 1) * {range_bytes})")
    return reached.join(files.select("file", "size"), "file").where("at < size").withColumn("end", end)


def _records():
    """mapInArrow over entries (file, size, at, end): the records of the chain that begin in the range."""

    def run(batches):
        from pyarrow import fs

        field = lambda head, name: m[1].decode("utf-8", "replace").strip() if (m := re.search(rb"\r\n" + name + rb":([^\r\n]*)", head, re.I)) else None
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), *((c, pa.string()) for c in ("type", "record_id", "refers_to", "url", "digest")), ("full_bytes", pa.int64()), ("payload", pa.binary())])
        for rows in batches:
            for r in rows.to_pylist():
                store, inner = fs.FileSystem.from_uri(r["file"])
                with store.open_input_file(inner) as f:
                    at, out, held = r["at"], [], 0
                    while at < r["end"]:
                        f.seek(at)
                        got = _header(f, at, r["size"], f.read(4096))
                        if not got:
                            raise ValueError(f"no record at {at} of {r['file']}")
                        head, after = got
                        f.seek(at + len(head))
                        block = f.read(after - 4 - at - len(head))
                        http = b""
                        if (field(head, b"Content-Type") or "").startswith("application/http") and (cut := block.find(b"\r\n\r\n")) >= 0:
                            http, block = block[: cut + 2], block[cut + 4 :]
                        full = re.search(_LENGTH, b"\r\n" + http)
                        kind = field(head, b"WARC-Type")
                        out.append((r["file"], at, kind, field(head, b"WARC-Record-ID"), field(head, b"WARC-Refers-To"), field(head, b"WARC-Target-URI"), field(head, b"WARC-Payload-Digest"), int(full[1]) if kind == "revisit" and full else len(block), block))
                        held, at = held + len(block), after
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of files (file, size): file, at, type, record_id, refers_to, url, digest (as headed), full_bytes (of the payload; of a revisit's as its HTTP head says), payload."""
    entries = _dealt(chain_entries(files, range_bytes).select("file", "size", "at", "end"), files, range_bytes)
    return entries.mapInArrow(_records(), "file string, at long, type string, record_id string, refers_to string, url string, digest string, full_bytes long, payload binary")


def page_of(name: str) -> F.Column:
    """The page's id in a record's name; null where there is none."""
    return F.expr(f"try_cast(regexp_extract({name}, '^<{_NAME}(-?[0-9]+)>$', 1) AS BIGINT)")


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits' payloads taken from the responses that they name. Names of responses that many records name are joined as hot keys."""
    records = stored(records, "records")
    again = records.where("type = 'revisit'")
    named = again.groupBy("refers_to").agg(F.count("*").alias("times"))
    one = Window.partitionBy("record_id").orderBy("file", "at")
    of = records.where("type = 'response'").join(named.withColumnRenamed("refers_to", "record_id"), "record_id").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    of = stored(of.select(F.col("record_id").alias("refers_to"), "times", F.col("payload").alias("of")), "named")
    filled = looked_up(again, of, ["refers_to"], "times").withColumn("payload", F.coalesce("of", "payload"))
    return records.where("type IS DISTINCT FROM 'revisit'").unionByName(filled.select(*records.columns))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    records = read_warc(files.select("file", "size")).where("type IN ('response', 'revisit')")
    digest = F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.regexp_extract("digest", "^sha256:([0-9a-f]{64})$", 1))
    return records.select(page_of("record_id").alias("page_id"), F.col("full_bytes").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"))


OP12_SQL = f"""
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""
