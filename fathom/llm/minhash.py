"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i every shingle is thrown into one of t bins with
the value i + v, v in [0, 1); a bin keeps its least value. After t such rounds, round t + j throws every
shingle into bin j, so each bin is filled for sure. A text stops at the first round after which none of
its bins is empty, which for n shingles takes about t ln t / n rounds.

Banding: documents that agree in all rows of a band share a bucket. In each bucket the smallest id is
compared with all others; members that this leaves in different components are then all compared with
each other, block against block inside a task, but for the bucket's largest component, whose rows only meet those of others, so that no pair of a bucket stays undecided unless it is
connected already. A task compares full shingle sets and sends one link of any two components that it finds
linked, never all pairs; a large bucket is dealt out as pairs of blocks. A pair is a link only if the full sets
(64-bit hashes of all shingles) say so.
Documents with equal sets are one class with one representative.

Null and empty texts have no shingles and are linked with nothing. A text of fewer words than a shingle
has its whole sequence as the one shingle. Rows with equal ids count as one document that has all their
links. Rows with a null id are returned with a null component and kept; ties have no effect, as the smallest id decides. An empty table gives no rows.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_TABLE, Words, by_chunk, components, looked_up, mix, semi, shingles, stored, table, whole_groups

BANDS, ROWS = 48, 6
#: One-bit sketch of four longs: pairs that agree in too few bits are not compared further. At the
#: threshold the number of differing bits is 5 standard deviations below the bound.
_BITS = 256
#: A bucket is compared in blocks of about so many rows, or bytes of hashes.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8_000_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
SIGNATURE = ["s0", "s1", "s2", "s3"]


def sketch(g: np.ndarray, doc: np.ndarray, docs: int, t: int) -> np.ndarray:
    """(docs, t) sketches of the sets whose members' hashes are g; doc is each member's set, ascending."""
    out = np.full((docs, t), _FULL, dtype=np.uint64)
    flat = out.reshape(-1)
    open_ = np.bincount(doc, minlength=docs) > 0
    for i in range(2 * t):
        if not open_.any():
            break
        keep = open_[doc]
        if not keep.all():
            g, doc = g[keep], doc[keep]
        h = mix(g ^ mix(np.uint64([i]))[0])
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(flat, doc * t + bins, np.uint64(i) << np.uint64(32) | h & np.uint64(0xFFFFFFFF))
        left = np.flatnonzero(open_)
        open_[left] = (out[left] == _FULL).any(axis=1)
    return out


def sketched(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, n (set size), h1 and h2 (digests of the set), bands (bucket keys), s0 to s3 (bits)."""

    def work(batch, texts):
        g, doc = shingles(Words(texts, SPACE_TABLE, ascii_lower=True), shingle)
        n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        digest = [np.concatenate([[np.uint64(0)], np.cumsum(mix(g ^ np.uint64(s)))]) for s in (1, 2)]
        digest = [d[first[1:]] - d[first[:-1]] for d in digest]
        full = sketch(g, doc, len(texts), bands * rows)
        keys = np.zeros((len(texts), bands), dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
        for r in range(rows):
            keys = mix(keys) + full[:, r::rows][:, :bands]
        bits = np.packbits((full[:, :_BITS] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), pa.ListArray.from_arrays(offsets, pa.array(mix(keys).view(np.int64).ravel())), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4))],
            names=["id", "n", "h1", "h2", "bands", *SIGNATURE],
        )

    return docs.mapInArrow(by_chunk(work), "id long, n long, h1 long, h2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id and its set, as sorted 64-bit hashes."""

    def work(batch, texts):
        g, doc = shingles(Words(texts, SPACE_TABLE, ascii_lower=True), shingle)
        ends = np.cumsum(np.bincount(doc, minlength=len(texts))) * g.itemsize
        data = g.tobytes()
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)], pa.binary())], names=["id", "members"])

    return docs.mapInArrow(by_chunk(work), "id long, members binary")


def _similar(a: str, b: str, percent: int) -> F.Column:
    """What sizes and bits alone can say of a pair."""
    agree = 0.5 + percent / 200
    most = math.floor(_BITS * (1 - agree + 5 * math.sqrt(agree * (1 - agree) / _BITS)))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SIGNATURE), F.lit(0))
    return (small * 100 >= large * percent) & (differ <= most)


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union. pairs is stored."""
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = stored(_sets(semi(docs, ids, "id"), shingle), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")

    def work(batches):
        for rows in batches:
            keep = []
            for x, y in zip(rows.column("x"), rows.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long").distinct()


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets, as a product of incidence matrices."""
    kinds, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = np.flatnonzero(times > 1)
    place = np.full(len(kinds), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, len(shared), 4096):  # a product of so many columns is exact in single precision
        some = slice(*np.searchsorted(column, [a, a + 4096]))
        m = np.zeros((len(sets), min(4096, len(shared) - a)), dtype=np.float32)
        m[owner[some], column[some] - a] = 1
        out += (m[left] @ m[right].T).astype(np.int64)
    return out


def _bridges(percent: int):
    """A mapInArrow function over tasks (see bridges): one link for any two components that have one."""

    def run(batches):
        for t in whole_groups(batches, "task"):
            task = t.column("task").to_numpy()
            ends = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
            ids, comps, sizes, mine, lo, hi = (t.column(c).to_numpy() for c in ("id", "comp", "n", "mine", "lo", "hi"))
            blobs = t.column("members")
            found_a, found_b = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                comp, n = comps[a:b], sizes[a:b]
                if (comp == comp[0]).all():
                    continue
                left = np.flatnonzero(mine[a:b] == lo[a])
                right = np.flatnonzero(mine[a:b] == hi[a])
                if not len(left) or not len(right):
                    continue
                c = common_counts([np.frombuffer(x.as_buffer(), np.uint64) for x in blobs.slice(a, b - a)], left, right)
                ok = (100 * c >= percent * (n[left][:, None] + n[right][None, :] - c)) & (comp[left][:, None] != comp[right][None, :])
                i, j = np.nonzero(ok)
                if not len(i):
                    continue
                x, y = left[i], right[j]
                pair = np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])], axis=1)
                one = np.unique(pair, axis=0, return_index=True)[1]
                found_a.append(np.minimum(ids[a:b][x[one]], ids[a:b][y[one]])), found_b.append(np.maximum(ids[a:b][x[one]], ids[a:b][y[one]]))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    return run


def dealt(named: DataFrame) -> DataFrame:
    """id, n, comp, mine, lo, hi, task: rows of buckets (key) with several components, dealt out as pairs of blocks.

    Rows of a bucket's largest component are linked already, so they meet only the rows outside it; these meet all. One
    stray row in a bucket of very many linked ones costs a comparison with each of them, not all pairs of blocks.
    """
    parts = named.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("members"))
    blocks = lambda rows, members: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(members * 8 / BLOCK_BYTES))
    largest = F.max(F.struct("rows", "members", "comp")).alias("most")
    mixed = parts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("rows").alias("rows"), F.sum("members").alias("members"), largest).where("comps > 1")
    rest_rows, rest_members = F.col("rows") - F.col("most.rows"), F.col("members") - F.col("most.members")
    mixed = mixed.select("key", F.col("most.comp").alias("main"), blocks(rest_rows, rest_members).alias("few"), blocks(F.col("most.rows"), F.col("most.members")).alias("many"))
    # Blocks 0 to few - 1 have the rows outside the largest component, the next `many` its own.
    rest = named.join(mixed, "key").withColumn("inside", F.col("comp") == F.col("main"))
    hashed = F.xxhash64("id", "key")
    rest = rest.withColumn("mine", F.when(F.col("inside"), F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))))
    last = F.when(F.col("inside"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    return rest.select("id", "n", "comp", "mine", "lo", "hi", F.xxhash64("key", "lo", "hi").alias("task"))


def bridges(named: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between different components, by full sets, from all buckets (key, id, n, comp) with several components."""
    rest = stored(dealt(named), "mixed")
    sets = _sets(semi(docs, stored(rest.select("id").distinct(), "ids"), "id"), shingle)
    tasks = rest.join(sets, "id").repartition("task").sortWithinPartitions("task")
    return tasks.mapInArrow(_bridges(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows_ = stored(sketched(docs, shingle, bands, rows), "sketch")
    full = rows_.where("n > 0 AND id IS NOT NULL")
    classes = stored(full.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    # A row is its class's own row if it has the class's id; an id that comes twice is harmless.
    own = full.join(classes, (full.id == classes.rep) & (full.h1 == classes.h1) & (full.h2 == classes.h2) & (full.n == classes.n), "left_semi")
    nodes = stored(own.select("id", "n", "bands", *SIGNATURE), "nodes")

    keys = nodes.select("id", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("key", "leader")
    members = stored(keys.join(buckets, "key"), "buckets")
    bits = nodes.select("id", "n", *SIGNATURE)

    def near(pairs: DataFrame) -> DataFrame:
        a, b = bits.alias("x"), bits.alias("y")
        return pairs.join(a, F.col("a") == F.col("x.id")).join(b, F.col("b") == F.col("y.id")).where(_similar("x", "y", percent)).select("a", "b")

    star = stored(near(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()), "star")
    links = stored(verified(star, docs, shingle, percent).unionByName(_same_id(full, classes)), "links")
    first = components(links)

    named = members.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    more = stored(bridges(stored(named, "named"), docs, shingle, percent), "cross")
    comp = first.withColumnRenamed("comp", "root")
    ends = more.join(comp.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    second = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct())

    roots = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    roots = roots.join(second.select(F.col("node").alias("root"), "comp"), "root", "left").select("n", "h1", "h2", "copies", F.coalesce("comp", "root").alias("root"))
    some = rows_.select("id", "n", "h1", "h2")
    # Texts without shingles have no class; a class of very many copies is joined as a hot key.
    out = looked_up(some.where("n > 0"), stored(roots, "roots"), ["n", "h1", "h2"], "copies").select("id", "n", "root").unionByName(some.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("root")))
    found = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(found == F.col("id"), F.lit(True)).alias("kept"))


def _same_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes that rows of one id are in, so that they count as one document."""
    twice = full.groupBy("id").count().where("count > 1").select("id")
    rows = full.join(twice, "id", "left_semi").join(classes, ["n", "h1", "h2"]).select("id", "rep")
    return rows.join(rows.groupBy("id").agg(F.min("rep").alias("a")), "id").where("a <> rep").select("a", F.col("rep").alias("b"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
kinds AS (SELECT min(doc_id) AS rep, list(doc_id) AS ids, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
members AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM kinds),
common AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c, any_value(x.n + y.n) AS total FROM members x JOIN members y ON x.g = y.g AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (total - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT rep, unnest(ids) FROM kinds UNION SELECT unnest(ids), rep FROM kinds),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(component_id, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(component_id, doc_id)) AS kept
FROM sizes LEFT JOIN comp USING (doc_id)
"""
