import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import embed_dedup, minhash, sharding
from fathom.llm.common import SPACE_TABLE, Words, components, shingles


def closure(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def sets_of(text, k):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(seed=1):
    random.seed(seed)
    docs, i = [(100, None), (101, ""), (102, " \n"), (103, "One"), (104, "one"), (105, "ONE two"), (106, "é É"), (107, "é é")], 0
    for _ in range(12):
        base = random.choices([f"w{j}" for j in range(400)], k=random.randint(20, 200))
        for _ in range(random.randint(1, 12)):
            w = list(base)
            for _ in range(random.randint(0, 8)):
                w[random.randrange(len(w))] = f"x{random.randrange(1000)}"
            docs.append((i, " ".join(w)))
            i += 1
    return docs


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_brute(spark, clashing, k):
    docs = corpus(k)
    sets = {i: sets_of(t, k) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    got = minhash.near_duplicates(clashing(spark.createDataFrame(docs, "doc_id long, text string")), shingle=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_minhash_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, t), (4, t), (9, t), (9, "alone here is"), (7, "alone here is"), (None, t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(docs, shingle=2).collect())
    assert got == sorted([("4", "4", True), ("4", "4", True), ("9", "4", False), ("9", "4", False), ("7", "4", False), ("None", "None", True)])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_open_buckets_are_compared(spark):
    """A chain in which the smallest id is linked with few."""
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base[:-i or None], *[f"v{j}" for j in range(i)]])) for i in range(0, 30, 2)]
    sets = {i: sets_of(t, 2) for i, t in docs}
    want = closure(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.concatenate([common, rng.integers(0, 2**63, 50).astype(np.uint64)]), np.concatenate([common, rng.integers(0, 2**63, 50).astype(np.uint64)])
    s = minhash.sketch(np.concatenate([a, b, a[:3]]), np.repeat([0, 1, 2], [450, 450, 3]), 4, 1024)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.05
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()


def test_common_counts():
    sets = [np.array(x, dtype=np.uint32) for x in ([1, 2, 3], [2, 3, 4], [9], [])]
    at = np.arange(4)
    got = minhash.common_counts(sets, at, at)
    assert got[0, 1] == 2 and got[0, 2] == 0 and got[3].sum() == 0
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 20_000, n)).astype(np.uint64) for n in (9_000, 9_000, 12_000, 5)]
    got = minhash.common_counts(sets, at, at[1:3])
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j + 1])) for i in range(4) for j in range(2) if i != j + 1)


def _bucket(spark, sets, comps):
    """The links that one bucket with these texts sends."""
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(sets, 1)], "id long, text string")
    named = spark.createDataFrame([(7, i, len(w), c) for i, (w, c) in enumerate(zip(sets, comps, strict=True), 1)], "key long, id long, n long, comp long")
    return {(r.a, r.b) for r in minhash.bridges(named, docs, 1, 80).collect()}


def test_a_refused_pair_hides_no_link(spark):
    """1 and 2 miss the bound by one shingle; 1 and 4 are a link between the same two components."""
    words = [f"w{i}" for i in range(3000)]
    one = words[:2250]
    miss = [*one[:1999], *(f"x{i}" for i in range(251))]  # 1999 of 2501
    hit = [*one[:2000], *(f"y{i}" for i in range(250))]  # 2000 of 2500
    assert _bucket(spark, [one, miss, ["z"], hit], [1, 2, 1, 2]) == {(1, 4)}


@pytest.mark.parametrize("n", [2_000, 50_000])
def test_large_sets_at_the_bound(spark, n):
    common, left = [f"w{i}" for i in range(n * 8 // 10)], [f"l{i}" for i in range(n // 10)]
    right = [f"r{i}" for i in range(n // 10)]
    assert _bucket(spark, [common + left, common + right], [1, 2]) == {(1, 2)}
    assert _bucket(spark, [common[:-1] + left, common[:-1] + right], [1, 2]) == set()


def test_hot_keys(spark, monkeypatch):
    """Hubs, labels of large components and classes of many copies are broadcast: the results are the same."""
    from fathom import storage
    from fathom.llm import common

    want = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(corpus(9) * 2, "doc_id long, text string"), shingle=2).collect()}
    monkeypatch.setattr(storage, "HOT", 1)
    monkeypatch.setattr(common, "HOT", 1)
    got = minhash.near_duplicates(spark.createDataFrame(corpus(9) * 2, "doc_id long, text string"), shingle=2).collect()
    assert len(got) == 2 * len(want) and {r.doc_id: r.component_id for r in got} == want
    star = [(i, 3) for i in range(4, 40)] + [(50 + i, 51 + i) for i in range(9)]
    labels = {r.node: r.comp for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert labels == dict.fromkeys(range(3, 40), 3) | dict.fromkeys(range(50, 60), 50)


def test_shingles_of_short_texts():
    g, d = shingles(Words(["a b", "a b", "b a", "", None], SPACE_TABLE), 5)
    assert d.tolist() == [0, 1, 2] and g[0] == g[1] != g[2]


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(5, 4)], "a long, b long")
    got = {r.node: r.comp for r in components(e).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {4: 4, 5: 4}
    assert components(e.limit(0)).count() == 0


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(15):
        c = rng.standard_normal(24)
        c /= np.linalg.norm(c)
        for _ in range(rng.integers(1, 9)):
            rows.append((i, (c + rng.standard_normal(24) * rng.uniform(0, 0.09)).astype(np.float32).tolist()))
            i += 1
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [None, *[1.0] * 23]), (505, rows[0][1]), (506, [x * 4 for x in rows[0][1]]), (507, [1.0, 0.0]), (508, [1.0, 0.01]), (509, [float("inf")] * 24)]
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_embeddings_brute(spark, clashing, block):
    rows = vectors()
    unit = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    comp = closure([i for i, _ in rows], links)
    n = {i: sum(i in p for p in links) for i, _ in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embed_dedup.near_vectors(clashing(df), block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], comp[i], comp[i] == i) for i, _ in rows}
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_agreement_is_measured():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal(x.shape) * 0.3 / np.sqrt(32)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = embed_dedup.projections(x, 50, 1), embed_dedup.projections(y, 50, 1)
    want = np.mean([embed_dedup.agreement(c) for c in (x * y).sum(axis=1)])
    assert abs((a == b).mean() - want) < 0.02


def test_sharding(spark, clashing):
    rows = [(i, None if i == 3 else "t" * (i % 7), None if i % 5 == 0 else f"s{min(i % 9, 3)}") for i in range(997)] + [(5, "x", "s1"), (5, "x", "s1"), (None, "y", None)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sharding.assign_shards(df, shards=10).collect()
    assert len(got) == 1000
    for s in range(10):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(100))
        for source in {r.source for r in got}:
            share = sum(r.source == source for r in got) / 10
            assert abs(sum(r.source == source for r in mine) - share) <= 2
    assert sharding.assign_shards(df.limit(0)).count() == 0
    few = sharding.assign_shards(df.limit(3), shards=40).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string")
    placed = sharding.assign_shards(docs, shards=4)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("_shard").agg(F.count("*").alias("n")).where("n = 5").count() == 4


def test_shard_arithmetic_beyond_doubles():
    """place * shards DIV total, where a double would be one off."""
    total, shards = (1 << 56) + 3, 40
    for place in (total - 1, total // 2, total // 40 * 39 + 39):
        shard = place * shards // total
        start = (shard * total + shards - 1) // shards
        assert 0 <= place - start
        assert start * shards // total == shard
        assert (start - 1) * shards // total == shard - 1


def test_a_stray_row_in_a_large_bucket_is_linear(spark):
    """20,000 linked rows and one other, a tenth of a block of others, or all apart."""
    from pyspark.sql import functions as F

    from fathom.llm import minhash

    n = 20_000
    named = spark.range(n).select(F.lit(5).cast("long").alias("key"), "id", F.lit(9).cast("long").alias("n"), F.lit(0).cast("long").alias("comp"))
    stray = lambda k: spark.range(n, n + k).select(F.lit(5).cast("long").alias("key"), "id", F.lit(9).cast("long").alias("n"), F.col("id").alias("comp"))
    blocks = -(-n // minhash.BLOCK_ROWS)
    assert minhash.dealt(named).count() == 0
    for k in (1, 100):
        tasks = minhash.dealt(named.unionByName(stray(k))).cache()
        assert tasks.count() == n + k * (1 + blocks)
        met = tasks.where(f"comp = {n}").select("task").join(tasks.where("comp = 0").select("task", "id"), "task")
        assert met.select("id").distinct().count() == n


def test_common_lines_bring_no_pairs(spark):
    """One line in every document and every item: only documents that hold an item meet it, and all of those are found."""
    import random

    from pyspark.sql import functions as F

    from fathom.llm import decontaminate

    draw = random.Random(3)
    words = lambda k: [draw.choice("abcdefgh") + str(draw.randrange(4000)) for _ in range(k)]
    line = words(12)
    items = [words(44) + line + words(44) for _ in range(40)]
    docs = [words(60) + line + words(60) for _ in range(300)]
    for i, at in enumerate(range(0, 300, 15)):
        docs[at] = words(20) + items[i][50:] + line + words(9) + items[i][:25]
    frame = lambda rows: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "k long, text string")
    bench = frame(items).withColumnRenamed("k", "item_id")
    seeds = bench.withColumn("item", F.col("item_id")).mapInArrow(decontaminate._item_seeds(5), "item_id long, item long, words array<long>, seeds array<long>, times array<long>")
    seeds = seeds.select("item", F.size("words").alias("n"), F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("item", "n", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    every = frame(docs).withColumn("item_id", F.col("k")).withColumn("item", F.col("k")).mapInArrow(decontaminate._item_seeds(5), "item_id long, item long, words array<long>, seeds array<long>, times array<long>")
    hits = every.select(F.col("item").alias("row"), F.explode("seeds").alias("seed"))
    keys = decontaminate.rare_seeds(seeds, hits, 5, 0.5)
    assert hits.join(keys, "seed").select("row", "item").distinct().count() <= 40
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(docs), bench, id_col="k").collect()}
    assert got == {(at, i) for i, at in enumerate(range(0, 300, 15))}
    assert got == {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(docs), bench, id_col="k", block_chars=10).collect()}
