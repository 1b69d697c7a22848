"""The numbered queries over whole small tables, against SQL where there is some."""

import pytest

from fathom.llm import registry

from ..oracle import agree, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees(spark, name):
    agree(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], connect(SF))


def test_columns(spark):
    want = {
        "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    }
    for name, columns in want.items():
        df = registry.QUERIES[name](spark, SF)
        assert columns.items() <= dict(df.dtypes).items()
        assert df.count() == df.select("doc_id").distinct().count() == 200
        assert df.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    texts = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == p.COLUMNS
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] and 0 < sizes[3] < 200
    for r in docs.collect():
        assert r.text == texts[r.doc_id] or "[SECRET]" in r.text and r.n_chars == len(r.text)
    pieces = p.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    whole = {tuple(r) for r in p.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert whole == {tuple(r) for r in pieces.select("doc_id", "start", "length", "ids_crc32").collect()}


def test_pipeline_edges(spark, clashing):
    """Null, empty, long and repeated texts, null and repeated ids, other columns, an empty table: each stage decides as its docstring says."""
    import corpus_pipeline as p
    from fathom.llm import quality

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    own = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"]
    long = " ".join(f"z{i}" for i in range(60_000))
    rows = [(1, own[0]), (2, own[0]), (1, own[0]), (None, own[0]), (None, own[1]), (None, own[1]), (3, own[2]), (3, own[3]), (4, None), (5, ""), (6, ""), (7, long), (8, f"{long} {long}"), (9, f"{own[4]} {item}"), (9, own[5]), (None, f"{own[6]} {item}")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars"))
    names = dict(p.STAGES)
    got = {name: names[name](spark, docs, SF) for name in names}
    assert all(got[n].columns == p.COLUMNS for n in list(names)[:-1])
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [(i, t) for i, t in rows if model.scores(quality.statistics([t]))[0] >= quality.THRESHOLD]
    assert sorted(((str(r.doc_id), r.text or "") for r in got["quality"].collect())) == sorted((str(i), t or "") for i, t in good)
    key = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    plain = lambda some: sorted((str(i), t or "") for i, t in some)
    kept = [(1, own[0]), (None, own[1]), (3, own[2]), (3, own[3]), (4, None), (5, ""), (6, ""), (7, long), (9, rows[13][1]), (9, own[5]), (None, rows[15][1])]
    assert key(got["near_duplicates"]) == plain(kept)
    assert key(got["decontamination"]) == plain(r for r in rows if item not in (r[1] or ""))
    assert key(got["secrets"]) == plain(rows)
    assert got["packing"].agg({"length": "sum"}).first()[0] == got["packing"].select("doc_id", "doc_tokens", "start", "length").where("start = 0").agg({"doc_tokens": "sum"}).first()[0]
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
