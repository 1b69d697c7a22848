"""Scores of whole tables against plain ones, text by text."""

import math
import zlib

import numpy as np
import pytest

from fathom.llm import quality, toxicity
from fathom.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_quality(model, text):
    """A walk through the trees node by node."""
    x = quality.statistics([text])[0]
    total = model.base
    for feature, threshold, leaf in zip(model.feature.tolist(), model.threshold.tolist(), model.leaf.tolist(), strict=True):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def test_quality_of_a_whole_table(spark):
    docs = table(spark, SF, "documents")
    model = quality.train(docs, table(spark, SF, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.op8_quality(spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(plain_quality(model, texts[r.doc_id]), abs=1e-12)
        assert r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = {r.doc_id for r in quality.filtered(docs, model).collect()}
    assert kept == {i for i, t in texts.items() if plain_quality(model, t) >= quality.THRESHOLD}


def plain_patterns(text, lexicon):
    """Marks by looking back and ahead from each insult and threat, without machines."""
    t, sums = toxicity, dict.fromkeys(toxicity.PATTERNS, 0.0)
    w = t._texts([text])
    symbol, weight, word, _ = lexicon.symbols(w)
    ends = np.cumsum(t._CLAUSE_END[w.data])[w.starts]
    for clause in sorted(set(ends.tolist())):
        at = np.flatnonzero(ends == clause)
        kinds, worth = symbol[at].tolist(), weight[at].tolist()
        if sum(n > 0 for n in word[at].tolist()) > 1:
            said, arcs = t.run(t.PHRASES, list(zip(kinds, word[at].tolist(), strict=True)))
            worth = [x if k == c else a for (k,), c, x, a in zip(said, kinds, worth, arcs, strict=True)]
            kinds = [k for (k,) in said]
        for i, kind in enumerate(kinds):
            if kind not in (t.INSULT, t.THREAT):
                continue

            def gap(trigger, step, i=i, kinds=kinds):
                j = i + step
                while 0 <= j < len(kinds):
                    if kinds[j] == trigger:
                        return abs(j - i)
                    j += step
                return None

            x = worth[i]
            ahead, behind, no, told = gap(t.TARGET, 1), gap(t.TARGET, -1), gap(t.NEGATION, -1), gap(t.REPORT, -1)
            near = t.NEARNESS
            aimed = next((d for d in (ahead, behind) if d is not None and d <= len(near["at"])), None)
            if aimed is not None:
                x *= near["at"][aimed - 1]
            denied = no is not None and no <= len(near["denied"])
            if denied:
                x *= near["denied"][no - 1]
            name = "denied" if denied else "reported" if told is not None else f"{'insult' if kind == t.INSULT else 'threat'}{'_at' if aimed is not None else ''}"
            sums[name] += x
    return np.array(list(sums.values()))


def test_toxicity_of_a_whole_table(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.op7_toxicity(spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    found = 0
    for r in got:
        x = plain_patterns(texts[r.doc_id], model.lexicon)
        found += x.any()
        z = float(np.log1p(x) @ model.weight + model.bias)
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(z, -30), 30))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert found > 3


def test_pipeline_hands_small_batches_to_python(spark):
    import corpus_pipeline
    from fathom.llm import common

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        assert {stage.__name__ for _, stage in corpus_pipeline.STAGES if hasattr(stage, "__wrapped__")} == {stage.__name__ for _, stage in corpus_pipeline.STAGES}
        common.small_batches(spark)
        rows = spark.range(3000).coalesce(1).selectExpr("repeat('x', 4000) AS text")
        sizes = [r.n for r in rows.mapInArrow(lambda batches: (b.__class__.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        assert sum(sizes) >= 12_000_000 and max(sizes) < 4 << 20
        spark.conf.set(key, "1m")
        common.small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
