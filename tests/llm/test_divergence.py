"""Divergence of sources against a plain computation."""

import random
import re
from collections import Counter

import pytest

from fathom.llm.divergence import OP13_SQL, divergence, op13_source_divergence
from tests.oracle import agree, connect


def brute(rows, least, top):
    docs = [((t or ""), (g or ""), (s or "")) for t, g, s in rows]
    words = [[w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in docs]
    out = []
    for lang in {g for _, g, _ in docs}:
        of = Counter(w for ws, (_, g, _) in zip(words, docs, strict=True) if g == lang for w in set(ws))
        kept = [w for w in of if of[w] >= least]
        sources = {s for _, g, s in docs if g == lang}
        count = {s: Counter(w for ws, d in zip(words, docs, strict=True) if d[1:] == (lang, s) for w in ws) for s in sources}

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p, q = {s: shares(count[s]) for s in sources}, shares(sum(count.values(), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode(), t) for t in sources if t != s))
            terms = sorted((-(p[s][w] - q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, t, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(1, 50), (3, 4), (1000, 50)])
def test_brute(spark, least, top):
    draw = random.Random(least)
    words = ["a", "B", "b", "É", "é", "Éa", "ab", "x1y", "ß-z", "日本", "_q", "ç9"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(draw.choices(words, k=draw.randrange(0, 30))), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", "Ü", None, "only"][: draw.randrange(2, 7)])) for _ in range(200)]
    rows += [(None, "en", "silent"), ("", "xx", "s1"), ("solo solo", "yy", None)] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int")
    assert sorted(tuple(r) for r in divergence(df, least_docs=least, top=top).collect()) == brute(rows, least, top)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    agree(op13_source_divergence(spark, sf), OP13_SQL, connect(sf))
    assert divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
