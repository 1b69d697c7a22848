"""Periodic runs of words: stretches that repeat with a smallest period q over at least four periods.

A run is a stretch of consecutive words of a text with smallest period q (words q apart are identical) and
max(6, 4 * q) words or more that can't be extended on either side. Words are what ASCII white space leaves apart.

Block matching: for every power of two b, the words at b * k to b * (k + 1) - 1 are a key, a sequence of word
numbers in a pyahocorasick automaton, and the document is searched for all keys at once. A run with a period
in [b, 2b) holds an aligned block whose next copy begins one period later, still in the run, because a run is
four periods long. So each occurrence at a distance in [b, 2b) from its own block is a seed, extended
word by word to both sides. Scales ascend, and of one stretch the smallest period counts. In
a run every word but those of the first period has its like at most q words before; where that fails there is
nothing to search at this scale, and neither deep inside a run that is known: two runs share less than the sum of their
periods. Both leave blocks out that no run can hold, so all runs are found.

Memory: per text some hundred bytes for each word. Null and empty texts have no words and no runs. Repeated rows give
a row each; rows with a null id are searched like others. Ties don't arise: runs differ in start or period. An empty table
gives no rows. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_chunk, table

#: A run has this many periods, and this many words, at least.
PERIODS, LEAST = 4, 6
_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered_words(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many words x and y have in common from the begin on."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        differ = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def _stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return [(s, e) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e - s >= least]


def _seeds(w: np.ndarray, begin: int, end: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Aligned blocks of b words in a stretch of w (where they begin), and copies of each at a distance from b to 2b - 1."""
    first = -(-begin // b) * b
    text = tuple(w[begin:end].tolist())
    automaton, keys, key_of = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, []
    for p in range(first, end - b + 1, b):
        key = text[p - begin : p - begin + b]
        if key not in keys:
            keys[key] = len(keys)
            automaton.add_word(key, keys[key])
        key_of.append(keys[key])
    if len(key_of) < 2:  # a run holds three
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
    at, key = found[:, 0] + (begin - b + 1), found[:, 1]
    block = (at - b) // b * b  # the one aligned block whose distance to `at` is in range
    ok = block >= first
    ok[ok] = np.array(key_of, dtype=np.int64)[(block[ok] - first) // b] == key[ok]
    return block[ok], at[ok]


def word_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start and period."""
    n = len(w)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    back = np.full(n, n + 1, dtype=np.int64)  # to the word's like before it
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found: dict[tuple[int, int], int] = {}
    b = 1
    while PERIODS * b <= n:
        near = back < 2 * b
        for s, e in found:
            near[s + 4 * b : max(s + 4 * b, e - 4 * b)] = False
        regions: list[list[int]] = []
        for s, e in _stretches(near, max((PERIODS - 1) * b, LEAST - 2 * b + 1)):
            s = max(0, s - 2 * b + 1)
            if regions and s <= regions[-1][1]:
                regions[-1][1] = e
            else:
                regions.append([s, e])
        seeds = [_seeds(w, s, e, b) for s, e in regions]
        if seeds:
            p, at = (np.concatenate(x) for x in zip(*seeds, strict=True))
            for s, e in found:  # a copy within a run of smaller period tells of that period's multiples only
                out = (p < s) | (at + b > e)
                p, at = p[out], at[out]
            order = np.lexsort((p, at - p))
            last = (0, 0, 0)
            for i, d in zip(p[order].tolist(), (at - p)[order].tolist(), strict=True):
                if d == last[2] and last[0] <= i < last[1] - d:
                    continue
                start = i - _agree(w[:i][::-1], w[: i + d][::-1])
                end = i + d + b + _agree(w[i + b :], w[i + d + b :])
                last = (start, end, d)
                if end - start >= max(LEAST, PERIODS * d):
                    found.setdefault((start, end), d)
        b *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (array of start, length, period in words), collapsed (the text without what repeats a run's first period)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def work(batch, texts):
        counts, runs, kept = [], [], []
        for text in texts:
            words = (text or b"").split()
            found = word_runs(numbered_words(words))
            keep = np.ones(len(words), dtype=bool)
            for start, length, period in found:
                keep[start + period : start + length] = False
            counts.append(len(words))
            runs.append([{"start": s, "length": k, "period": q} for s, k, q in found])
            kept.append(b" ".join(words if not found else [words[i] for i in np.flatnonzero(keep).tolist()]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.mapInArrow(by_chunk(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {_RUNS}, collapsed string")


def planted(id_col: str, text_col: str) -> Column:
    """The text; for each tenth checksum of an id, with its words from some place on replaced by repetitions of the first of them. A null id changes nothing."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    repeated = F.transform(
        F.array(F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))),
        lambda w: F.transform(
            F.array(g % F.size(w)),
            lambda a: F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % (1 + F.floor((F.size(w) - a) / (3 + g % 8)))).cast("int")))), " "),
        )[0],
    )[0]
    return F.when((h % 10 == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), repeated).otherwise(F.col(text_col))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", planted("doc_id", "text").alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    rows = rows.withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH steps AS (SELECT list(c ORDER BY b) AS crc FROM (
  SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS c FROM (SELECT unnest(range(256))::BIGINT AS b))),
split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda d: ord(d)::BIGINT) AS b FROM documents),
hashed AS (SELECT doc_id, ws, len(ws) AS n, xor(list_reduce(b, lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM split, steps),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
full_ AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS ws FROM placed),
words AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM full_),
same AS (SELECT x.doc_id, y.i - x.i AS d, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
islands AS (SELECT doc_id, d, i, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS g FROM same),
runs AS (SELECT doc_id, s, l, min(d) AS q FROM (SELECT doc_id, d, min(i) AS s, count(*) + d AS l FROM islands GROUP BY doc_id, d, g) WHERE l >= greatest(6, 4 * d) GROUP BY ALL),
digests AS (SELECT doc_id, count(*) AS n_runs, max_by({'s': s, 'l': l, 'q': q}, {'l': l, 's': -s, 'q': -q}) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM full_ LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
