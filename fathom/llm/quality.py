"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete binary trees of one depth, flattened into arrays of features, thresholds and
leaves, so that numpy takes a whole chunk of documents one level down in one step. They are fitted on the
driver on a bounded sample of labelled rows (`per_class` of each class), of which only the statistics are
collected; the statistics themselves are always those of whole texts.

Null and empty texts have statistics of zero and are scored like any text. Repeated rows are scored alike.
Without labels of both classes every score is the share of good labels (0.5 without any). An empty table
gives no rows. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .common import SPACE_TABLE, Words, by_chunk, fold_of, runs, splitter, table

PER_CLASS = 6_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAST_LEAF, L2 = 80, 4, 64, 0.15, 20.0, 1.0

_ASCII = [chr(i) for i in range(128)]
_DIGIT = splitter(bytes(range(48, 58)))
_UPPER = splitter(bytes(range(65, 91)))
_STOP = splitter(b".!?")
_POINT = splitter(b".,;:!?'\"()-")
_SYMBOL = splitter(bytes(i for i in range(33, 127) if not _ASCII[i].isalnum())) & ~_POINT
_HIGH = np.arange(256) >= 128
STATISTICS = ["bytes", "words", "word_length", "symbols", "digits", "upper", "spaces", "distinct_words", "top_word", "repeats", "stops", "symbol_words", "lines", "distinct_lines", "short_words", "long_words", "non_ascii", "points", "distinct_pairs", "capitalised"]


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of different hashes, and how often its commonest one comes."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, dtype=np.int64)
    times = np.diff(np.concatenate([new, [len(h)]]))
    top = np.zeros(docs, dtype=np.int64)
    np.maximum.at(top, doc[new], times)
    return np.bincount(doc[new], minlength=docs), top


def statistics(texts: list) -> np.ndarray:
    """(texts, statistics): see STATISTICS."""
    w = Words(texts, SPACE_TABLE)
    n, size, count = len(texts), np.maximum(w.size, 1), np.maximum(w.count, 1)

    def bytes_of(kinds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kinds[w.data])])
        return (sums[w.first[:-1] + w.size] - sums[w.first[:-1]]) / size

    def words_with(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc[mask], minlength=n) / count

    h, length = w.hashes(), w.ends - w.starts
    last, head = w.data[w.ends - 1], w.data[w.starts]
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    kinds, top = _distinct(h, w.doc, n)
    pairs, at = runs(h, w.doc, 2)
    pair_kinds, _ = _distinct(pairs, w.doc[at], n)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])])[: len(h)]
    lines = Words(texts, splitter(b"\n\r"))
    line_kinds, _ = _distinct(lines.hashes(), lines.doc, n)
    columns = [
        np.log1p(w.size), np.log1p(w.count), np.bincount(w.doc, weights=length, minlength=n) / count, bytes_of(_SYMBOL), bytes_of(_DIGIT), bytes_of(_UPPER), bytes_of(SPACE_TABLE),
        kinds / count, top / count, words_with(again), words_with(_STOP[last]), words_with(symbol[w.ends] > symbol[w.starts]), lines.count / count, line_kinds / np.maximum(lines.count, 1),
        words_with(length <= 3), words_with(length >= 12), bytes_of(_HIGH), bytes_of(_POINT), pair_kinds / np.maximum(w.count - 1, 1), words_with(_UPPER[head]),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


class Trees:
    """A forest of complete trees in flat arrays; its output is a log-odds."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature = np.empty((0, (1 << depth) - 1), dtype=np.int32)
        self.threshold = np.empty((0, (1 << depth) - 1))
        self.leaf = np.empty((0, 1 << depth))

    def add(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> None:
        self.feature, self.threshold, self.leaf = (np.vstack([old, new]) for old, new in ((self.feature, feature), (self.threshold, threshold), (self.leaf, leaf)))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosts trees on the logistic loss; splits are sought between quantile bins."""
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6) if 0 < share < 1 else share
    base = 30.0 * (2 * share - 1) if share in (0.0, 1.0) else float(np.log(share / (1 - share)))
    model = Trees(base, depth)
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, threshold = np.zeros((1 << depth) - 1, dtype=np.int32), np.full((1 << depth) - 1, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(nodes, 1e-9)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                cell = at * width + binned[:, f]
                gl, hl, nl = (np.bincount(cell, weights=v, minlength=nodes * width).reshape(nodes, width).cumsum(axis=1) for v in (g, h, np.ones(len(y))))
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
                k = gain[:, :-1].argmax(axis=1)
                found = gain[np.arange(nodes), k]
                better = found > best
                best[better] = found[better]
                feature[first : first + nodes][better] = f
                threshold[first : first + nodes][better] = c[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_of = node - len(feature)
        leaf = rate * np.bincount(leaf_of, weights=g, minlength=1 << depth) / (np.bincount(leaf_of, weights=h, minlength=1 << depth) + L2)
        model.add(feature, threshold, leaf)
        margin += leaf[leaf_of]
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality") -> Trees:
    """Fits on labelled documents outside the held-out fold."""
    rows, counts = labelled.sample(docs, labels, label, fold_of("doc_id", 5) != 0, per_class)

    def measure(batch, texts):
        x = statistics(texts)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "y", "x"])

    found = rows.mapInArrow(by_chunk(measure), "id long, y int, x array<double>").orderBy("id").collect()
    x = np.array([r.x for r in found]).reshape(len(found), len(STATISTICS))
    y = np.array([r.y for r in found], dtype=np.float64)
    drawn = {k: max(1, int((y == k).sum())) for k in counts}
    weight = np.array([counts[k] / drawn[k] for k in y], dtype=np.float64)
    return fit(x, y, weight / weight.mean() if len(weight) else weight)


def scored(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batch, texts):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(statistics(texts)))], names=["doc_id", "score"])

    return docs.mapInArrow(by_chunk(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def filtered(docs: DataFrame, model: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least the threshold, unchanged."""

    def work(batch, texts):
        return batch.filter(pa.array(model.scores(statistics(texts)) >= threshold))

    return docs.mapInArrow(by_chunk(work, text_col), docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
