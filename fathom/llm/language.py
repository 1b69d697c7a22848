"""Language of words and documents by a linear-chain conditional random field.

A word's features are its affixes and character n-grams (hashed runs of 2 to 5 bytes of the word between
marks of its ends) and itself (lexicon), all in one hashed table of weights; a chain of words has a weight
for each pair of neighbouring labels. Forward-backward gives each word's probabilities; a document's label
is the one with the largest sum, its score the mean probability of that label over its words.
Chains are cut after CHAIN words.

Weights and transitions are fitted on the driver, on a bounded sample: up to `per_language` whole documents of
each language, in the order of a hash, until their texts sum up to `language_bytes`; one at least, so every
language that labelled texts have is learned. Part of the chains are joined from two languages, so that
the transitions of code-switched text are learned. Labels and ids serve for learning only.

A text that is null or has no letter is `und` with score 0. Without any labelled text, all are. Repeated
rows are labelled alike. An empty table gives no rows. Columns other than those named are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .common import PLAIN_TABLE, Words, by_chunk, fold_of, mix, stored, table

PER_LANGUAGE, LANGUAGE_BYTES = 250, 500_000
CHAIN, FEATURES, ROUNDS, RATE, L2 = 64, 1 << 16, 24, 0.5, 1e-6
UNKNOWN = "und"
_ORDERS = (2, 3, 4, 5)
_LETTER = re.compile(r"[^\W\d_]")
_LETTER_BYTE = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])


def _texts(texts: list) -> Words:
    """The words that hold a letter."""
    w = Words([t.lower() if t else t for t in texts], PLAIN_TABLE)
    sums = np.concatenate([[0], np.cumsum(_LETTER_BYTE[w.data])])
    keep = sums[w.ends] > sums[w.starts]
    w.starts, w.ends, w.doc = w.starts[keep], w.ends[keep], w.doc[keep]
    w.count = np.bincount(w.doc, minlength=len(texts)).astype(np.int64)
    return w


def features(w: Words, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words at the given places: feature numbers, the words they belong to (ascending), and their values."""
    length = w.ends[at] - w.starts[at]
    size = length + 2
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(at)), size)
    inner = np.arange(len(owner)) - first[owner]
    b = w.data[np.clip(w.starts[at][owner] + inner - 1, 0, len(w.data) - 1)].astype(np.uint64)
    b[first], b[first + size - 1] = 2, 3  # the marks of a word's ends
    numbers, owners, values = [(h[at] % np.uint64(FEATURES)).astype(np.int64)], [np.arange(len(at))], [np.ones(len(at), dtype=np.float32)]
    g = b
    for k in range(2, max(_ORDERS) + 1):
        g = g[:-1] * np.uint64(0x100000001B3) + b[k - 1 :] + np.uint64(1)
        if k in _ORDERS and len(g):
            whole = np.flatnonzero(owner[: len(g)] == owner[k - 1 :])
            numbers.append((mix(g[whole]) % np.uint64(FEATURES)).astype(np.int64))
            owners.append(owner[whole])
            values.append((1 / np.maximum(size - k + 1, 1)).astype(np.float32)[owner[whole]])
    owners_ = np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    return np.concatenate(numbers)[order], owners_[order], np.concatenate(values)[order]


def emissions(f: tuple[np.ndarray, np.ndarray, np.ndarray], words: int, weight: np.ndarray) -> np.ndarray:
    """(words, labels) scores. Every word has at least its lexicon feature."""
    if not words:
        return np.zeros((0, weight.shape[1]), dtype=np.float32)
    number, owner, value = f
    return np.add.reduceat(weight[number] * value[:, None], np.searchsorted(owner, np.arange(words)), axis=0)


def forward_backward(e: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded chains (chains, steps, labels): each word's probabilities, and the expected number of each move."""
    chains, steps, labels = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    m = np.exp(move)
    a, b = np.empty_like(p), np.ones_like(p)
    a[:, 0] = p[:, 0] * np.exp(start)
    a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (a[:, t - 1] @ m) * p[:, t]
        a[:, t] = x / x.sum(axis=1, keepdims=True)
    moves = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        inside = t + 1 < length
        x = (p[:, t + 1] * b[:, t + 1]) @ m.T
        b[:, t] = np.where(inside[:, None], x / x.sum(axis=1, keepdims=True), 1.0)
        joint = a[inside, t][:, :, None] * m * (p[inside, t + 1] * b[inside, t + 1])[:, None, :]
        moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    out = a * b
    return out / out.sum(axis=2, keepdims=True), moves


def chains_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain, for texts of so many words."""
    per = -(-count // CHAIN)
    text = np.repeat(np.arange(len(count)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = (np.cumsum(count) - count)[text] + nth * CHAIN
    return first, np.minimum(CHAIN, count[text] - nth * CHAIN)


class Model:
    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages, self.weight = languages, np.zeros((FEATURES, k), dtype=np.float32)
        self.start, self.move = np.zeros(k), np.zeros((k, k))

    def probabilities(self, w: Words) -> np.ndarray:
        """(words, labels)."""
        kinds, at, kind = np.unique(w.hashes(), return_index=True, return_inverse=True)
        e = emissions(features(w, at, w.hashes()), len(kinds), self.weight)
        out = np.empty((len(kind), len(self.languages)), dtype=np.float32)
        first, length = chains_of(w.count)
        for i in range(0, len(first), 4096):
            f, n = first[i : i + 4096], length[i : i + 4096]
            places = np.minimum(f[:, None] + np.arange(n.max()), len(kind) - 1)
            inside = np.arange(n.max()) < n[:, None]
            p, _ = forward_backward(np.where(inside[:, :, None], e[kind[places]], 0), n, self.start, self.move)
            out[places[inside]] = p[inside]
        return out

    def predict(self, texts: list) -> tuple[list[str], np.ndarray, Words, np.ndarray]:
        """Each text's label and score, and the words with their labels."""
        w = _texts(texts)
        k = len(self.languages)
        if not k or not len(w.starts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), w, np.zeros(len(w.starts), dtype=np.int64)
        p = self.probabilities(w)
        total = np.stack([np.bincount(w.doc, weights=p[:, j], minlength=len(texts)) for j in range(k)], axis=1)
        best = total.argmax(axis=1)
        known = np.array([bool(t and _LETTER.search(t)) for t in texts]) & (w.count > 0)
        score = np.where(known, total[np.arange(len(texts)), best] / np.maximum(w.count, 1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.clip(score, 0, 1), w, p.argmax(axis=1)


def fit(texts: list, langs: list[str], rounds: int = ROUNDS) -> Model:
    """Maximises the likelihood of the words' labels by AdaGrad over all chains at once."""
    model = Model(sorted(set(langs)))
    k = len(model.languages)
    w = _texts(texts)
    if k < 2 or not len(w.starts):
        return model
    label = np.array([model.languages.index(x) for x in langs])[w.doc]
    h = w.hashes()
    kinds, at, kind = np.unique(h, return_index=True, return_inverse=True)
    f = features(w, at, h)
    first, length = chains_of(w.count)
    places = np.minimum(first[:, None] + np.arange(CHAIN), len(kind) - 1)
    inside = np.arange(CHAIN) < length[:, None]
    # Every third full chain goes on in another one's second half, mostly of another language.
    full = np.flatnonzero(length == CHAIN)
    full = full[np.argsort(mix(full.astype(np.uint64)))]
    n = len(full) // 3
    places[full[:n], CHAIN // 2 :] = places[full[n : 2 * n], CHAIN // 2 :].copy()
    y = label[places]
    seen_moves = np.zeros((k, k))
    both = inside[:, 1:]
    np.add.at(seen_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
    seen_start = np.bincount(y[:, 0], minlength=k)
    words = inside.sum()
    sums = [np.full_like(model.weight, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)]
    for _ in range(rounds):
        e = emissions(f, len(kinds), model.weight)
        p, moves = forward_backward(np.where(inside[:, :, None], e[kind[places]], 0), length, model.start, model.move)
        miss = -p[inside]
        miss[np.arange(words), y[inside]] += 1
        of = kind[places[inside]]
        g = np.stack([np.bincount(of, weights=miss[:, j], minlength=len(kinds)) for j in range(k)], axis=1)
        number, owner, value = f
        gw = np.stack([np.bincount(number, weights=value * g[owner, j], minlength=FEATURES) for j in range(k)], axis=1) / words - L2 * model.weight
        steps = (gw, (seen_moves - moves) / words, (seen_start - p[:, 0].sum(axis=0)) / words)
        for s, step, x in zip(sums, steps, (model.weight, model.move, model.start), strict=True):
            s += step**2
            x += (RATE * step / np.sqrt(s)).astype(x.dtype)
    return model


def train(docs: DataFrame, fold: Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", language_bytes: int = LANGUAGE_BYTES) -> Model:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold.alias("fits"))
    size = F.octet_length("text")
    rows = rows.where(F.col("fits") & F.col("lang").isNotNull() & F.col("id").isNotNull() & (size > 0))
    chosen, _ = labelled.least_hashed(stored(rows.select("id", "lang", size.cast("long").alias("size")), "sizes"), "lang", per_language)
    chosen = stored(labelled.within_bytes(chosen, "lang", language_bytes).select("id", "lang").distinct(), "chosen")
    found = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("id", "text", "lang").orderBy("id", "lang").toArrow()  # per_language ids of each language
    return fit(found.column("text").to_pylist(), found.column("lang").to_pylist())


def identified(docs: DataFrame, model: Model, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row; with spans also the runs of words of one language (start and length in words)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())]))

    def work(batch, texts):
        lang, score, w, label = model.predict(texts)
        columns, names = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
        if spans:
            out: list[list] = [[] for _ in texts]
            new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])])[: len(label)])
            ends = [*new[1:], len(label)] if len(new) else []
            first = np.cumsum(w.count) - w.count
            for a, b in zip(new, ends, strict=True):
                out[w.doc[a]].append({"start": int(a - first[w.doc[a]]), "length": int(b - a), "lang": model.languages[label[a]]})
            columns.append(pa.array(out, span))
            names.append("spans")
        return pa.RecordBatch.from_arrays(columns, names=names)

    more = ", spans array<struct<start:int,length:int,lang:string>>" if spans else ""
    return docs.mapInArrow(by_chunk(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double{more}")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs, train(docs, fold_of("doc_id", 3) != 1))
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
