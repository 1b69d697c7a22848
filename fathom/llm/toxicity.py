"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target (a person addressed or spoken of), negation, report (a verb
of saying) or other. Six transducers read a clause. The phrase transducer makes insults and threats of phrases whose words say
nothing alone ("hope you die", "waste of space"), with one other word between at most. The second one reads from the clause's end and marks insults and
threats that a target follows ("idiots like you"); the others read on from its start: negation marks what stands
in its scope, report marks what is told of others, target marks what follows it, and the pattern transducer
names the matched pattern. These four are composed into one transducer. The machines run over each clause that
holds an insult, a threat, or two words of phrases with the longest of one among them; others match nothing. Arcs have weights: a mark counts for less the farther its
trigger stands (NEARNESS). A match adds the weight of its word times that of its arcs to its pattern; a
document's score is a logistic function of its patterns' sums. So a negated or reported insult counts for less
than one that is aimed at somebody, as far as the labels say so: the patterns' weights are fitted, from the
priors in PATTERNS on.

Insults are a fixed list, and stems and words mined from labelled texts, a bounded sample of up to
`per_class` whole texts of each class, in the order of a hash, until they sum up to `class_bytes`: those that come in toxic texts much more often than in others, and in too many to be there by
chance given the toxic share of the texts drawn and the words tried. Texts of the same words in the same
order count once; near copies count each. The commonest MOST_STEMS of them are kept. The closed classes are fixed lists.

Null and empty texts match nothing. Repeated rows are scored alike. Without toxic labels only the fixed
lists match. An empty table gives no rows. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import matmul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .common import PLAIN_TABLE, Words, by_chunk, fold_of, mix, span_hashes, splitter, table

PER_CLASS, CLASS_BYTES = 3_000, 32_000_000
#: A mined stem must come in two toxic texts at least, this many times as often in toxic texts as in others, and of all that are as frequent no more than so many
#: may be expected to do so by chance.
LEAST_RATIO, MOST_CHANCE = 20.0, 0.5
STEMS = (4, 5, 6, 7, 8)
MOST_STEMS = 4_000

# Closed word classes in the four languages.
THREATS = (
    "kill killed killing hurt hurting destroy destroyed burn burned hang hanged shoot shot stab stabbed beat beaten punish punished murder murdered strangle choke slaughter exterminate "
    "töten getötet umbringen schlagen vernichten sterben erschießen aufhängen verbrennen abstechen erwürgen verprügeln "
    "tuer tué frapper détruire mourir pendre brûler égorger massacrer étrangler matar matado golpear destruir morir ahorcar quemar apuñalar degollar"
).split()
INSULTS = (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles stupid dumb dumbass fool fools loser losers scum filth filthy vermin trash garbage worthless useless pathetic disgusting despicable "
    "ugly retard retarded bastard bastards bitch bitches whore slut asshole assholes clown clowns jerk jerks creep freak freaks pig pigs parasite parasites coward cowards shit fuck fucking "
    "idioten idiotisch dumm dumme dummkopf blöd blöde blödmann trottel depp vollidiot arschloch arschlöcher schwein schweine abschaum dreckig dreckskerl widerlich wertlos erbärmlich hässlich hure schlampe missgeburt versager scheiße "
    "idiote idiots imbécile imbéciles crétin crétins débile débiles abruti abrutis stupide connard connards connasse salaud salauds salope ordure ordures minable pathétique dégoûtant dégoûtante répugnant merde pute vermine raclure "
    "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos tonto tonta gilipollas cabrón cabrones puta puto mierda basura escoria asqueroso asquerosa patético patética inútil inútiles cobarde cretino despreciable"
).split()
TARGETS = "you your yours yourself he him his she her they them their people du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils elles usted tú ti tus ellos ellas".split()
NEGATIONS = "not never no nobody without cannot isn aren wasn don doesn didn won nicht nie kein keine keinen niemals ne pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = (
    "said says say saying wrote writes written claimed claims alleged quoted quotes called calls reported reports stated told testified recounted sagte sagt schrieb schreibt behauptete behauptet nannte zitierte berichtete "
    "dit disait écrit affirme affirmait cité raconte appelait dijo dice decía escribió afirma afirmó citó contó llamó"
).split()
PHRASE_THREATS = (
    "hope you die|hope you suffer|hope you rot|deserve to die|deserves to die|should be dead|find where you live|know where you live|come for you|coming for you|come after you|watch your back|make you pay|make you suffer|end your life|put you down|wipe you out|blow you up|sleep with one eye open|you are dead|your days are numbered|"
    "verdienst den tod|weiß wo du wohnst|wissen wo du wohnst|mach dich fertig|mache dich fertig|hoffe du stirbst|du bist tot|pass auf dich auf wenn|wirst es bereuen|"
    "mérite de crever|mérites de crever|sais où tu habites|savons où tu habites|vais te faire payer|espère que tu crèves|tu es mort|vas le regretter|"
    "mereces morir|sé dónde vives|sabemos dónde vives|vas a pagar|ojalá te mueras|estás muerto|te vas a arrepentir"
).split("|")
PHRASE_INSULTS = (
    "waste of space|waste of air|piece of work you|sack of lies|shut your mouth|go to hell|nobody likes you|no one likes you|good for nothing|not worth the air|sub human|brain dead|lower than dirt|crawl back under|"
    "halt die klappe|halt dein maul|geh zur hölle|nichts im kopf|zu nichts zu gebrauchen|"
    "ferme ta gueule|va en enfer|bon à rien|bonne à rien|rien dans la tête|"
    "cierra la boca|vete al infierno|bueno para nada|no vales nada|hijo de mala"
).split("|")
_CLAUSE_END = splitter(b".;:!?\n\r")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: The weight of a mark by the number of words from its trigger on; beyond, there is no mark.
NEARNESS = {"denied": (1.0, 1.0, 1.0), "at": (1.0, 1.0, 0.9, 0.8)}
#: Pattern: prior weight.
PATTERNS = {"insult": 1.0, "threat": 0.2, "insult_at": 1.6, "threat_at": 1.2, "denied": 0.4, "reported": 0.5}
_NAMES = list(PATTERNS)


class Transducer:
    """A finite-state transducer with weights: (state, symbol) -> (state, symbol, factor). Missing arcs copy the symbol."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def __matmul__(self, after: Transducer) -> Transducer:
        """The transducer that feeds this one's output to the next, over the states that can be reached."""
        symbols = sorted({s for _, s in self.arcs} | {out for _, out, _ in self.arcs.values()} | {s for _, s in after.arcs})
        start, arcs, todo, seen = (self.start, after.start), {}, [(self.start, after.start)], {(self.start, after.start)}
        while todo:
            a, b = todo.pop()
            for symbol in symbols:
                a2, middle, w1 = self.step(a, symbol)
                b2, out, w2 = after.step(b, middle)
                arcs[(a, b), symbol] = ((a2, b2), out, w1 * w2)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, arcs)


#: What a phrase with another word between its own weighs.
LOOSE = 0.8
_PHRASES = {tuple(p.split()): kind for kind, phrases in ((THREAT, PHRASE_THREATS), (INSULT, PHRASE_INSULTS)) for p in phrases}
#: Words of phrases, numbered from 1; 0 is any other word.
PHRASE_WORDS = sorted({w for p in _PHRASES for w in p})
_NUMBER = {w: i + 1 for i, w in enumerate(PHRASE_WORDS)}
#: The longest word of each phrase: a clause without any of them holds no phrase.
_KEYS = {max(p, key=len) for p in _PHRASES}


def phrase_machine() -> Transducer:
    """Reads (class, number of the phrase word) and writes classes; the last word of a phrase becomes an insult or a threat.

    A state is the longest beginning of a phrase that has been read, and whether another word has been passed over in it.
    """
    whole = {tuple(_NUMBER[w] for w in p): kind for p, kind in _PHRASES.items()}
    begun = {p[:k] for p in whole for k in range(len(p) + 1)}
    arcs: dict = {}
    for prefix in begun:
        for passed in (False, True) if prefix else (False,):
            for word in range(len(PHRASE_WORDS) + 1):
                if not word:
                    then, kind = ((prefix, True) if prefix and not passed else ((), False)), None
                else:
                    read = (*prefix, word)
                    longest = next(read[i:] for i in range(len(read) + 1) if read[i:] in begun)
                    on = len(longest) == len(read)
                    kind = next((whole[longest[i:]] for i in range(len(longest)) if longest[i:] in whole and (on or not passed or i >= len(longest) - 1)), None)
                    then = (longest, passed and on)
                for c in range(6):
                    arcs[(prefix, passed), (c, word)] = (then, (c if kind is None or c in (INSULT, THREAT) else kind,), LOOSE if passed and kind is not None else 1.0)
    return Transducer(((), False), arcs)


# Symbols are tuples: the word's class, then the marks that transducers put on it.
_BASE = [(c,) for c in range(6)]


def _marks(s: tuple, mark: str) -> bool:
    return s[0] in (INSULT, THREAT) and mark not in s


def _scope(trigger: int, mark: str, symbols: list[tuple], near: tuple[float, ...] = ()) -> Transducer:
    """Marks insults and threats after a trigger, each by the weight of its distance; without weights until the clause ends."""
    arcs: dict = {}
    last = len(near) or 1  # the state is the distance of the next word; 0: no trigger yet, or out of its reach
    for state in range(last + 1):
        for s in symbols:
            if s[0] == trigger:
                arcs[state, s] = (1, s, 1.0)
            elif state:
                then = (state + 1) % (last + 1) if near else 1
                arcs[state, s] = (then, (*s, mark), near[state - 1] if near else 1.0) if _marks(s, mark) else (then, s, 1.0)
    return Transducer(0, arcs)


def _marked(symbols: list[tuple], mark: str) -> list[tuple]:
    return symbols + [(*s, mark) for s in symbols if _marks(s, mark)]


def _names(symbols: list[tuple]) -> Transducer:
    """Names the pattern of each marked insult or threat."""
    arcs: dict = {}
    for s in symbols:
        if s[0] in (INSULT, THREAT):
            kind = "insult" if s[0] == INSULT else "threat"
            name = "denied" if "denied" in s else "reported" if "reported" in s else f"{kind}_at" if "at" in s else kind
            arcs[0, s] = (0, (name,), 1.0)
    return Transducer(0, arcs)


def steps() -> tuple[Transducer, list[Transducer]]:
    """The transducer that reads from the end, and those that read on from the start, in their order."""
    back, symbols, out = _scope(TARGET, "at", _BASE, NEARNESS["at"]), _marked(_BASE, "at"), []
    for trigger, mark in ((NEGATION, "denied"), (REPORT, "reported"), (TARGET, "at")):
        out.append(_scope(trigger, mark, symbols, NEARNESS.get(mark, ())))
        symbols = _marked(symbols, mark)
    return back, [*out, _names(symbols)]


def grammar() -> tuple[Transducer, Transducer]:
    back, ahead = steps()
    return back, reduce(matmul, ahead)


GRAMMAR = grammar()
PHRASES = phrase_machine()


def run(machine: Transducer, symbols: list) -> tuple[list, list[float]]:
    """What the machine writes for the symbols, and the weights of its arcs."""
    state, out, weights = machine.start, [], []
    for s in symbols:
        state, said, factor = machine.step(state, s)
        out.append(said), weights.append(factor)
    return out, weights


def match(symbols: list[int], weights: list[float], machines: tuple[Transducer, Transducer] = GRAMMAR, words: list[int] | None = None) -> dict[str, float]:
    """The patterns of one clause, with the weights of their words. words: the numbers of phrase words; none are looked for without."""
    back, ahead = machines
    if words is not None:
        said, arcs = run(PHRASES, list(zip(symbols, words, strict=True)))
        weights = [w if kind == c else a for (kind,), c, w, a in zip(said, symbols, weights, arcs, strict=True)]
        symbols = [kind for (kind,) in said]
    said, first = run(back, [(s,) for s in reversed(symbols)])
    said, then = run(ahead, said[::-1])
    out: dict[str, float] = {}
    for name, weight, a, b in zip(said, weights, reversed(first), then, strict=True):
        if name[0] in PATTERNS:
            out[name[0]] = out.get(name[0], 0.0) + weight * a * b
    return out


def _word_hash(words: list[str]) -> np.ndarray:
    w = Words([" ".join(words)], PLAIN_TABLE)
    return w.hashes()


class Lexicon:
    """Sorted hashes of closed-class words and of words and stems of insults, with their weights."""

    def __init__(self, mined: dict[tuple[int, int], float]):
        closed: dict[int, int] = {}
        for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            closed |= dict.fromkeys(_word_hash(words).tolist(), kind)
        self.closed = np.array(sorted(closed), dtype=np.uint64)
        self.kind = np.array([closed[h] for h in self.closed.tolist()], dtype=np.int8)
        phrase = {h: _NUMBER[w] for w in PHRASE_WORDS for h in _word_hash([w]).tolist()}
        self.phrase = np.array(sorted(phrase), dtype=np.uint64)
        self.number = np.array([phrase[h] for h in self.phrase.tolist()])
        self.keys = np.array(sorted(h for w in _KEYS for h in _word_hash([w]).tolist()), dtype=np.uint64)
        mined = {(0, h): 1.0 for h in _word_hash(INSULTS).tolist()} | mined  # a mined weight replaces the fixed one
        self.stems = {}
        for size in sorted({s for s, _ in mined}):
            keys = sorted(h for s, h in mined if s == size)
            self.stems[size] = np.array(keys, dtype=np.uint64), np.array([mined[size, h] for h in keys])

    def symbols(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's symbol and weight, its number as a word of phrases, and whether it is the longest of one."""
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.closed, h), len(self.closed) - 1)
        out = np.where(self.closed[at] == h, self.kind[at], OTHER).astype(np.int8)
        weight = (out == THREAT).astype(np.float64)
        length = w.ends - w.starts
        for size, (keys, worth) in self.stems.items():  # size 0: whole words
            long = np.arange(len(h)) if not size else np.flatnonzero(length >= size)
            g = h[long] if not size else span_hashes(w.data, w.starts[long], w.starts[long] + size)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = keys[at] == g
            out[long[hit]] = INSULT
            weight[long[hit]] = np.maximum(weight[long[hit]], worth[at[hit]])
        at = np.minimum(np.searchsorted(self.phrase, h), len(self.phrase) - 1)
        word = np.where(self.phrase[at] == h, self.number[at], 0)
        key = np.zeros(len(h), dtype=bool)
        some = np.flatnonzero(word)
        key[some] = np.isin(h[some], self.keys)
        return out, weight, word, key


def _texts(texts: list) -> Words:
    return Words([t.lower() if t else t for t in texts], PLAIN_TABLE)


def patterns(texts: list, lexicon: Lexicon) -> np.ndarray:
    """(texts, patterns) sums over all clauses of each text."""
    w = _texts(texts)
    out = np.zeros((len(texts), len(PATTERNS)))
    if not len(w.starts):
        return out
    symbol, weight, word, key = lexicon.symbols(w)
    clause = np.cumsum(_CLAUSE_END[w.data])[w.starts]
    new = np.concatenate([[True], (clause[1:] != clause[:-1]) | (w.doc[1:] != w.doc[:-1])])
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    last = np.concatenate([first[1:], [len(symbol)]])
    phrased = (np.add.reduceat((word > 0).astype(np.int64), first) > 1) & (np.add.reduceat(key.astype(np.int64), first) > 0)
    marked = np.add.reduceat(((symbol == INSULT) | (symbol == THREAT)).astype(np.int64), first) > 0
    for c in np.flatnonzero(marked | phrased).tolist():
        a, b = first[c], last[c]
        for name, x in match(symbol[a:b].tolist(), weight[a:b].tolist(), words=word[a:b].tolist() if phrased[c] else None).items():
            out[w.doc[a], _NAMES.index(name)] += x
    return out


def mine(texts: list, y: np.ndarray) -> dict[tuple[int, int], float]:
    """Words (size 0) and stems of bytes that mark toxic texts: (size, hash) -> weight."""
    found: dict[int, list] = {}
    texts_seen: list[np.ndarray] = []
    for i in range(0, len(texts), 200):
        w = _texts(texts[i : i + 200])
        h, length = w.hashes(), w.ends - w.starts
        whole = np.zeros(len(texts[i : i + 200]), dtype=np.uint64)  # a digest of each text's words in order
        np.add.at(whole, w.doc, mix(h + mix((np.arange(len(h)) - np.searchsorted(w.doc, w.doc)).astype(np.uint64))))
        texts_seen.append(np.stack([whole, y[i : i + 200].astype(np.uint64)], axis=1))
        for size in (0, *STEMS):
            long = np.flatnonzero(length >= max(size, 3))
            g = h[long] if not size else span_hashes(w.data, w.starts[long], w.starts[long] + size)
            bad = y[i : i + 200][w.doc[long]].astype(np.uint64)
            once = np.unique(mix(mix(g) + whole[w.doc[long]]) + bad, return_index=True)
            found.setdefault(size, []).append((once[0], g[once[1]], bad[once[1]]))
    many = np.bincount(np.unique(np.concatenate(texts_seen), axis=0)[:, 1].astype(int), minlength=2)
    picked: dict[tuple[int, int], tuple[float, int]] = {}
    for size, parts in found.items():
        once, g, marked = (np.concatenate(x) for x in zip(*parts, strict=True))
        once = np.unique(once, return_index=True)[1]  # a word counts once for all copies of a text
        keys, at = np.unique(g[once], return_inverse=True)
        bad = np.bincount(at, weights=marked[once] == 1, minlength=len(keys))
        good = np.bincount(at, weights=marked[once] == 0, minlength=len(keys))
        ratio = (bad / max(many[1], 1)) / ((good + 0.5) / max(many[0], 1))
        n, share = bad + good, many[1] / max(many.sum(), 1)
        with np.errstate(divide="ignore", invalid="ignore"):  # Chernoff's bound on the binomial tail; 0 log 0 is 0
            bits = np.nan_to_num(bad * np.log(bad / n / share), nan=0.0) + np.nan_to_num(good * np.log(good / n / (1 - share)), nan=0.0)
        tried = len(n) - np.searchsorted(np.sort(n), n)
        for k in np.flatnonzero((bad > 1) & (tried * np.exp(-bits) <= MOST_CHANCE) & (ratio >= LEAST_RATIO)).tolist():
            picked[size, int(keys[k])] = float(min(np.log(ratio[k]), 6.0)) / 3, int(bad[k])
    best = sorted(picked, key=lambda k: (-picked[k][1], k))[:MOST_STEMS]
    return {k: picked[k][0] for k in best}


class Model:
    def __init__(self, lexicon: Lexicon, weight: np.ndarray, bias: float):
        self.lexicon, self.weight, self.bias = lexicon, weight, bias

    def scores(self, texts: list) -> np.ndarray:
        z = np.log1p(patterns(texts, self.lexicon)) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list, y: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.3, pull: float = 0.01) -> Model:
    """Mines the lexicon, then fits the patterns' weights by logistic regression that pulls towards the priors."""
    lexicon = Lexicon(mine(texts, y) if len(texts) else {})
    prior = np.array(list(PATTERNS.values())) * 4
    if len(np.unique(y)) < 2:
        return Model(lexicon, prior, -4.0)
    x = np.log1p(np.concatenate([patterns(texts[i : i + 200], lexicon) for i in range(0, len(texts), 200)]))
    b, bias, share = prior.copy(), -4.0, weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b + bias, -30, 30)))
        g = share * (p - y)
        b = np.maximum(b - rate * 10 * (x.T @ g + pull * 0.1 * (b - prior)), 0)
        bias -= rate * 10 * g.sum()
    return Model(lexicon, b, float(bias))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "toxic", class_bytes: int = CLASS_BYTES) -> Model:
    """Fits on a bounded sample of labelled documents outside the held-out fold."""
    rows, counts = labelled.sample(docs, labels, label, fold_of("doc_id", 5) != 0, per_class, max_bytes=class_bytes)
    found = rows.where("text IS NOT NULL").orderBy("id").toArrow()  # per_class rows of each class at most
    y = found.column("y").to_numpy().astype(np.float64)
    drawn = {k: max(1, int((y == k).sum())) for k in counts}
    return fit(found.column("text").to_pylist(), y, np.array([counts[int(k)] / drawn[int(k)] for k in y]))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batch, texts):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(texts))], names=["doc_id", "score"])

    return docs.mapInArrow(by_chunk(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
