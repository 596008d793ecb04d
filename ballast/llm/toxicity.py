"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult I, harm H, intent W, target Y, negation N, reporting R, other
words O, and # at the end of a clause. Transducers rewrite the symbols one after the other,
and their composition is the grammar:

    threat     harm within three symbols of intent or a target is a threat T; other harm is nothing
    negation   an insult or threat within three symbols of a negation is denied: arc n
    reporting  one that follows a reporting word in its clause is reported speech: arc q
    target     one within four symbols after a target, or before one, is aimed: arc a. What is
               ahead has to be guessed: a path that guesses wrong ends nowhere
    chain      one within six symbols after another of its clause: arc c
    repetition one after another of the same document, denied and reported ones aside: arc r;
               from the fourth on a match takes arc m alone

Arcs have weights, a path weighs what its arcs do, and a clause scores its best path: the
matched pattern is scored, not the word. A document's score is the logistic of the intercept
and its clauses' scores. The intercept is below what a lone insult's arc weighs, so that an
insult that is neither aimed, chained nor repeated never decides a document.

The insult lexicon is a fixed seed and what labelled rows teach: word beginnings that stand
in toxic documents far more often than chance, counted in a distributed pass over at most
``max_fit_rows`` labelled rows. Arc weights are a logistic regression on the same rows, of
fixed signs, drawn towards stated priors, so an arc that the labels do not show keeps its prior.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm._words import Words, slices, words

#: Seed lexicons (fixed values).
INSULTS = "idiot moron loser scum trash clown stupid pathetic worthless disgusting imbecile fool dumb ugly vermin filth bastard dummkopf blödmann trottel abschaum widerlich erbärmlich imbécile crétin minable ordure débile nul imbécil estúpido estúpida basura asqueroso asquerosa inútil patético".split()
HARM = "kill hurt destroy beat burn smash shoot stab strangle murder crush töten vernichten verprügeln tuer détruire frapper matar destruir golpear".split()
INTENT = "will gonna shall must should going werde wird vais va vamos voy".split()
TARGETS = "you your yours yourself u he she they them him her these those people everyone du dich dir ihr euch sie tu te toi vous ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't nobody neither nor hardly nicht kein keine nie pas jamais aucun nunca jamás".split()
REPORTING = "said says saying wrote writes called calls quoted quote reported claims claimed allegedly according sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

_CLASSES = {w: s for s, ws in (("O", ()), ("R", REPORTING), ("N", NEGATIONS), ("Y", TARGETS), ("W", INTENT), ("H", HARM), ("I", INSULTS)) for w in ws}
_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0x21), *(ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")]] = True  # an apostrophe is part of a word
_CLAUSE = np.zeros(256, np.int64)
_CLAUSE[[ord(c) for c in ".!?;:\n"]] = 1
#: Arcs that weigh something: prior weight, and the least and the greatest that fitting may give it.
ARCS = {"I": (0.6, 0.0, 1.0), "T": (2.0, 0.0, 8.0), "n": (-2.5, -8.0, 0.0), "q": (-2.0, -8.0, 0.0), "a": (1.6, 0.0, 8.0), "c": (1.6, 0.0, 8.0), "r": (2.4, 0.0, 8.0), "m": (0.3, 0.0, 2.0)}
#: The same of the intercept: a lone insult stays at least half below zero.
INTERCEPT = (-3.0, -6.0, -1.5)
PRIOR, LEAST, MOST = (np.array([a[i] for a in ARCS.values()] + [INTERCEPT[i]]) for i in range(3))
_NAME = {k: i for i, k in enumerate(ARCS)}


class Transducer:
    """``arcs(state, symbol)``: its (next state, output, names of weighted arcs); ``final(state)``: whether a clause may end there."""

    def __init__(self, start, arcs, final=lambda state: True):
        self.start, self.arcs, self.final = start, lru_cache(1 << 16)(arcs), final

    def compose(self, after: Transducer) -> Transducer:
        """What this one puts out is what the next one reads."""

        def arcs(state, symbol):
            return tuple(((p, q), out, x + y) for p, mid, x in self.arcs(state[0], symbol) for q, out, y in after.arcs(state[1], mid))

        return Transducer((self.start, after.start), arcs, lambda state: self.final(state[0]) and after.final(state[1]))


def _match(symbol: str) -> bool:
    return symbol[0] in "IT"


def within(marks: str, name: str, reach: int) -> Transducer:
    """Arc ``name`` for a match at most ``reach`` symbols after one of ``marks`` in its clause."""

    def arcs(left, s):
        if s == "#":
            return ((0, s, ""),)
        if s[0] in marks:
            return ((reach, s, ""),)
        hit = left and _match(s)
        return ((max(left - 1, 0), s + name if hit else s, name if hit else ""),)

    return Transducer(0, arcs)


def threat(reach: int = 3) -> Transducer:
    def arcs(left, s):
        if s == "#":
            return ((0, s, ""),)
        if s in ("W", "Y"):
            return ((reach, s, ""),)
        return ((max(left - 1, 0), ("T" if left else "O") if s == "H" else s, ""),)

    return Transducer(0, arcs)


def target(reach: int = 4) -> Transducer:
    """State: symbols for which a target counts as near before, and, if one ahead was guessed, those left to find it."""

    def arcs(state, s):
        left, owed = state
        if s == "#":
            return () if owed else (((0, 0), s, ""),)
        if s == "Y":
            return (((reach, 0), s, ""),)
        after = (max(left - 1, 0), owed - 1 if owed else 0)
        if owed == 1:
            return ()  # the guess fails, whatever this symbol is: no target came
        if not _match(s):
            return ((after, s, ""),)
        if left:
            return ((after, s + "a", "a"),)
        return ((after, s, ""), ((after[0], after[1] or reach), s + "a", "a"))

    return Transducer((0, 0), arcs, lambda state: not state[1])


def chain(reach: int = 6) -> Transducer:
    def arcs(left, s):
        if s == "#":
            return ((0, s, ""),)
        if not _match(s):
            return ((max(left - 1, 0), s, ""),)
        return ((reach, s + "c" if left else s, "c" if left else ""),)

    return Transducer(0, arcs)


def repetition(most: int = 3) -> Transducer:
    """Reads on over the clauses of a document; state: matches so far, neither denied nor reported."""

    def arcs(seen, s):
        if not _match(s):
            return ((seen, s, ""),)
        if seen == most:
            return ((seen, s + "m", "m"),)
        counts = "n" not in s and "q" not in s
        return ((seen + counts, s + "r" if seen else s, s[0] + ("r" if seen and counts else "")),)

    return Transducer(0, arcs)


GRAMMAR = threat().compose(within("N", "n", 3)).compose(within("R", "q", 40)).compose(target()).compose(chain()).compose(repetition())
_REACH = 42  # after so many other words every counter but the repetitions' is at rest


def counted(names: str) -> np.ndarray:
    """Arcs by name; from the fourth match on (m) the others of that match weigh nothing."""
    x = np.zeros(len(ARCS))
    for k in "m" if "m" in names else names:
        x[_NAME[k]] += 1
    return x


_COUNTED = lru_cache(4096)(counted)


def best_path(symbols: list[str], start, weights: np.ndarray) -> tuple[float, np.ndarray, tuple]:
    """Weight, arcs and end state of the heaviest path of one clause (its # is added here)."""
    at, run = {start: (0.0, np.zeros(len(ARCS)))}, 0
    for s in [*symbols, "#"]:
        run = run + 1 if s == "O" else 0
        if run > _REACH:
            continue
        nxt: dict = {}
        for state, (w, x) in at.items():
            for to, _, names in GRAMMAR.arcs(state, s):
                y = _COUNTED(names) if names else None
                v = w + float(y @ weights) if names else w
                if to not in nxt or v > nxt[to][0]:
                    nxt[to] = (v, x + y if names else x)
        at = nxt
    w, x, end = max(((w, x, state) for state, (w, x) in at.items() if GRAMMAR.final(state)), key=lambda t: t[0])
    return w, x, end


class Lexicon:
    """Beginnings of words (and whole words, with an end mark) that count as insults, or as harm."""

    def __init__(self, learned: list[str]):
        self.stems = sorted(set(learned))
        table: dict[tuple[int, bool], list] = {}
        for text, kind in [(f"{w}$", "I") for w in INSULTS] + [(f"{w}$", "H") for w in HARM] + [(w, "I") for w in self.stems]:
            whole = text.endswith("$")
            bare = text[:-1] if whole else text
            table.setdefault((len(bare.encode()), whole), []).append((bare, kind))
        self.table = []
        for (n, whole), found in sorted(table.items()):
            h, _ = words(pa.array([w for w, _ in found])).heads(n)
            order = np.argsort(h)
            self.table.append((n, whole, h[order], np.array([found[i][1] == "I" for i in order])))

    def hits(self, w: Words) -> np.ndarray:
        """0, 1 (harm) or 2 (insult) of each word."""
        out = np.zeros(len(w.start), np.int8)
        for n, whole, keys, insult in self.table:
            h, at = w.heads(n)
            if whole:
                keep = (w.end - w.start)[at] == n
                h, at = h[keep], at[keep]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ok = keys[k] == h
            out[at[ok]] = np.maximum(out[at[ok]], 1 + insult[k[ok]])
        return out


def features(column: pa.Array, lexicon: Lexicon, weights: np.ndarray = PRIOR[:-1]) -> np.ndarray:
    """Arcs of the best paths of each row's clauses, by name."""
    w = words(column, lower=True, breaks=_BREAKS)
    out = np.zeros((len(w.first) - 1, len(ARCS)))
    hit = lexicon.hits(w)
    if not hit.any():
        return out
    clause = np.cumsum(_CLAUSE[w.data])[w.start]
    some, doc = np.flatnonzero(hit), w.doc
    number = (doc[some] << 40) + clause[some]
    d, state = -1, GRAMMAR.start
    for first in some[np.unique(number, return_index=True)[1]]:
        if doc[first] != d:
            d, state = doc[first], GRAMMAR.start
        lo = int(np.searchsorted(clause[w.first[d] : w.first[d + 1]], clause[first])) + int(w.first[d])
        hi = int(np.searchsorted(clause[w.first[d] : w.first[d + 1]], clause[first], side="right")) + int(w.first[d])
        # clauses without a hit leave the machine as it was
        symbols = ["OHI"[hit[i]] if hit[i] else _CLASSES.get(w.word(i).decode("utf-8", "replace"), "O") for i in range(lo, hi)]
        _, x, state = best_path(["O" if s in "IH" and not hit[lo + i] else s for i, s in enumerate(symbols)], state, weights)
        out[d] += x
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 0.5, steps: int = 100) -> np.ndarray:
    """Logistic regression with a quadratic pull towards PRIOR, within the arcs' bounds: Newton steps over the weights that are free.

    The bounds fix the signs, so the best paths are the same under the prior and the fitted weights.
    """
    w, x = PRIOR.copy(), np.column_stack((x, np.ones(len(x))))
    loss = lambda w: float(np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + pull / 2 * ((w - PRIOR) ** 2).sum())
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        up = x.T @ (y - p) - pull * (w - PRIOR)
        free = ~((w <= LEAST) & (up < 0) | (w >= MOST) & (up > 0))
        curve = (x.T * (p * (1 - p))) @ x + pull * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], up[free])
        before, size = loss(w), 1.0
        while loss(new := np.clip(w + size * step, LEAST, MOST)) > before and size > 1e-6:
            size /= 2
        if abs(new - w).max() < 1e-9:
            break
        w = new
    return w


class Model:
    def __init__(self, learned: list[str], weights: np.ndarray):
        self.lexicon, self.weights = Lexicon(learned), weights

    def score(self, column: pa.Array) -> np.ndarray:
        x = features(column, self.lexicon, self.weights[:-1]) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def __reduce__(self):
        return Model, (self.lexicon.stems, self.weights)


def _beginnings(rows: DataFrame, lengths=range(3, 9)) -> DataFrame:
    """(stem, pos, neg): documents with and without the label in which a word begins so; a whole word ends in "$"."""

    def run(batches):
        for b in slices(batches, 0, 2 << 20):
            pos, neg = Counter(), Counter()
            w = words(b.column(0), lower=True, breaks=_BREAKS)
            for d, toxic in enumerate(b.column(1).to_pylist()):
                own = {w.word(i) for i in range(w.first[d], w.first[d + 1])}
                own = {x.decode("utf-8", "replace") for x in own}
                (pos if toxic else neg).update({x[:n] for x in own for n in lengths if len(x) >= n} | {f"{x}$" for x in own if len(x) >= 2})
            stems = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([pos[s] for s in stems], pa.int64()), pa.array([neg[s] for s in stems], pa.int64())], names=["stem", "pos", "neg"])

    return rows.mapInArrow(run, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column, max_fit_rows: int = 20_000, max_stems: int = 500, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model from the labelled rows of ``docs`` for which ``train`` (of doc_id) holds.

    At most about ``max_fit_rows`` rows are used, chosen by a hash of doc_id; equal texts
    count once. Rows with a null label or text teach nothing. Without labelled rows the
    model is the seed lexicon with its prior weights.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(train)
    n = given.count()
    if n > max_fit_rows:
        given = given.where(F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(1_000_000)) < int(1_000_000 * max_fit_rows / n))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(given, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    stems: list[str] = []
    if toxic and toxic < total:
        rate = toxic / total
        # log-likelihood of the counts under a rate of 0.97 against the base rate, less what chance gives among a million stems
        gain = F.col("pos") * math.log(max(0.97 / rate, 1.01)) + F.col("neg") * math.log(0.03 / (1 - rate) if rate < 0.97 else 0.99)
        found = _beginnings(rows).select("stem", gain.alias("gain")).where(f"gain > {math.log(1e6) + 4}").orderBy(F.desc("gain"), F.desc(F.length("stem")), "stem").limit(20 * max_stems).collect()
        for r in found:
            # of nested beginnings the one that tells most, and of equals the longest
            if len(stems) < max_stems and not any(r.stem.startswith(s.rstrip("$")) or s.startswith(r.stem.rstrip("$")) for s in stems):
                stems.append(r.stem)
    lexicon = Lexicon(stems)

    def run(batches):
        for b in slices(batches, 0):
            x = features(b.column(0), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    # at most max_fit_rows short vectors, equal ones counted before they leave the executors
    seen = rows.mapInArrow(run, "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n")).collect()
    rows.unpersist()
    x = np.array([r.x for r in seen for _ in range(r.n)]).reshape(-1, len(ARCS))
    return Model(stems, fit_weights(x, np.array([r.toxic for r in seen for _ in range(r.n)], float)))


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score): a row of ``docs`` each, repeated rows and null doc_ids included; null and empty texts have no match and score as such.

    A text of any length is one row's work, clause by clause. Other columns are not read; an empty table gives no rows.
    """
    blob, made = pickle.dumps(model), {}  # at most max_stems word beginnings and a few weights

    def run(batches):
        if "model" not in made:
            made["model"] = pickle.loads(blob)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made["model"].score(b.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, in one scan; rows, repeated ones too, and columns otherwise as they are."""
    blob, made = pickle.dumps(model), {}  # at most max_stems word beginnings and a few weights
    at = docs.columns.index(text_col)

    def run(batches):
        if "model" not in made:
            made["model"] = pickle.loads(blob)
        for b in slices(batches, at):
            yield b.filter(pa.array(made["model"].score(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
