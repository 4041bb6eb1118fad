"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, plain) through
a lexicon; small transducers for insult, threat, target, negation and reported
speech are composed into one deterministic machine that reads the symbols of a
clause up to its end and tells there which patterns the clause has.  A threat is
a threat verb with a target behind it, or at the clause's end with a target
before it; a subject before a verb that takes another object is no target, nor
is that of a reporting verb.  An insult is said of a target before or behind it
or is the clause's noun alone ("An idiot.").  A clause counts once, in one
context, with the weight of its insults and of the threat; a document is scored
by a logistic model over its clauses.

The insult lexicon is learned: word stems (prefixes and whole words) whose
document frequency in toxic training rows is high against other training rows,
counted over a bounded sample (``LEXICON_ROWS`` of each class, lowest id hash
first).  A stem must be in a number of toxic rows that grows with the root of
theirs; the model keeps the ``LEXICON_SIZE`` stems of most weight times rows, so
that it has a fixed size.  The logistic weights use at most
``quality.TRAINING_ROWS`` labelled rows of the training fold.

Null and empty texts have no clauses and get the score of a text without
matches; a very long one is read whole, clause by clause, in memory in
proportion to it.  Label rows with nulls are passed over, repeated ones count
once; of stems with equal weight the first in order are kept.  With labels of
one class only the score is that class's share, without
labels 0.5.  A null ``doc_id`` counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import spread
from lectern.llm.quality import held_out, training_rows
from lectern.llm.spark import discard, in_arrow, settle
from lectern.llm.words import slices, split_words

THRESHOLD = 0.3
LEXICON_ROWS = 12_000
LEXICON_SIZE = 400
#: Files of the training rows.
TRAINING_FILES = 8
#: Bytes of text whose stems are counted at once.
LEXICON_SLICE = 512 << 10
STEM_LENGTHS = (4, 5, 6, 7, 8, 9)
LEAST_RATIO, MOST_WEIGHT = 5.0, 8.0
#: A stem needs this many toxic rows, and this part of the square root of their number, which is the noise of a count.
LEAST_ROWS, LEAST_ROOT = 3, 1 / 3

PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Function words of the closed classes.
CLOSED = {
    THREAT: "kill hurt destroy murder stab shoot burn beat töten umbringen schlagen tuer frapper matar golpear",
    TARGET: "you your yours u he she they them people toi vous tu ton votre du dich dein ihr euch tú usted tus",
    NEGATION: "not no never nobody without isn't aren't wasn't don't doesn't didn't nicht kein keine nie pas jamais aucun nunca jamás sin",
    REPORT: "said says saying quote quoted claims claimed called reported wrote sagte schrieb dit écrit dijo escribió",
}


class Transducer:
    """Deterministic: ``step(state, symbol)`` gives the next state, ``told(state)`` the flags at the end of what was read."""

    def __init__(self, start, step, told):
        self.start, self.step, self.told = start, step, told

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; flags are joined."""
        return Transducer((self.start, other.start), lambda s, x: (self.step(s[0], x), other.step(s[1], x)), lambda s: self.told(s[0]) + other.told(s[1]))


def _since(left: int, reach: int, seen: bool) -> int:
    """Symbols for which something seen still counts."""
    return reach if seen else max(left - 1, 0)


def insult() -> Transducer:
    """Whether the clause has an insult."""
    return Transducer(False, lambda seen, x: seen or x == INSULT, lambda seen: (seen,))


def target(reach: int) -> Transducer:
    """Whether an insult has a target fewer than ``reach`` symbols before or behind it."""

    def step(state, x):
        before, behind, found = state
        found = found or (x == INSULT and before > 0) or (x == TARGET and behind > 0)
        return _since(before, reach, x == TARGET), _since(behind, reach, x == INSULT), found

    return Transducer((0, 0, False), step, lambda s: (s[2],))


def threat(reach: int) -> Transducer:
    """Whether a threat verb has a target within ``reach`` behind it, or is last with one within ``reach`` before it."""

    def step(state, x):
        before, behind, last, found = state
        found = found or (x == TARGET and behind > 0)
        return _since(before, reach, x == TARGET), _since(behind, reach, x == THREAT), x == THREAT and before > 0, found

    return Transducer((0, 0, False, False), step, lambda s: (s[2] or s[3],))


def under(symbol: int, reach: int) -> Transducer:
    """Whether an insult or a threat verb has ``symbol`` within ``reach`` before it."""

    def step(state, x):
        left, found = state
        return _since(left, reach, x == symbol), found or (x in (INSULT, THREAT) and left > 0)

    return Transducer((0, False), step, lambda s: (s[1],))


class Machine:
    """A transducer as tables that grow by the states that clauses reach."""

    def __init__(self, of: Transducer):
        self.of, self.states, self.go, self.told = of, {}, [], []
        self.number(of.start)

    def number(self, state) -> int:
        if state not in self.states:
            self.states[state] = len(self.states)
            self.go.append([None] * 6)
            self.told.append(self.of.told(state))
        return self.states[state]

    def read(self, symbols: list[int]) -> tuple[bool, ...]:
        """The flags of a clause: insult, target, threat, negation, report."""
        at, go = 0, self.go
        for x in symbols:
            to = go[at][x]
            if to is None:
                to = go[at][x] = self.number(self.of.step(next(s for s, k in self.states.items() if k == at), x))
            at = to
        return self.told[at]


REACH, THREAT_WEIGHT = 4, 4.0
GRAMMAR = Machine(insult().compose(target(REACH)).compose(threat(REACH)).compose(under(NEGATION, 3)).compose(under(REPORT, 8)))
FEATURES = ("bias", "mass", "targeted", "negated", "reported", "threat", "words", "clause", "mass_by_words", "rate", "hits")
DIM = len(FEATURES)


@dataclass(frozen=True)
class Lexicon:
    """Weights of stems; a word takes the heaviest of its stems."""

    weight: dict[str, float]

    def classes(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        closed = {w: k for k, text in CLOSED.items() for w in text.split()}
        kind, weight = np.zeros(len(words), np.int64), np.zeros(len(words))
        get = self.weight.get
        for i, w in enumerate(words):
            if w in closed:
                kind[i] = closed[w]
                weight[i] = THREAT_WEIGHT if kind[i] == THREAT else 0.0
                continue
            best = max([get(w[:n], 0.0) for n in STEM_LENGTHS if n <= len(w)] + [get("=" + w, 0.0)])
            if best > 0:
                kind[i], weight[i] = INSULT, best
        return kind, weight


def normalised(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case words without marks, whether each ends a clause, and offsets of texts."""
    flat, off = split_words(pc.utf8_lower(pc.replace_substring(pc.fill_null(texts, ""), "\n", " ; ")))
    coded = flat.dictionary_encode()
    known = coded.dictionary
    stop = pc.match_substring_regex(known, r"[.!?;]+$").to_numpy(zero_copy_only=False)
    bare = pc.replace_substring_regex(known, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    at = coded.indices.to_numpy()
    return pa.DictionaryArray.from_arrays(pa.array(at, pa.int32()), bare), stop[at], off


def stems(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Prefixes of all words and, from three letters on, each whole word behind ``=``; and the index of each one's word."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    parts, owners = [], []
    for n in STEM_LENGTHS:
        own = np.flatnonzero(size >= n)
        parts.append(pc.utf8_slice_codeunits(words.take(pa.array(own)), 0, n))
        owners.append(own)
    own = np.flatnonzero(size >= 3)
    parts.append(pc.binary_join_element_wise(pa.scalar("="), words.take(pa.array(own)), ""))
    owners.append(own)
    return pa.concat_arrays(parts), np.concatenate(owners)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    words, stop, off = normalised(texts)
    kind, weight = lexicon.classes(words.dictionary.to_pylist())
    at = words.indices.to_numpy()
    kind, weight = kind[at], weight[at]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    # clauses also end where a text ends
    key = (np.concatenate([[0], np.cumsum(stop)[:-1]]) if len(stop) else np.zeros(0, np.int64)) + doc
    if len(kind) > 1:
        # the subject of a reporting verb is nobody's target
        kind[:-1][(kind[:-1] == TARGET) & (kind[1:] == REPORT) & (key[:-1] == key[1:])] = PLAIN
    n = len(off) - 1
    mass, threats, top, hits = np.zeros((n, 8)), np.zeros(n), np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if len(key):
        insults = np.add.reduceat(np.where(kind == INSULT, weight, 0.0), first)
        able = np.maximum.reduceat(((kind == INSULT) | (kind == THREAT)).astype(np.int8), first)
        ends = np.concatenate([first[1:], [len(key)]])
        for c in np.flatnonzero(able).tolist():
            insulted, aimed, threatened, negated, reported = GRAMMAR.read(kind[first[c] : ends[c]].tolist())
            if not insulted and not threatened:
                continue
            d, w = doc[first[c]], insults[c] + THREAT_WEIGHT * threatened
            mass[d, (aimed or threatened) + 2 * negated + 4 * reported] += w
            threats[d] += THREAT_WEIGHT * threatened
            hits[d] += 1
            if not negated and not reported:
                top[d] = max(top[d], w)
    count = np.diff(off)
    direct = mass[:, 0] + mass[:, 1]
    long = np.log1p(count)
    return np.stack([np.ones(n), np.log1p(direct), np.log1p(mass[:, 1]), np.log1p(mass[:, 2] + mass[:, 3]), np.log1p(mass[:, 4:].sum(1)), np.log1p(threats), long, top, np.log1p(direct) * long, np.log1p(1000 * direct / np.maximum(count, 20)), np.log1p(hits)], axis=1)


def _sampled(labels: DataFrame) -> DataFrame:
    """``doc_id, label``: at most ``LEXICON_ROWS`` training rows of each class, small enough for a broadcast."""
    own = labels.filter(~held_out(F.col("doc_id"))).distinct()
    of = lambda k: own.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEXICON_ROWS)
    return F.broadcast(of(0).union(of(1)))


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Stems typical of toxic training rows; ``labels`` has ``doc_id, label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            for k in (0, 1):
                for part in slices(batch.filter(pa.array(label == k)), "text", LEXICON_SLICE):
                    words, _, off = normalised(part.column("text"))
                    # distinct words of each text, then their stems, distinct again
                    at, doc = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(off) - 1), np.diff(off))
                    pair = np.unique(doc * len(words.dictionary) + at)
                    stem, owner = stems(words.dictionary)
                    coded = stem.dictionary_encode()
                    order = np.argsort(owner, kind="stable")
                    code, first = coded.indices.to_numpy()[order], np.searchsorted(owner[order], np.arange(len(words.dictionary) + 1))
                    word, n = pair % max(len(words.dictionary), 1), np.diff(first)
                    hit = np.unique(np.repeat(pair // max(len(words.dictionary), 1), n[word]) * len(coded.dictionary) + code[spread(first[word], n[word])])
                    count = np.bincount(hit % max(len(coded.dictionary), 1), minlength=len(coded.dictionary)) if len(hit) else np.zeros(len(coded.dictionary), np.int64)
                    shown = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary])
                    yield pa.RecordBatch.from_arrays([shown, pa.array(np.full(len(shown), k, np.int32)), pa.array(np.concatenate([[part.num_rows], count]))], ["stem", "label", "n"])

    chosen = docs.select("doc_id", "text").join(_sampled(labels), "doc_id").select("text", "label")
    counted = in_arrow(chosen, run, "stem string, label int, n long")
    per = counted.groupBy("stem").agg(*(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    total = per.filter(F.col("stem") == "").first()
    if not total or not total.n0 or not total.n1:
        return Lexicon({})
    share1, share0 = F.col("n1") / total.n1, (F.col("n0") + 0.5) / total.n0
    weight = F.least(F.log(share1 / share0), F.lit(MOST_WEIGHT))
    kept = per.filter((F.col("stem") != "") & (F.col("n1") >= max(LEAST_ROWS, LEAST_ROOT * total.n1**0.5)) & (share1 >= LEAST_RATIO * share0))
    rows = kept.select("stem", weight.alias("w"), "n1").orderBy(F.col("n1") * F.col("w"), F.col("stem"), ascending=[False, True]).limit(LEXICON_SIZE).collect()
    return Lexicon({r.stem: float(r.w) for r in rows})


@dataclass(frozen=True)
class Logistic:
    """Weights over standardised features; a constant where only one class was seen."""

    weight: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weight, -30, 30)))


def _total(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sum of the vector ``of(x, y)`` over all rows of ``label, x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch.column("x").flatten().to_numpy().reshape(-1, DIM), batch.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["k", "v"])

    out = np.zeros(size)
    for r in in_arrow(rows, run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def fit(rows: DataFrame, rounds: int = 15, ridge: float = 1.0) -> Logistic:
    """Ridge logistic regression by Newton steps; each step sums over all rows of ``label, x``."""
    sums = _total(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * DIM)
    n, ones = sums[:2]
    zero, one = np.zeros(DIM), np.ones(DIM)
    if ones in (0, n):
        return Logistic(zero, zero, one, float(ones / n) if n else 0.5)
    mean = sums[2 : 2 + DIM] / n
    scale = np.sqrt(np.maximum(sums[2 + DIM :] / n - mean**2, 0)) + 1e-9
    mean[0], scale[0] = 0, 1
    weight = np.zeros(DIM)
    for _ in range(rounds):
        now = Logistic(weight, mean, scale)

        def slopes(x: np.ndarray, y: np.ndarray, now: Logistic = now) -> np.ndarray:
            p, z = now.score(x), (x - now.mean) / now.scale
            return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        total = _total(rows, slopes, DIM + DIM * DIM)
        step = np.linalg.solve(total[DIM:].reshape(DIM, DIM) + ridge * np.eye(DIM), total[:DIM] - ridge * weight)
        weight = weight + step
        if np.abs(step).max() < 1e-3:
            break
    return Logistic(weight, mean, scale)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; ``labels`` has ``doc_id, label``."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", "label")
    lexicon = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"), lexicon)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "x"])

    featured = settle(in_arrow(docs.select("doc_id", "text"), run, "doc_id long, x array<double>"))
    # read many times: a few files instead of one for each shuffle partition
    train = settle(featured.join(training_rows(labels), "doc_id").select("label", "x").repartition(TRAINING_FILES))
    model = fit(train)
    discard(train)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, DIM)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = in_arrow(featured, score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
