"""Toxicity by a weighted finite-state grammar over clauses.

The lexicon maps the words of a clause to symbols: insults (by stem, in three grades), threats,
targets, negations, verbs of saying, quotation marks. Three sequential transducers follow, each a
table of arcs (state, symbol) -> (state, outputs, weight) and of ends:

* negation rewrites an insult or threat shortly after a negation as denied;
* reporting rewrites one after a verb of saying, or inside quotation marks, as reported;
* pairing reads what the others leave, remembers the strongest insult, a threat and a target, and puts
  out the kinds of matched clause at the end, the weight of the path being that of what was matched.

They are composed once into one transducer, which is run over the clauses. A logistic model over the
weights of matched clauses by kind gives the score. Isolated words are never counted: a word counts
by the path it takes.

Insult stems are a short fixed list and those that labels show: beginnings of words that are far more
frequent in toxic documents. Both stems and weights are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .site_quality import fit, labelled_sample

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS, FOLD = 4, 2
STEM_CHARS = range(4, 13)
LEAST_DOCS = 5
LEAST_ODDS = 3.0
#: Words known beforehand.
INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting trash clown imbecile bastard idiota estúpid imbécil dumm abschaum verlierer connard ordure"
THREATS = "kill destroy hurt beat burn shoot crush töten schlagen vernichten tuer détruire frapper matar destruir golpear"
TARGETS = "you your yours he she they them him her his their du dich dein ihr euch sie tu toi vous ton ta votre elle ils tú usted ustedes ella ellos"
NEGATIONS = "not no never neither nor without nicht kein keine nie pas jamais ni sin nunca tampoco"
SAYING = "said says say claimed called quoted reported wrote replied sagte sagt nannte schrieb dit disait écrit dijo dice escribió"
WORD = re.compile(r"[^\W\d_]+|[\"“”«»]")
CLAUSE = re.compile(r"[.!?;:\n]+")
NEAR = 4
KINDS = ("insult", "insult_target", "threat_target", "denied", "reported")
#: The least log-odds of the stems of each grade of insults, and what a clause with such an insult weighs.
GRADES = {"insult1": LEAST_ODDS, "insult2": 4.0, "insult3": 5.0}
THREAT_WEIGHT = 1.0
ASIDE_WEIGHT = 1.0
SYMBOLS = ("word", "target", "neg", "say", "quote", "threat", *GRADES)
REWRITTEN = ("denied", "reported")
#: Words whose symbols a task remembers.
WORDS_HELD = 200_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == FOLD


class Lexicon(dict):
    """Words to symbols, remembered; `hits` finds the places at which a clause can match at all."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems = dict.fromkeys(INSULTS.split(), LEAST_ODDS) | stems
        self.fixed = {w: s for s, ws in (("say", SAYING), ("neg", NEGATIONS), ("target", TARGETS), ("threat", THREATS)) for w in ws.split()}
        self.fixed |= dict.fromkeys("\"“”«»", "quote")
        self.longest = max(map(len, self.stems))
        self.heads = ahocorasick.Automaton()
        for x in {*self.stems, *THREATS.split()}:
            self.heads.add_word(x, len(x))
        self.heads.make_automaton()

    def symbol(self, word: str) -> str:
        if kind := self.fixed.get(word):
            return kind
        for k in range(min(len(word), self.longest), 2, -1):
            if (odds := self.stems.get(word[:k])) is not None:
                return max((g for g, least in GRADES.items() if odds >= least), default="insult1")
        return "word"

    def __missing__(self, word: str) -> int:
        """The number of a word's symbol in SYMBOLS."""
        if len(self) > WORDS_HELD:
            self.clear()
        number = self[word] = SYMBOLS.index(self.symbol(word))
        return number

    def hits(self, low: str) -> Iterator[int]:
        """Where a word of a text in lower case begins with a stem or a threat."""
        for end, size in self.heads.iter(low):
            at = end - size + 1
            if at == 0 or not (low[at - 1].isalnum() and not low[at - 1].isdecimal()):
                yield at


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer with additive weights.

    arcs: (state, symbol) -> (state, outputs, weight). ends: state -> (outputs, weight).
    """

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, tuple[str, ...], float]]
    ends: dict[Hashable, tuple[tuple[str, ...], float]]

    def read(self, state: Hashable, symbols: Iterable[str]) -> tuple[Hashable, tuple[str, ...], float]:
        """The state after symbols, and what is put out and weighed on the way."""
        out: tuple[str, ...] = ()
        weight = 0.0
        for s in symbols:
            state, made, w = self.arcs[state, s]
            out, weight = out + made, weight + w
        return state, out, weight

    def run(self, symbols: Iterable[str]) -> tuple[tuple[str, ...], float]:
        state, out, weight = self.read(self.start, symbols)
        made, w = self.ends[state]
        return out + made, weight + w


def tabulated(start: Hashable, symbols: Iterable[str], step: Callable, end: Callable) -> Transducer:
    """The transducer of all states that step(state, symbol) -> (state, outputs, weight) reaches from start."""
    arcs, ends, todo, symbols = {}, {}, [start], list(symbols)
    while todo:
        state = todo.pop()
        ends[state] = end(state)
        for s in symbols:
            arcs[state, s] = step(state, s)
            if (to := arcs[state, s][0]) not in ends and to not in todo:
                todo.append(to)
    return Transducer(start, arcs, ends)


def composed(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that does what second does with what first puts out."""

    def step(state: tuple, symbol: str) -> tuple:
        to, out, w = first.arcs[state[0], symbol]
        to2, out2, w2 = second.read(state[1], out)
        return (to, to2), out2, w + w2

    def end(state: tuple) -> tuple:
        out, w = first.ends[state[0]]
        to2, out2, w2 = second.read(state[1], out)
        last, w3 = second.ends[to2]
        return out2 + last, w + w2 + w3

    return tabulated((first.start, second.start), dict.fromkeys(s for _, s in first.arcs), step, end)


def attack(symbol: str) -> bool:
    return symbol == "threat" or symbol in GRADES


def silent(state: Hashable) -> tuple[tuple[str, ...], float]:
    return (), 0.0


def negation(near: int = NEAR) -> Transducer:
    """States: how many words ago a negation stood, up to near + 1 for none."""

    def step(since: int, s: str) -> tuple:
        now = 0 if s == "neg" else min(since + 1, near + 1)
        return now, ("denied",) if attack(s) and now <= near else (s,), 0.0

    return tabulated(near + 1, SYMBOLS, step, silent)


def reporting() -> Transducer:
    """States: whether a verb of saying stood before, and whether a quotation mark is open."""

    def step(state: tuple[bool, bool], s: str) -> tuple:
        said, quoted = state[0] or s == "say", state[1] != (s == "quote")
        return (said, quoted), ("reported",) if attack(s) and (said or quoted) else (s,), 0.0

    return tabulated((False, False), (*SYMBOLS, "denied"), step, silent)


def pairing() -> Transducer:
    """States: the grade of the strongest insult (0: none), whether a threat and a target were met, and what was denied or reported."""
    grades = list(GRADES)

    def step(state: tuple, s: str) -> tuple:
        grade, threat, target, aside = state
        if s in GRADES and (new := grades.index(s) + 1) > grade:
            return (new, threat, target, aside), (), GRADES[s] - (GRADES[grades[grade - 1]] if grade else 0.0)
        if s == "threat" and not threat:
            return (grade, True, target, aside), (), THREAT_WEIGHT
        if s in REWRITTEN and s not in aside:
            return (grade, threat, target, tuple(sorted({*aside, s}))), (), ASIDE_WEIGHT
        return (grade, threat, target or s == "target", aside), (), 0.0

    def end(state: tuple) -> tuple:
        grade, threat, target, aside = state
        kinds = [("insult_target" if target else "insult")] if grade else []
        kinds += ["threat_target"] if threat and target else []
        return (*kinds, *aside), 0.0

    return tabulated((0, False, False, ()), (*SYMBOLS, *REWRITTEN), step, end)


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    return composed(composed(negation(), reporting()), pairing())


@lru_cache(maxsize=1)
def compiled() -> tuple[list[int], list[float], list[tuple[tuple[str, ...], float]]]:
    """The grammar with numbers for states and symbols: where each arc leads, its weight, and the ends. No arc of it puts anything out."""
    g = grammar()
    if any(out for _, out, _ in g.arcs.values()):
        raise ValueError("an arc puts something out before the end of a clause")
    number = {state: k for k, state in enumerate(sorted(g.ends, key=lambda s: s != g.start))}
    arcs = [g.arcs[state, s] for state in number for s in SYMBOLS]
    return [number[to] for to, _, _ in arcs], [w for _, _, w in arcs], [g.ends[state] for state in number]


def run_compiled(symbols: Iterable[int]) -> tuple[tuple[str, ...], float]:
    """What the grammar makes of a clause of numbered symbols."""
    to, weights, ends = compiled()
    state, weight, wide = 0, 0.0, len(SYMBOLS)
    for s in symbols:
        at = state * wide + s
        state = to[at]
        weight += weights[at]
    kinds, last = ends[state]
    return kinds, weight + last


def clauses(text: str, lexicon: Lexicon) -> np.ndarray:
    """Weights of matched clauses by kind: constant, sum and presence of each."""
    low, sums = text.lower(), dict.fromkeys(KINDS, 0.0)
    if found := list(lexicon.hits(low)):
        ends = np.array([*(x.end() for x in CLAUSE.finditer(low)), len(low)])
        for k in np.unique(np.searchsorted(ends, found, side="right")).tolist():
            words = WORD.findall(low[ends[k - 1] if k else 0 : ends[k]])
            kinds, weight = run_compiled(map(lexicon.__getitem__, words))
            for kind in kinds:
                sums[kind] += weight
    values = np.array(list(sums.values()))
    return np.array([1.0, *np.log1p(values), *(values > 0)])


@lru_cache(maxsize=2)
def lexicon_of(stems: tuple[tuple[str, float], ...]) -> Lexicon:
    return Lexicon(dict(stems))


def learnt_stems(sample: DataFrame) -> dict[str, float]:
    """Beginnings of words that mark toxic rows of sample(y, text), with their log-odds, shortest ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in c], pa.string()), pa.array([y for _, y in c], pa.int32()), pa.array(list(c.values()), pa.int64())], names=["stem", "y", "n"])

        c: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                c.update((s, y) for s in {w[:k] for w in words for k in STEM_CHARS if len(w) >= k})
                if len(c) > 500_000:
                    yield flushed(c)
                    c.clear()
        if c:
            yield flushed(c)

    rows = sample.groupBy("y").count().collect()
    n = {0: 0, 1: 0} | {int(r.y > 0): r["count"] for r in rows}
    counts = sample.mapInArrow(run, "stem string, y int, n long").groupBy("stem").agg(F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") > 0, 0).otherwise(F.col("n"))).alias("f"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("f") + 0.5) / (n[0] + 1))
    found = {r.stem: r.odds for r in counts.where(F.col("t") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).collect()}  # of a bounded sample
    return {s: w for s, w in sorted(found.items()) if not any(s[:k] in found for k in range(1, len(s)))}


class Model:
    def __init__(self, stems: dict[str, float], weights: np.ndarray):
        self.stems, self.weights = tuple(stems.items()), weights

    def score(self, text: str) -> float:
        z = clauses(text, lexicon_of(self.stems)) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The grammar's stems and weights, from at most `rows` labelled rows outside of the held-out fold."""
    common.ship(docs.sparkSession)
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != FOLD
    few = F.broadcast(labelled_sample(labels.where(learn), "toxic", rows))  # of at most `rows` rows
    held = common.documents(docs).join(few, F.col("doc_id") == F.col("id")).groupBy("doc_id")  # one row for each label
    sample = common.checkpointed(held.agg(F.first("y").alias("y"), F.min("text").alias("text")))
    stems = learnt_stems(sample.select("y", "text"))
    known = tuple(stems.items())
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for batch in batches:
                for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    yield y, clauses(text or "", lexicon_of(known))

        yield from common.batches_of(made(), schema)

    got = sample.select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    got.sort(key=lambda r: (r.y, r.x))
    x = np.array([r.x for r in got]).reshape(len(got), 1 + 2 * len(KINDS))
    return Model(stems, fit(x, np.array([int(r.y > 0) for r in got])))


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs(doc_id, text).

    labels(doc_id, toxic) are for fitting; of repeated ones the larger counts. A null or empty text
    has no clause and the score of such. Repeated rows are scored each; a null doc_id is passed on.
    Other columns are not read. Without labels every score is 0.5;
    an empty table gives an empty one.
    """
    model = trained(docs, labels, rows)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for doc_id, text in common.rows(batches):
                s = model.score(text.decode())
                yield doc_id, held_out(doc_id), s, int(s >= threshold)

        yield from common.batches_of(made(), schema)

    return common.documents(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
