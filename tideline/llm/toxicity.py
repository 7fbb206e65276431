"""Toxicity scores from a weighted finite-state grammar over clauses."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.classifier import labelled
from tideline.llm.common import LOWER, Prefix, fold, steps, words

#: Labelled rows the stems and weights are learned from: those with the smallest hash of their id.
SAMPLE_ROWS = 6000
#: Fewest toxic documents of the sample that hold a stem, and the least share of toxic ones among those that hold it.
SUPPORT, PRECISION = 5, 0.9
STEM_LENGTHS = range(3, 9)
#: Words after a negation that it reaches.
REACH = 3

# Seed lexicon of the grammar; insults of other languages are learned as word stems.
INSULTS = "idiot moron loser scum trash stupid pathetic worthless disgusting clown"
THREATS = "kill hurt destroy hunt punish murder beat burn"
TARGETS = "you your yours he she they him her them tu vous toi du dich ihr euch usted ustedes te"
NEGATIONS = "not no never isn aren don nobody nicht kein nie pas jamais nunca tampoco"
REPORTS = "said says called told wrote claimed quoted sagte schrieb dit dijo"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: What a finished clause is.
NOTHING, PLAIN, TARGETED, REPEATED, THREATENING, NEGATED, REPORTED = range(7)
_LETTER = np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)])
_BREAK = np.array([chr(b) in ".!?;:\n\r" if b < 128 else False for b in range(256)])


class Transducer:
    """States 0..n-1 (0 at a clause's start) and a rule (state, symbol) -> state."""

    def __init__(self, states: int, rule):
        self.states, self.rule = states, rule


#: 0, 1 or more insults; the others remember that their word occurred. A negation counts the words it still reaches,
#: and one that meets an insult or a threat marks the clause (state REACH + 1).
PARTS = {
    "insult": Transducer(3, lambda s, x: min(2, s + 1) if x == INSULT else s),
    "threat": Transducer(2, lambda s, x: 1 if x == THREAT else s),
    "target": Transducer(2, lambda s, x: 1 if x == TARGET else s),
    "negation": Transducer(REACH + 2, lambda s, x: s if s > REACH else REACH if x == NEGATION else (REACH + 1 if s else 0) if x in (INSULT, THREAT) else max(0, s - 1)),
    "report": Transducer(2, lambda s, x: 1 if x == REPORT else s),
}


def verdict(insult: int, threat: int, target: int, negation: int, report: int) -> int:
    if not insult and not (threat and target):
        return NOTHING
    if report:
        return REPORTED
    if negation > REACH:
        return NEGATED
    if not insult:
        return THREATENING
    return TARGETED if target else REPEATED if insult > 1 else PLAIN


class Grammar:
    """The composition of the parts: one table of moves and the verdict of a clause that ends in a state."""

    def __init__(self):
        states = list(product(*(range(t.states) for t in PARTS.values())))
        number = {s: i for i, s in enumerate(states)}
        self.move = [[number[tuple(t.rule(own, x) for t, own in zip(PARTS.values(), s))] for x in range(END)] for s in states]
        self.out = [verdict(*s) for s in states]

    def clause(self, symbols: list[int]) -> int:
        state = 0
        for x in symbols:
            state = self.move[state][x]
        return self.out[state]


class Lexicon:
    """Symbols of words: whole words of the seed lists, and insult stems (a stem that ends in $ is a whole word)."""

    def __init__(self, stems: list[str]):
        whole = {w: s for s, ws in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws.split()}
        whole |= {s[:-1]: INSULT for s in stems if s.endswith("$")}
        by_length: dict[int, dict[str, int]] = {}
        for s in stems:
            if not s.endswith("$"):
                by_length.setdefault(len(s.encode()), {})[s] = INSULT
        self.tables = [(0, *self.table(whole)), *((n, *self.table(t)) for n, t in sorted(by_length.items()))]

    @staticmethod
    def table(symbols: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in symbols]
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        code = Prefix(np.frombuffer(b"".join(raw), np.uint8)).of(at[:-1], at[1:])
        order = np.argsort(code)
        return code[order], np.array(list(symbols.values()))[order]

    def symbols(self, prefix: Prefix, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lo), np.int64)
        for n, code, symbol in self.tables:
            on = np.flatnonzero(hi - lo >= n) if n else np.arange(len(lo))
            word = prefix.of(lo[on], lo[on] + n if n else hi[on])
            at = np.minimum(np.searchsorted(code, word), len(code) - 1)
            hit = code[at] == word
            out[on[hit]] = np.where(out[on[hit]] == OTHER, symbol[at[hit]], out[on[hit]])
        return out


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower-cased bytes of ASCII and Latin-1 letters."""
    buf = LOWER[buf]
    if len(buf) > 1:
        after = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf[1:][after] += 32
    return buf


def clause_counts(buf: np.ndarray, offs: np.ndarray, lexicon: Lexicon, grammar: Grammar) -> np.ndarray:
    """Per text: clauses of each verdict, then words and matched words. Only clauses with an insult or a threat are run."""
    buf = folded(buf)
    lo, hi, at = words(buf, offs, _LETTER)
    counts = np.zeros((len(offs) - 1, REPORTED + 3))
    counts[:, -2] = np.diff(at)
    if not len(lo):
        return counts
    symbol = lexicon.symbols(Prefix(buf), lo, hi)
    new = np.zeros(len(lo), bool)
    new[0] = True
    breaks = np.cumsum(_BREAK[buf])
    new[1:] = breaks[lo[1:]] > breaks[lo[:-1]]
    new[at[:-1][at[:-1] < len(lo)]] = True
    first = np.flatnonzero(new)
    matched = (symbol == INSULT) | (symbol == THREAT)
    clause = np.cumsum(new) - 1
    last = np.concatenate([first[1:], [len(lo)]])
    doc_of = np.searchsorted(at, first, "right") - 1
    for c in np.unique(clause[matched]):
        counts[doc_of[c], grammar.clause(symbol[first[c]:last[c]].tolist())] += 1
    np.add.at(counts[:, -1], doc_of[clause[matched]], 1)
    return counts


def inputs(counts: np.ndarray) -> np.ndarray:
    """Features of the output: logarithms of clause counts and of matched words among all."""
    return np.column_stack([np.log1p(counts[:, PLAIN:REPORTED + 1]), np.log1p(1000 * counts[:, -1] / np.maximum(counts[:, -2], 1)) * (counts[:, PLAIN:NEGATED].sum(axis=1) > 0)])


#: Weights before any label is seen; negated and reported clauses count for nothing.
PRIOR = np.array([1.0, 2.0, 2.0, 2.0, 0.0, 0.0, 0.3])
PRIOR_BIAS = -2.0


def weigh(x: np.ndarray, y: np.ndarray, pull: float = 0.05, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Logistic weights near the prior ones, by gradient descent."""
    w, b = PRIOR.copy(), PRIOR_BIAS
    for k in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        rate = 2.0 / (1 + k / 200)
        w -= rate * (x.T @ (p - y) / len(y) + pull / np.sqrt(len(y)) * (w - PRIOR))
        b -= rate * np.mean(p - y)
    return w, b


class Model:
    def __init__(self, stems: list[str], weights: np.ndarray = PRIOR, bias: float = PRIOR_BIAS):
        self.stems, self.weights, self.bias = stems, weights, bias
        self.lexicon, self.grammar = Lexicon(stems), Grammar()

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return clause_counts(buf, offs, self.lexicon, self.grammar)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(counts) @ self.weights + self.bias, -50, 50)))


def stems(sample: DataFrame) -> list[str]:
    """Word beginnings and whole words that mark toxic documents of sample(text, label). A stem with a longer one that
    keeps its toxic documents and sheds others gives way to that; a stem behind a chosen shorter one is left out."""
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")
    of = F.array_distinct(F.concat(F.array(F.concat("word", F.lit("$"))), *(F.when(F.length("word") > k, F.array(F.substring("word", 1, k))).otherwise(F.array().cast("array<string>")) for k in STEM_LENGTHS)))
    each = sample.select("doc_id", "label", word).where("word <> ''").select("doc_id", "label", F.explode(of).alias("stem")).distinct()
    kept = each.groupBy("stem").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).where(F.col("toxic") >= SUPPORT)
    kept = kept.where(F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean") + 0.5))
    found = {r["stem"]: (r["toxic"], r["clean"]) for r in kept.collect()}
    chosen: set[str] = set()
    for s in sorted(found, key=lambda s: (len(s.rstrip("$")), s)):
        if any(s[:k] in chosen for k in STEM_LENGTHS if k < len(s)):
            continue
        toxic, clean = found[s]
        longer = [t for t in found if len(t) == len(s) + 1 and t.startswith(s) and not s.endswith("$")]
        if any(found[t][0] >= 0.97 * toxic and found[t][1] <= clean for t in longer):
            continue
        chosen.add(s)
    return sorted(chosen)


def counted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, other columns and `clauses` (counts by verdict, words, matched words) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("text", "clauses", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in steps(batches, "text"):
            counts = shared.value.counts(buf, offs)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(list(counts), pa.list_(pa.float64())), pa.array(shared.value.scores(counts))], [*own, "clauses", "score"])

    schema = docs.select(*own, F.lit(None).cast("array<double>").alias("clauses"), F.lit(0.0).alias("score")).schema
    return docs.select(*own, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 5, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns stems and clause weights from at most `sample_rows` labelled documents outside fold 0, with whole texts.
    Without labels the seed lexicon and the prior weights stand."""
    picked = labelled(labels, column).where(fold("doc_id", folds) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    chosen = docs.sparkSession.createDataFrame([(r[0], min(1, max(0, r[1]))) for r in picked], "doc_id bigint, label int")
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    model = Model(stems(sample))
    rows = counted(sample, model).select("doc_id", "label", "clauses").orderBy("doc_id").collect()
    x = inputs(np.array([r["clauses"] for r in rows]).reshape(-1, REPORTED + 3))
    return Model(model.stems, *weigh(x, np.array([r["label"] for r in rows], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but the text, with the clause counts and `score`, the probability of label 1. A null or empty text has no
    clauses and gets the score of a text without matches; repeated rows get equal scores."""
    return counted(docs, model)
