"""Secrets in texts: fixed patterns, and character Markov models of random strings against ordinary identifiers."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fold, ints, owners, ranges, steps

#: Kinds of spans in their order; the first three are patterns, the last is what the models add.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: Least length of an added span, and of a string that teaches the model of ordinary identifiers.
RANDOM_CHARS, SAMPLE_CHARS = 16, 4
#: Share of the held-out fold's unlabelled strings that may pass the cut; secrets that no pattern labels are among them.
RISK = 0.01
#: Width of a bin of held-out scores, in nats, and the number of bins.
BIN, BINS = 0.5, 4096
#: Least cut, in nats: odds of e^12 to 1 for a random string.
LEAST_CUT = 12.0

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Strength of the smoothing: random strings have next to no order, so their pairs need much proof.
PRIOR = {False: 256.0, True: 4.0}
STATES = len(ALPHABET) + 1  # the last one stands before a string
CLASSES = ("assign", "access", "hex", "ordinary")
SYMBOL = np.full(256, -1, np.int64)
SYMBOL[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
HEX = np.zeros(256, bool)
HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_NONE = np.zeros((0, 2), np.int64)


def runs(mask: np.ndarray) -> np.ndarray:
    """[start, end) of the maximal runs of true cells."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)


def lined(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line feed behind each, which no span crosses, and the start of each text."""
    out = np.full(len(buf) + len(offs) - 1, 10, np.uint8)
    out[np.arange(len(buf)) + owners(offs)] = buf
    return out, offs[:-1] + np.arange(len(offs) - 1)


def patterns(text: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """[start, end) of the matches of each pattern, and of the values of the assignments."""
    raw = text.tobytes()
    found = [(m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(raw.lower()) if m.end(1) - m.start(1) >= ASSIGN_CHARS]
    assign = np.array(found, np.int64).reshape(-1, 3)
    access = np.array([m.span() for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_CHARS], np.int64).reshape(-1, 2)
    hexes = runs(HEX[text])
    return [assign[:, :2], access, hexes[hexes[:, 1] - hexes[:, 0] >= HEX_CHARS]], assign[:, [2, 1]]


def ordinary(text: np.ndarray, spans: list[np.ndarray], least: int) -> np.ndarray:
    """[start, end) of the runs of the alphabet outside all spans."""
    free = SYMBOL[text] >= 0
    for kind in spans:
        free[ranges(kind[:, 0], kind[:, 1] - kind[:, 0])] = False
    found = runs(free)
    return found[found[:, 1] - found[:, 0] >= least]


def transitions(text: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Counts of symbol pairs in the strings, the one before the first symbol being the start state."""
    at = ranges(strings[:, 0], strings[:, 1] - strings[:, 0])
    symbols = SYMBOL[text[at]]
    before = np.concatenate([[STATES - 1], symbols[:-1]]) if len(at) else symbols
    sizes = strings[:, 1] - strings[:, 0]
    before[np.cumsum(sizes) - sizes] = STATES - 1
    return np.bincount(before * STATES + symbols, minlength=STATES * STATES)


@dataclass
class Model:
    """Log-likelihood ratios of symbol pairs, one chain of random strings each against the ordinary one, and the cut."""

    ratios: np.ndarray  # (random classes, STATES * STATES)
    cut: float = LEAST_CUT
    missed: float = 0.0  # share of held-out secrets below the cut

    def steps_of(self, text: np.ndarray, lo: int, hi: int) -> np.ndarray:
        symbols = SYMBOL[text[lo:hi]]
        before = np.concatenate([[STATES - 1], symbols[:-1]])
        return self.ratios[:, before * STATES + symbols]

    @staticmethod
    def best(steps_: np.ndarray) -> tuple[float, int, int]:
        """The stretch with the greatest sum of ratios under one of the chains."""
        sums = np.concatenate([np.zeros((len(steps_), 1)), np.cumsum(steps_, axis=1)], axis=1)
        low = np.minimum.accumulate(sums, axis=1)
        gain = sums - low
        chain, end = np.unravel_index(int(np.argmax(gain)), gain.shape)
        start = int(np.flatnonzero(sums[chain, :end + 1] == low[chain, end])[0])
        return float(gain[chain, end]), start, int(end)

    def added(self, text: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, float]]:
        """Stretches of a run that score the cut or more, widened to RANDOM_CHARS: the best first, then those beside it."""
        open_ = [(lo, hi)]
        while open_:
            lo, hi = open_.pop()
            if hi - lo < RANDOM_CHARS:
                continue
            score, start, end = self.best(self.steps_of(text, lo, hi))
            if score >= self.cut:
                end = max(end, min(start + RANDOM_CHARS, hi - lo))
                start = min(start, end - RANDOM_CHARS)
                yield lo + start, lo + end, score
                open_ += [(lo, lo + start), (lo + end, hi)]


def chains(counts: np.ndarray) -> np.ndarray:
    """Ratios from pair counts (class, STATES * STATES). Each row of a chain is smoothed by the class's symbol shares
    and those by a uniform alphabet, so that an empty class is a uniform random string."""
    logs = []
    for name, c in zip(CLASSES, counts.reshape(len(CLASSES), STATES, STATES).astype(float)):
        prior = PRIOR[name == CLASSES[-1]]
        shares = (c.sum(axis=0)[:-1] + 1.0) / (c.sum() + STATES - 1)
        rows = (c[:, :-1] + prior * shares) / (c.sum(axis=1, keepdims=True) + prior)
        logs.append(np.log(np.concatenate([rows, np.ones((STATES, 1))], axis=1)))
    return np.stack([(x - logs[-1]).ravel() for x in logs[:-1]])


def tallied(docs: DataFrame, tally) -> np.ndarray:
    """Sum of the count vectors that `tally(text bytes)` gives for every step of the documents: one row for each cell
    that a task has counted, summed before and after the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, buf, offs in steps(batches, "text"):
            counts = tally(lined(buf, offs)[0])
            total = counts if total is None else total + counts
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = docs.select("text").where("text is not null").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r["cell"] for r in rows], default=-1) + 1, np.int64)
    out[[r["cell"] for r in rows]] = [r["n"] for r in rows]
    return out


def sample_counts(text: np.ndarray) -> np.ndarray:
    spans, values = patterns(text)
    strings = [values, *spans[1:], ordinary(text, spans, SAMPLE_CHARS)]
    return np.concatenate([transitions(text, s) for s in strings])


def bin_counts(text: np.ndarray, model: Model) -> np.ndarray:
    """Held-out scores of secrets and of ordinary strings, in bins."""
    spans, values = patterns(text)
    out = np.zeros((2, BINS), np.int64)
    for row, strings in enumerate((np.concatenate([values, *spans[1:]]), ordinary(text, spans, RANDOM_CHARS))):
        for lo, hi in strings:
            out[row, min(int(model.best(model.steps_of(text, lo, hi))[0] / BIN), BINS - 1)] += 1
    return out.ravel()


def fit(docs: DataFrame, folds: int = 5, risk: float = RISK) -> Model:
    """The chains, learned from labelled strings of all documents but one fold, and the cut, chosen on that fold.

    The labels: values of assignments, access keys and long hexadecimal strings are random ones, a chain for each kind;
    all other runs of SAMPLE_CHARS symbols are ordinary. Every occurrence counts. The cut is LEAST_CUT, or the least
    score above it that no more than `risk` of the fold's ordinary strings reach. Null texts, empty texts and an empty
    table teach nothing: all chains are then uniform, every ratio is 0 and nothing is added.
    """
    held = fold("doc_id", folds) == 0
    counts = tallied(docs.where(~held), sample_counts)
    counts = np.concatenate([counts, np.zeros(len(CLASSES) * STATES * STATES - len(counts), np.int64)])
    model = Model(chains(counts.reshape(len(CLASSES), -1)))
    bins = tallied(docs.where(held), lambda text: bin_counts(text, model))
    secrets, plain = np.concatenate([bins, np.zeros(2 * BINS - len(bins), np.int64)]).reshape(2, BINS)
    passing = np.concatenate([np.cumsum(plain[::-1])[::-1], [0]])  # ordinary strings with a score of this bin or more
    model.cut = max(LEAST_CUT, BIN * int(np.flatnonzero(passing <= risk * plain.sum())[0]))
    model.missed = float(secrets[:int(model.cut / BIN)].sum() / max(secrets.sum(), 1))
    return model


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,secret:string>>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) of every document: all matches of the patterns and what the models add outside of them, with
    kind, start and end in code points (end exclusive), score (null for patterns) and text, by start, then kind.

    Added spans are the best-scoring stretches, of RANDOM_CHARS symbols at least and with a score of the cut or more. Null and empty
    texts have none; repeated rows are scanned each for itself; only doc_id and text are read, so further columns of
    any name do no harm; an empty table gives no rows. Spans of different kinds may overlap, those of one kind don't.
    """
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("secret", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in steps(batches, "text"):
            text, first = lined(buf, offs)
            found, _ = patterns(text)
            spans = [(int(lo), k, int(hi), None) for k, kind in enumerate(found) for lo, hi in kind]
            for lo, hi in ordinary(text, found, RANDOM_CHARS):
                spans += [(a, 3, b, score) for a, b, score in model.added(text, int(lo), int(hi))]
            spans.sort(key=lambda s: s[:3])
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for (lo, kind, hi, score), d in zip(spans, np.searchsorted(first, [s[0] for s in spans], "right") - 1):
                zero = points[first[d]]
                rows[d].append({"kind": KINDS[kind], "start": int(points[lo] - zero), "end": int(points[hi] - zero), "score": score, "secret": text[lo:hi].tobytes().decode("utf-8")})
            yield pa.RecordBatch.from_arrays([ints(batch, "doc_id"), pa.array(rows, pa.list_(struct))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def digest(scanned: DataFrame) -> DataFrame:
    """Contract columns of the query from `scan`."""
    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return scanned.select("doc_id", *map(count, KINDS[:3]), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), count(KINDS[3]))

