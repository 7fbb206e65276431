"""Supervised subword embeddings: hashed word and character n-gram vectors averaged over a document, softmax output."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WHITE, Prefix, fold, ints, mixed, segment_sums, steps, words

#: Labelled rows the vectors are learned from: those with the smallest hash of their id.
SAMPLE_ROWS = 2500
BUCKETS = 1 << 16
#: Lengths of character n-grams, in bytes, within words and their edges.
GRAMS = (2, 3, 4)
DIM, EPOCHS, RATE = 12, 6, 0.4
SCALE = 64.0


def features(buf: np.ndarray, offs: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, byte position) of every feature: words, pairs of equal or different words, character n-grams. A pair of
    equal words has one bucket for all words. Character n-grams may start or end at a word's edge, never span two words."""
    prefix = Prefix(buf)
    lo, hi, at = words(buf, offs, WHITE)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    if not len(lo):
        return []
    word = prefix.of(lo, hi)
    before = np.concatenate([[np.uint64(0)], word[:-1]])
    starts = at[:-1][at[:-1] < at[1:]]
    before[starts] = np.uint64(1)
    pair = np.where(before == word, np.uint64(7), before * np.uint64(31) + word)
    out = [(mixed(word + np.uint64(1)) >> shift, lo), (mixed(pair) >> shift, lo)]
    inside = ~WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[lo] = True
    run = np.cumsum(edge[:-1]) * inside  # number of the word a byte is in, 0 outside
    for n in GRAMS:
        if len(buf) < n:
            break
        first = np.arange(len(buf) - n + 1)
        ok = inside[:len(first)] & (run[first] == run[first + n - 1])
        first = first[ok]
        out.append((mixed(prefix.of(first, first + n) + np.uint64(n)) >> shift, first))
    # marked edges: the first and the last bytes of a word
    for n in (1, 3):
        size = np.minimum(n, hi - lo)
        out.append((mixed(prefix.of(lo, lo + size) + np.uint64(101 + n)) >> shift, lo))
        out.append((mixed(prefix.of(hi - size, hi) + np.uint64(201 + n)) >> shift, lo))
    return out


class Model:
    """Vectors and output weights, and what scoring needs of them: the mean of vectors under a linear output is the
    mean of the buckets' own outputs."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.vectors, self.output, self.bias = vectors, output, bias
        margin = (output[1] - output[0]).astype(np.float64)
        self.margins = vectors.astype(np.float64) @ margin
        self.offset = float(bias[1] - bias[0])

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        for bucket, position in features(buf, offs, len(self.margins)):
            at = np.searchsorted(position, offs)
            total += segment_sums(self.margins[bucket.astype(np.int64)], at)
            count += np.diff(at)
        return 1 / (1 + np.exp(-(SCALE * total / np.maximum(count, 1) + self.offset)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, shares) of documents; the learning rate falls to 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (buckets, DIM)).astype(np.float32)
    output, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    done, steps_ = 0, max(1, EPOCHS * len(bags))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            bucket, share = bags[i]
            rate = RATE * (1 - done / steps_)
            done += 1
            hidden = SCALE * (share @ vectors[bucket]) if len(bucket) else np.zeros(DIM, np.float32)
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = error @ output
            output -= rate * 0.05 * np.outer(error, hidden)
            bias -= rate * 0.05 * error
            if len(bucket):
                vectors[bucket] -= (rate * share)[:, None] * back
    return Model(vectors, output, bias)


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, label) per labelled document: the smallest label of repeated rows, nulls left out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 5, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Model:
    """Learns from at most `sample_rows` labelled documents outside fold 0, each with its whole text. Tasks count the
    features of their texts; the driver sees bucket counts of the sample alone (`buckets` numbers a document at most)."""
    spark, kind = docs.sparkSession, "<u2" if buckets <= 1 << 16 else "<u4"
    picked = labelled(labels, column).where(fold("doc_id", folds) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = {r[0]: r[1] for r in picked.collect()}
    chosen = spark.createDataFrame(list(known.items()), "doc_id bigint, label int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in steps(batches, "text"):
            found = features(buf, offs, buckets)
            bags = []
            for d in range(len(offs) - 1):
                own = [b[np.searchsorted(p, offs[d]):np.searchsorted(p, offs[d + 1])] for b, p in found]
                bags.append(np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ints(batch, "doc_id"), pa.array([b.astype(kind).tobytes() for b, _ in bags]), pa.array([(c / max(1, c.sum())).astype("<f4").tobytes() for _, c in bags])], ["doc_id", "bucket", "share"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id").mapInArrow(run, "doc_id bigint, bucket binary, share binary")
    bags = {r[0]: (np.frombuffer(r[1], kind), np.frombuffer(r[2], "<f4")) for r in sample.toLocalIterator()}
    ids = sorted(bags)
    return train([bags[i] for i in ids], np.array([min(1, max(0, known[i])) for i in ids], np.int64), buckets)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns and `score`, the probability of label 1 from the whole text. A null or empty text has no features
    and gets the model's prior; without labels the score is 0.5; repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(buf, offs))], [*own, "score"])

    schema = docs.select(*own, F.lit(0.0).alias("score")).schema
    return docs.select(*own).mapInArrow(run, schema)


def at_least(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs with a score of `least` or more, columns as they are; edge cases are those of `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in steps(batches, "text"):
            yield batch.filter(pa.array(shared.value.scores(buf, offs) >= least))

    return docs.mapInArrow(run, docs.schema)
