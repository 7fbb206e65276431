"""Bigram language model in a log-frequency Bloom filter, over exact unigram counts."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, WHITE, Prefix, fold, ints, mixed, ranges, segment_sums, shards, stash, steps, words

#: Tokens gathered by a task before it sends their counts.
FLUSH_TOKENS = 5 << 19
#: Most frequent words whose exact counts every task holds; other words' counts are joined.
HEAD_WORDS = 1 << 19
#: Least bits of the filter (32 MB), which every task holds; it grows with the insertions.
FILTER_BITS = 1 << 28
#: Bits of the filter for each insertion; fewer would raise the error rate.
BITS_PER_KEY = 8
HASHES = 4
#: Base of the logarithm that quantises counts.
BASE = 1.5
#: Weight of the bigram estimate, its discount, and the added count of the unigram estimate.
BETA, DISCOUNT, ADDED = 0.4, 0.5, 0.1
END = np.uint64(0xE4D)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 for 1, one more for every factor of BASE."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """Count that stands for a level; 0 for level 0."""
    low = BASE ** (level - 1.0)
    return np.where(level > 0, np.where(level == 1, 1.0, low * (1 + BASE) / 2), 0.0)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the lower-cased words with the end token behind each text, and n+1 offsets."""
    buf = LOWER[buf]
    lo, hi, at = words(buf, offs, WHITE)
    codes = np.insert(Prefix(buf).of(lo, hi), at[1:], END)
    return codes, at + np.arange(len(at))


def bigrams(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (previous, token) for every token, and of the previous token; a text starts behind an end."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[at[:-1]] = END
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + codes), before


class Filter:
    """Log-frequency Bloom filter. A key with level q is inserted as (key, 1) ... (key, q); a probe asks for level 1,
    2, ... until one is absent. Keys belong to segments, each with its own bits."""

    def __init__(self, bits: Sequence[np.ndarray], segments: int):
        self.segments = segments
        self.size = np.array([len(b) * 8 for b in bits], np.uint64)
        self.start = np.cumsum([0] + [len(b) for b in bits])
        self.bits = np.concatenate(list(bits))

    @staticmethod
    def slots(keys: np.ndarray, level: np.ndarray, size: int | np.ndarray) -> list[np.ndarray]:
        h = mixed(keys + level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        g = mixed(h ^ np.uint64(0x165667B19E3779F9)) | np.uint64(1)
        return [(((h + np.uint64(i) * g) >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64) for i in range(HASHES)]

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Level of every key, by repeated membership probes."""
        segment = segment_of(keys, self.segments)
        level, on, at = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        size, start = self.size[segment], self.start[segment]
        while len(on):
            here = np.ones(len(on), bool)
            for slot in self.slots(keys[on], np.full(len(on), at), size[on]):
                here &= (self.bits[start[on] + (slot >> 3)] >> (slot & 7).astype(np.uint8)) & 1 > 0
            on = on[here]
            level[on] = at
            at += 1
        return level


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def filled(words_: tuple, pairs: tuple, least: int) -> np.ndarray:
    """Bits of one segment from (keys, counts) of words and of bigrams: BITS_PER_KEY for each insertion, `least` at least.
    All keys enter at all their levels."""
    both = [(keys, levels(counts)) for keys, counts in (words_, pairs)]
    bits = np.zeros((max(least, BITS_PER_KEY * sum(int(level.sum()) for _, level in both)) + 7) // 8, np.uint8)
    size = len(bits) * 8
    for keys, level in both:
        each = ranges(np.ones(len(level), np.int64), level)
        for slot in Filter.slots(np.repeat(keys, level), each, size):
            np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    return bits


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(docs: DataFrame, segments: int) -> DataFrame:
    """Packed (segment, key, count) columns of n-gram counts, summed within tasks: order 1 has word codes, order 2 bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, held = [], [], 0

        def rows():
            for order, parts in ((1, one), (2, two)):
                all_ = np.concatenate(parts)
                keys, counts = summed(all_, np.ones(len(all_), np.int64))
                segment = segment_of(keys, segments)
                by = np.argsort(segment, kind="stable")
                cut = np.searchsorted(segment[by], np.arange(segments + 1))
                keys, counts = keys[by], counts[by]
                many = np.flatnonzero(counts > 1)  # most are 1 and are not sent
                where = np.searchsorted(many, cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(segments, order, np.int32)), pa.array(np.arange(segments, dtype=np.int32)),
                    pa.array([keys[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([(many[a:b] - lo).astype("<u4").tobytes() for a, b, lo in zip(where, where[1:], cut)], pa.binary()),
                    pa.array([counts[many[a:b]].astype("<u4").tobytes() for a, b in zip(where, where[1:])], pa.binary())],
                    ["order", "segment", "keys", "many", "counts"])

        for _, buf, offs in steps(batches, "text"):
            codes, at = tokens(buf, offs)
            one.append(codes)
            two.append(bigrams(codes, at)[0])
            held += len(codes)
            if held > FLUSH_TOKENS:
                yield from rows()
                one, two, held = [], [], 0
        if held:
            yield from rows()

    return docs.select("text").mapInArrow(run, "order int, segment int, keys binary, many binary, counts binary")


def unpacked(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for k, m, c in zip(parts["keys"], parts["many"], parts["counts"]):
        keys.append(np.frombuffer(k, np.uint64))
        n = np.ones(len(keys[-1]), np.int64)
        n[np.frombuffer(m, "<u4")] = np.frombuffer(c, "<u4")
        counts.append(n)
    return summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Model:
    """What every task holds: the filter, N and V, and the exact counts of the most frequent words."""

    def __init__(self, ngrams: Filter, total: int, distinct: int, head: np.ndarray, head_counts: np.ndarray):
        order = np.argsort(head)
        self.ngrams, self.total, self.distinct, self.head, self.head_counts = ngrams, total, distinct, head[order], head_counts[order]

    def log_unigram(self, counts):
        return np.log10((counts + ADDED) / (self.total + ADDED * (self.distinct + 1)))

    def exact(self, codes: np.ndarray) -> np.ndarray:
        """Counts of the codes in the head table, 0 elsewhere."""
        at = np.searchsorted(self.head, codes)
        at[at == len(self.head)] = 0
        return np.where(self.head[at] == codes, self.head_counts[at], 0) if len(self.head) else np.zeros(len(codes), np.int64)

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P(token | token before): BETA * (c(pair) - DISCOUNT) / c(before) + (1 - BETA) * unigram estimate, with
        quantised counts from membership probes alone. The estimates of a history sum to at most 1."""
        pairs, before = bigrams(codes, at)
        kinds, which = np.unique(codes, return_inverse=True)
        count = middle(self.ngrams.count(kinds))
        history = np.empty(len(codes))
        history[1:] = count[which[:-1]]
        history[at[:-1]] = middle(self.ngrams.count(np.array([END])))[0]
        pair = np.minimum(middle(self.ngrams.count(pairs)), history)
        seen = np.maximum(pair - DISCOUNT, 0) / np.maximum(history, 1)
        return np.log10(BETA * seen + (1 - BETA) * 10 ** self.log_unigram(count)[which])


def fit(docs: DataFrame, filter_bits: int = FILTER_BITS, head_words: int = HEAD_WORDS) -> tuple[Model, DataFrame]:
    """Counts the n-grams of docs(text) and returns the model and the table (code, count) of all words.

    Every task sums the counts of its texts, then every segment of the keys sums those of all tasks and writes its own
    bits. The filter has `filter_bits` at least and more where the insertions need it, so that every n-gram is in it; the
    head table has a fixed size, and words outside the head are looked up in the table."""
    spark = docs.sparkSession
    segments = shards(spark)
    share = max(64, filter_bits // segments // 8 * 8)

    def segment(parts: pd.DataFrame) -> pd.DataFrame:
        one, two = (unpacked(parts[parts["order"] == k]) for k in (1, 2))
        n = len(one[0])
        return pd.DataFrame({  # the words' rows, then the row of the bits
            "code": pd.array(np.append(one[0].view(np.int64), 0), "Int64"), "count": pd.array(np.append(one[1], 0), "Int64"),
            "segment": pd.array(np.full(n + 1, parts["segment"].iloc[0]), "Int64"), "bits": [None] * n + [filled(one, two, share).tobytes()]})

    made = stash(counted(docs, segments).groupBy("segment").applyInPandas(segment, "code bigint, count bigint, segment bigint, bits binary"))
    ones = made.where("bits is null").select("code", "count")
    bits = [np.zeros(share // 8, np.uint8)] * segments
    for row in made.where("bits is not null").select("segment", "bits").toLocalIterator():
        bits[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    level = F.floor(F.log2("count"))
    by_level = sorted(((r["level"], r["n"], r["total"]) for r in ones.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("count").alias("total")).collect()), reverse=True)
    size, least = 0, 99
    for lv, n, _ in by_level:  # powers of two of the counts, at most 63 rows
        size += n
        if size > head_words:
            break
        least = lv
    head = ones.where(level >= least).toPandas()
    model = Model(Filter(bits, segments), sum(t for *_, t in by_level), sum(n for _, n, _ in by_level), head["code"].to_numpy(np.int64).view(np.uint64), head["count"].to_numpy(np.int64))
    return model, ones


def score(docs: DataFrame, folds: int = 10, filter_bits: int = FILTER_BITS, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and the model's log10 probability.

    The model learns from the rows whose crc32(doc_id) modulo `folds` is not 0 (a null doc_id is held out). A null text
    is empty and has the end token alone; repeated rows are learned and scored each; with an empty table, or none to
    learn from, every token is unknown. Words are compared by 64-bit codes. Other columns are ignored.
    """
    held = fold("doc_id", folds) == 0
    model, ones = fit(docs.where(~held), filter_bits, head_words)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, buf, offs in steps(batches, "text"):
            codes, at = tokens(buf, offs)
            exact = m.exact(codes)
            known = exact > 0
            rare = ~known
            rare_at = np.concatenate([[0], np.cumsum(rare)])[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ints(batch, "doc_id"), batch.column(batch.schema.get_field_index("held_out")), pa.array(np.diff(at)), pa.array(segment_sums(known.astype(np.int64), at)),
                pa.array(segment_sums(np.where(known, m.log_unigram(exact), 0.0), at)), pa.array(segment_sums(m.log_probabilities(codes, at), at)),
                pa.ListArray.from_arrays(pa.array(rare_at), pa.array(codes[rare].view(np.int64)))], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    first = docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>")
    first = stash(first.withColumn("row", F.monotonically_increasing_id()))
    unigram = F.log10((F.coalesce("count", F.lit(0)) + ADDED) / (model.total + ADDED * (model.distinct + 1)))
    rest = first.select("row", F.explode("rare").alias("code")).groupBy("row", "code").count().withColumnRenamed("count", "times").join(ones, "code", "left")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * unigram).alias("base_rest"), F.sum(F.when(F.col("count").isNotNull(), F.col("times")).otherwise(0)).alias("known_rest"))
    both = first.join(rest, "row", "left")
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
                       (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"), "score")
