"""Ranked lexical search by the Best Position Algorithm over impact lists."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, NOT_ALNUM, Prefix, ints, owners, ranges, segment_sums, stash, steps, text_buffer, words
from tideline.llm.decontamination import blocks

#: Text bytes of the items whose terms are broadcast at once; more items make further blocks.
BLOCK_BYTES = 8 << 20
#: Postings of one set of impact lists in a task.
SHARD_POSTINGS = 3 << 19
#: Positions that the first round reads of each list; every round reads twice as many.
FIRST_DEPTH = 16
#: Parts of 100 of a document's length that count in full; the rest is relative to the mean length.
LENGTH_SHARE = 90


def coded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the lower-cased terms, and n+1 term offsets of the texts."""
    buf = LOWER[buf]
    lo, hi, at = words(buf, offs, NOT_ALNUM)
    return Prefix(buf).of(lo, hi), at


class Queries:
    """Items of a block as sets of term numbers into the block's sorted vocabulary."""

    def __init__(self, items: list, texts: list[str]):
        buf, offs = text_buffer(pa.array(texts, pa.large_string()))
        codes, at = coded(buf, offs)
        self.vocabulary, numbers = np.unique(codes, return_inverse=True)
        self.items = items
        self.terms = [np.unique(numbers[a:b]) for a, b in zip(at[:-1], at[1:])]

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Term number of each code, -1 for terms of no item."""
        if not len(self.vocabulary):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == codes, at, -1)


class ImpactLists:
    """Postings of some documents, once by document and once by term with the greatest impact first."""

    def __init__(self, docs: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        row = owners(ptr)
        order = np.lexsort((docs[row], -impact, term))
        self.docs, self.ptr, self.term, self.impact = docs, ptr, term, impact
        self.listed_row, self.listed_impact = row[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order))
        self.read = np.zeros(len(order), bool)
        self.known = np.zeros(len(docs), bool)
        self.wanted = np.zeros(n_terms, bool)

    def search(self, terms: np.ndarray, best: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int]], int]:
        """`best` merged with the k best (-score, doc_id) here, and the number of documents scored.

        Rounds read the lists in parallel. A document met for the first time is looked up in all lists (direct access),
        which also marks its positions there as seen. The best position of a list ends its unbroken run of seen
        positions; a document not met yet lies behind it in every list, so its score is at most the sum of the next
        impacts. The search ends when that sum is strictly below the k-th score, as an equal score with a smaller
        doc_id would still change the result."""
        lo, hi = self.first[terms], self.first[terms + 1]
        lo, hi = lo[hi > lo], hi[hi > lo]
        seen_to, depth, at = lo.copy(), FIRST_DEPTH, lo.copy()
        self.wanted[terms] = True
        touched, met = [], []
        while (at < hi).any():
            n = np.minimum(depth, hi - at)
            rows = self.listed_row[ranges(at, n)]
            rows = np.unique(rows[~self.known[rows]])
            at, depth = at + n, 2 * depth
            if len(rows):
                self.known[rows] = True
                met.append(rows)
                sizes = self.ptr[rows + 1] - self.ptr[rows]
                cells = ranges(self.ptr[rows], sizes)
                hit = self.wanted[self.term[cells]]
                seen = self.position[cells[hit]]
                self.read[seen] = True
                touched.append(seen)
                scores = segment_sums(np.where(hit, self.impact[cells], 0), np.concatenate([[0], np.cumsum(sizes)]))
                if len(best) >= k:
                    rows, scores = rows[scores >= -best[k - 1][0]], scores[scores >= -best[k - 1][0]]
                if len(rows) > k:
                    top = np.lexsort((self.docs[rows], -scores))[:k]
                    rows, scores = rows[top], scores[top]
                best = sorted(best + list(zip((-scores).tolist(), self.docs[rows].tolist())))[:k]
            bound = 0
            for j in range(len(hi)):
                ahead = self.read[seen_to[j]:hi[j]]
                seen_to[j] += len(ahead) if ahead.all() else int(np.argmin(ahead))
                if seen_to[j] < hi[j]:
                    bound += int(self.listed_impact[seen_to[j]])
            if len(best) >= k and bound < -best[k - 1][0]:
                break
        self.wanted[terms] = False
        for seen in touched:
            self.read[seen] = False
        for rows in met:
            self.known[rows] = False
        return best, sum(map(len, met))


def postings(docs: DataFrame, queries) -> DataFrame:
    """(doc_id, n_terms, terms, counts) of every document: its terms with repeats, and the item terms among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        width = max(len(q.vocabulary), 1)
        for batch, buf, offs in steps(batches, "text"):
            codes, at = coded(buf, offs)
            number = q.find(codes)
            cells, counts = np.unique((owners(at) * width + number)[number >= 0], return_counts=True)
            ptr = np.searchsorted(cells, np.arange(batch.num_rows + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ptr), pa.array(x, pa.int32())) for x in ((cells % width).astype(np.int32), counts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([ints(batch, "doc_id"), pa.array(np.diff(at)), *lists], ["doc_id", "n_terms", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_terms bigint, terms array<int>, counts array<int>")


def weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) if df else 0 for df in frequency], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_all: int, weight: np.ndarray) -> np.ndarray:
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * length * n_docs) // max(n_all, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def candidates(held: DataFrame, queries, weight: np.ndarray, n_docs: int, n_all: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each item in each task; `item` numbers the items of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        best: list[list] = [[] for _ in q.items]

        def searched(parts: list) -> None:
            docs, length, sizes, term, tf = (np.concatenate(x) for x in zip(*parts))
            impact = impacts(tf, np.repeat(length, sizes), n_docs, n_all, weight[term])
            keep = impact > 0
            ptr = np.concatenate([[0], np.cumsum(np.bincount(owners(np.concatenate([[0], np.cumsum(sizes)]))[keep], minlength=len(docs)))])
            lists = ImpactLists(docs, ptr, term[keep], impact[keep], len(q.vocabulary))
            for i, terms in enumerate(q.terms):
                best[i], _ = lists.search(terms, best[i], k)

        parts, have = [], 0
        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            sizes = np.diff(np.asarray(terms.offsets)).astype(np.int64)
            parts.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), sizes, np.asarray(terms.flatten()).astype(np.int64), np.asarray(counts.flatten()).astype(np.int64)))
            have += len(parts[-1][3])
            if have >= SHARD_POSTINGS:
                searched(parts)
                parts, have = [], 0
        if parts:
            searched(parts)
        rows = [(i, doc, -score) for i, found in enumerate(best) for score, doc in found]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return held.where("doc_id is not null and size(terms) > 0").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by doc_id.

    Documents and items are sets of lower-cased ASCII-or-wider alphanumeric terms; a document's score is the sum, over
    the item's distinct terms that it holds, of the term's weight times its saturated, length-normalised count, all in
    whole numbers. The item terms' postings are written once, each task searches its own impact lists, and the tasks'
    k best of an item are merged by a window that keeps k rows of a task before the shuffle.

    Null texts have no terms; documents without a term do not count; repeated rows are documents of their own; rows
    without a doc_id count in all statistics but are never returned; rows of `items` with one item_id are one item (also
    those without an id), an item without terms returns nothing; further columns are not read; an empty table of either
    side gives no rows. Terms are compared by 64-bit codes. Items are broadcast in blocks of `block_bytes` text (or one
    item), each with a pass over the texts of its own.
    """
    spark = docs.sparkSession
    found = None
    texts = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct().groupBy("item_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text"))
    for ids, block in blocks(texts, "item_id", "text", block_bytes):
        queries = spark.sparkContext.broadcast(Queries(ids, block))
        held = stash(postings(docs, queries))
        n_docs, n_all = held.where("n_terms > 0").agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        frequency = np.zeros(len(queries.value.vocabulary), np.int64)
        for term, n in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of a block at most
            frequency[term] = n
        rows = candidates(held, queries, weights(n_docs, frequency), n_docs, n_all, k)
        names = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], f"item bigint, item_id {dict(items.dtypes)['item_id']}")
        rows = rows.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")  # ids of a block at most
        found = rows if found is None else found.unionByName(rows)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d WHERE len(w) > 0),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
scored AS (SELECT item_id, k, CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n_docs) // n_all)))) AS BIGINT) AS score
FROM p JOIN weight USING (term) JOIN q USING (term) JOIN d USING (k), s GROUP BY item_id, k)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN d USING (k) WHERE score > 0 AND doc_id IS NOT NULL) WHERE rank <= 10
"""
