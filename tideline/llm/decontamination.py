"""Benchmark decontamination over suffix arrays of the training text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, NOT_ALNUM, Prefix, bundled, mixed, ranges, steps, text_buffer, unbundled, words

#: Text bytes of the items that are broadcast at once; more items make further blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of training text in one suffix array.
SHARD_BYTES = 4 << 20
_BITS = 20


def coded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes (never 0) of the lower-cased words, and word offsets of the texts."""
    buf = LOWER[buf]
    lo, hi, at = words(buf, offs, NOT_ALNUM)
    return Prefix(buf).of(lo, hi) | np.uint64(1), at


def suffix_rows(codes: np.ndarray, at: np.ndarray, keep: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` words of the suffixes at `keep`, 0 behind a text's end; one column for each word."""
    ends = at[1:][np.searchsorted(at, keep, "right") - 1]
    padded = np.concatenate([codes, np.zeros(depth, np.uint64)])
    return np.stack([np.where(keep + j < ends, padded[keep + j], np.uint64(0)) for j in range(depth)])


class Probes:
    """All distinct windows of a block of items, longest first word by word, and the items of each."""

    def __init__(self, items: list[int], texts: list[str], window: int):
        self.window = window
        buf, offs = text_buffer(pa.array(texts, pa.large_string()))
        codes, at = coded(buf, offs)
        n = np.diff(at)
        size = np.minimum(n, window)
        starts = ranges(at[:-1], np.maximum(n - size + 1, 0) * (n > 0))
        owner = np.repeat(np.arange(len(items)), np.maximum(n - size + 1, 0) * (n > 0))
        rows = suffix_rows(codes, at, starts, window)
        rows[:, :] = np.where(np.arange(window)[:, None] < size[owner], rows, 0)
        order = np.lexsort(rows[::-1])
        rows, owner = rows[:, order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        self.rows = rows[:, new]
        self.size = (self.rows != 0).sum(axis=0)
        named = np.array([i is not None for i in items], bool)[owner]
        ids = np.array([i or 0 for i in items], np.int64)[owner]
        pairs = np.unique(np.stack([(np.cumsum(new) - 1)[named], ids[named]]), axis=1) if named.any() else np.zeros((2, 0), np.int64)
        self.items, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(self.rows.shape[1] + 1))
        self.heads = np.zeros(1 << _BITS, bool)
        self.heads[self.head(self.rows[:2])[self.size > 1]] = True
        self.singles = np.unique(self.rows[0][self.size == 1])

    @staticmethod
    def head(two: np.ndarray) -> np.ndarray:
        return (mixed(two[0] * np.uint64(3) + two[1]) >> np.uint64(64 - _BITS)).astype(np.int64)

    def search(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and probe numbers of all occurrences, by binary search in the suffix array of the texts.
        The array holds the suffixes whose first two words open some probe; no other suffix can match."""
        none = np.zeros(0, np.int64)
        if not len(codes) or not len(self.size):
            return none, none
        follow = np.concatenate([codes[1:], np.zeros(1, np.uint64)])
        near = self.heads[self.head(np.stack([codes, follow]))]
        if len(self.singles):
            near |= np.isin(codes, self.singles)
        array = np.flatnonzero(near)
        if not len(array):
            return none, none
        rows = suffix_rows(codes, at, array, self.window)
        order = np.lexsort(rows[::-1])
        array, rows = array[order], rows[:, order]
        lo, hi = np.zeros(len(self.size), np.int64), np.full(len(self.size), len(array))
        for j in range(self.window):
            on = np.flatnonzero((self.size > j) & (lo < hi))
            if not len(on):
                break
            lo[on], hi[on] = self.bound(rows[j], lo[on], hi[on], self.rows[j][on], False), self.bound(rows[j], lo[on], hi[on], self.rows[j][on], True)
        n = np.maximum(hi - lo, 0)
        return array[ranges(lo, n)], np.repeat(np.arange(len(n)), n)

    @staticmethod
    def bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            seen = column[np.minimum(mid, len(column) - 1)]
            up = open_ & ((seen <= want) if right else (seen < want))
            lo = np.where(up, mid + 1, lo)
            hi = np.where(open_ & ~up, mid, hi)
        return lo


def blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for row in items.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def matches(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with its verbatim matches: docs' columns, n_words, `hits` (array of maximal [start, end) word
    ranges covered by occurrences of item windows) and `items` (sorted ids of the items with an occurring window).

    A window is `window` consecutive words of an item; an item of fewer words is one window. Null texts have no words,
    repeated rows are matched each for itself, items with the same text count each, the windows of an item without an id count but
    name no item, an empty table of either side
    matches nothing, and other columns pass through (`n_words`, `hits` and `items` are replaced). The items are
    broadcast in blocks of `block_bytes` text at most, each searched by its own step over the documents.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    found = docs.select(*own, F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<array<bigint>>)").alias("hits"), F.expr("cast(array() as array<bigint>)").alias("items"))
    schema = found.schema
    for ids, texts in blocks(items, "item_id", "text", block_bytes):
        probes = spark.sparkContext.broadcast(Probes(ids, texts, window))

        def run(batches: Iterator[pa.RecordBatch], probes=probes) -> Iterator[pa.RecordBatch]:
            p = probes.value
            for batch, buf, offs in steps(batches, "text", SHARD_BYTES):
                codes, at = coded(buf, offs)
                pos, probe = p.search(codes, at)
                hits = batch.column(batch.schema.get_field_index("hits")).to_pylist()
                known = batch.column(batch.schema.get_field_index("items")).to_pylist()
                if len(pos):
                    doc = np.searchsorted(at, pos, "right") - 1
                    cover = np.zeros(len(codes) + 1, np.int64)
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + p.size[probe], -1)
                    inside = np.cumsum(cover) > 0
                    for d in np.unique(doc):
                        mask = inside[at[d]:at[d + 1]].copy()
                        for a, b in hits[d]:
                            mask[a:b] = True
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                        hits[d] = edges.reshape(-1, 2).tolist()
                        own_probes = np.unique(probe[doc == d]) if len(hits) > 1 else np.unique(probe)
                        counts = p.first[own_probes + 1] - p.first[own_probes]
                        known[d] = sorted(set(known[d]) | set(p.items[ranges(p.first[own_probes], counts)].tolist()))
                columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
                columns |= {"n_words": pa.array(np.diff(at)), "hits": pa.array(hits, pa.list_(pa.list_(pa.int64()))), "items": pa.array(known, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        found = found.mapInArrow(run, schema)
    return found


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents with no word inside an occurrence of an item window, with their own columns."""
    return unbundled(matches(bundled(docs), items, window).where(F.size("hits") == 0), docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """Contract columns of the query from `matches`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
occ AS (SELECT k, i, size, item_id FROM (SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM pos) JOIN win USING (size, g)),
hit AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT k, i, size FROM occ)) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS name FROM occ) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN it USING (k)
"""
