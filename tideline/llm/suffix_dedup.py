"""Exact substring deduplication with run-length Burrows-Wheeler indexes of the passages that documents share."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import STEP_BYTES, Prefix, bundled, ints, mixed, ranges, shards, stash, steps, unbundled

#: Bytes of a repeated string; bytes of an anchor; what an anchor's surroundings hold on either side.
LENGTH, ANCHOR = 50, 20
SIDE = LENGTH - ANCHOR
#: Bytes of text whose anchors a task gathers before it sends them.
FLUSH_BYTES = 8 << 20
FULL, TEXT = 1, 2
#: Strings of an index, and strings that stream through it at once.
STRINGS = 4096


def slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width], for every i with that many elements."""
    done, have = x, 1
    while 2 * have <= width:
        done = op(done[:-have], done[have:])
        have *= 2
    return op(done[:len(x) - width + 1], done[width - have:][:len(x) - width + 1]) if have < width else done


def anchors(prefix: Prefix, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and codes of the anchors: ANCHOR bytes whose code is least in some LENGTH bytes of a document. Equal
    strings of LENGTH bytes have their anchors at equal places."""
    n = int(offs[-1])
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < LENGTH:
        return none
    at = np.arange(n - ANCHOR + 1)
    code = prefix.of(at, at + ANCHOR) | np.uint64(1)
    least = slide(code, SIDE + 1, np.minimum)  # of the string that starts here
    ends = np.repeat(offs[1:], np.diff(offs))[:len(least)]
    least[at[:len(least)] + LENGTH > ends] = 0
    around = np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)])
    pos = np.flatnonzero(slide(around, SIDE + 1, np.maximum) == code)
    return pos, code[pos]


def surroundings(prefix: Prefix, offs: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, byte range and code of each anchor's surroundings within its document."""
    doc = np.searchsorted(offs, pos, "right") - 1
    lo, hi = np.maximum(pos - SIDE, offs[doc]), np.minimum(pos + LENGTH, offs[doc + 1])
    return doc, lo, hi, mixed(prefix.of(lo, hi) + (pos - lo).astype(np.uint64))


def halves(prefix: Prefix, offs: np.ndarray, pos: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """16-bit codes (0 for none) of the anchor with SIDE // 2 bytes before it, and with as many behind it. LENGTH bytes
    around an anchor hold one of these two."""
    out = np.zeros((len(pos), 2), np.uint16)
    for k, (lo, hi) in enumerate(((pos - SIDE // 2, pos + ANCHOR), (pos, pos + ANCHOR + SIDE // 2))):
        ok = np.flatnonzero((lo >= offs[doc]) & (hi <= offs[doc + 1]))
        out[ok, k] = (prefix.of(lo[ok], hi[ok]) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return out


def shard_of(code: np.ndarray, parts: int) -> np.ndarray:
    return ((code >> np.uint64(48)) % np.uint64(parts)).astype(np.int64)


def six(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def gathered(docs: DataFrame, parts: int) -> DataFrame:
    """Packed anchors by shard of their code: documents, their anchors' number, and codes of anchors and surroundings.
    Of equal surroundings in a task only the smallest document's are sent; the others' are known to be copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = entries = 0

        def rows():
            code, around, doc, row, entry, half = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, around, code))
            c, a = code[order], around[order]
            first = np.concatenate([[True], (c[1:] != c[:-1]) | (a[1:] != a[:-1])]) if len(c) else np.zeros(0, bool)
            least = np.repeat(doc[order][first], np.diff(np.append(np.flatnonzero(first), len(c))))
            sent = np.empty(len(code), bool)
            sent[order] = doc[order] == least
            shard = shard_of(code, parts)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(parts + 1))
            for s in range(parts):
                own = order[cut[s]:cut[s + 1]]
                if not len(own):
                    continue
                d, r, e, put = doc[own], row[own], entry[own], sent[own]
                start = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))  # a repeated row has an entry for each copy
                yield pa.RecordBatch.from_arrays([
                    pa.array([s], pa.int32()), pa.array([d[start].tobytes()]), pa.array([r[start].tobytes()]), pa.array([np.diff(np.append(start, len(own))).astype("<u4").tobytes()]),
                    pa.array([np.packbits(put).tobytes()]), pa.array([six(code[own][put])]), pa.array([six(around[own][put])]), pa.array([half[own][put].tobytes()])],
                    ["shard", "docs", "rows", "counts", "sent", "codes", "around", "halves"])

        for batch, buf, offs in steps(batches, "text", STEP_BYTES // 2):
            prefix = Prefix(buf)
            pos, code = anchors(prefix, offs)
            doc, _, _, around = surroundings(prefix, offs, pos)
            held.append((code, around, ints(batch, "doc_id").to_numpy(zero_copy_only=False)[doc], ints(batch, "row").to_numpy(zero_copy_only=False)[doc], entries + doc, halves(prefix, offs, pos, doc)))
            size += len(buf)
            entries += batch.num_rows
            if size > FLUSH_BYTES:
                yield from rows()
                held, size = [], 0
        if held:
            yield from rows()

    return docs.mapInArrow(run, "shard int, docs binary, rows binary, counts binary, sent binary, codes binary, around binary, halves binary")


def marked(parts: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """A shard's anchors (by rank there) that are FULL copies of a smaller document's surroundings, and those that are
    first of their kind while other documents have the anchor and half of the surroundings (TEXT): packed by document
    (row), and a row for each bucket of documents. The copies of a repeated row have equal marks, and only one of them is
    returned."""
    docs = [np.frombuffer(x, np.int64) for x in parts["docs"]]
    rows = [np.frombuffer(x, np.int64) for x in parts["rows"]]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in parts["counts"]]).astype(np.int64)
    sizes = [int(np.frombuffer(x, "<u4").sum()) for x in parts["counts"]]
    sent = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(parts["sent"], sizes)]).astype(bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    doc_of = np.concatenate(docs)
    code, around = (np.concatenate([unsix(x) for x in parts[c]]) for c in ("codes", "around"))
    doc = doc_of[owner[sent]]
    order = np.lexsort((doc, around, code))
    c, a, d = code[order], around[order], doc[order]
    new_code = np.concatenate([[True], c[1:] != c[:-1]])[:len(c)]
    new = new_code | np.concatenate([[True], a[1:] != a[:-1]])[:len(c)]
    start = np.flatnonzero(new)
    first = np.repeat(d[start], np.diff(np.append(start, len(c))))  # smallest document of equal surroundings
    value = np.zeros(len(c), np.uint8)
    value[order] = np.where(d > first, FULL, 0)
    half = np.concatenate([np.frombuffer(x, np.uint16) for x in parts["halves"]]).reshape(-1, 2)[order]
    head = np.flatnonzero(new_code)
    several = np.repeat(np.minimum.reduceat(first, head) != np.maximum.reduceat(first, head), np.diff(np.append(head, len(c)))) if len(c) else np.zeros(0, bool)
    for k in (0, 1):
        own = np.flatnonzero(several & (d == first) & (half[:, k] > 0))
        if not len(own):
            continue
        same = mixed(c[own] * np.uint64(2) + np.uint64(k)) ^ half[own, k].astype(np.uint64)
        by = np.argsort(same)
        at = np.flatnonzero(np.concatenate([[True], same[by][1:] != same[by][:-1]]))
        docs_ = d[own][by]
        shared_ = np.repeat(np.minimum.reduceat(docs_, at) != np.maximum.reduceat(docs_, at), np.diff(np.append(at, len(own))))
        value[order[own[by[shared_]]]] = TEXT
    value_all = np.full(len(owner), FULL, np.uint8)
    value_all[sent] = value
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = np.flatnonzero(value_all)
    cut = np.flatnonzero(np.concatenate([[True], owner[keep][1:] != owner[keep][:-1]])) if len(keep) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(keep))
    rank, value_all = rank[keep].astype("<u4"), value_all[keep]
    row, one = np.unique(np.concatenate(rows)[owner[keep][cut]], return_index=True)
    bucket = row % buckets
    order = np.argsort(bucket, kind="stable")
    row, bucket, cut, n = row[order], bucket[order], cut[one][order], (ends - cut)[one][order]
    own = ranges(cut, n)
    rank, value_all, at = rank[own], value_all[own], np.concatenate([[0], np.cumsum(n)])
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(row) else np.zeros(0, np.int64)
    pieces = list(zip(edge, np.append(edge[1:], len(row))))
    return pd.DataFrame({
        "bucket": bucket[edge], "shard": parts["shard"].iloc[0], "rows": [row[x:y].tobytes() for x, y in pieces], "counts": [n[x:y].astype("<u4").tobytes() for x, y in pieces],
        "ranks": [rank[at[x]:at[y]].tobytes() for x, y in pieces], "marks": [value_all[at[x]:at[y]].tobytes() for x, y in pieces]})


def merged(parts: pd.DataFrame) -> pd.DataFrame:
    """One row a document: the shards that mark it, how many of its anchors each of them marks, and those."""
    row, n, rank, value = (np.concatenate([np.frombuffer(x, t) for x in parts[c]]) for c, t in (("rows", np.int64), ("counts", "<u4"), ("ranks", "<u4"), ("marks", np.uint8)))
    shard = np.repeat(parts["shard"].to_numpy(), [len(x) // 8 for x in parts["rows"]]).astype("<u4")
    n = n.astype(np.int64)
    order = np.argsort(row, kind="stable")
    own = ranges((np.cumsum(n) - n)[order], n[order])
    row, shard, n, rank, value = row[order], shard[order], n[order], rank[own], value[own]
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    pieces = list(zip(first, np.append(first[1:], len(row))))
    n = n.astype("<u4")
    return pd.DataFrame({
        "row": row[first], "shards": [shard[x:y].tobytes() for x, y in pieces], "counts": [n[x:y].tobytes() for x, y in pieces],
        "ranks": [rank[at[x]:at[y]].tobytes() for x, y in pieces], "marks": [value[at[x]:at[y]].tobytes() for x, y in pieces]})


MARKS = "row bigint, shards binary, counts binary, ranks binary, marks binary"


def marks(docs: DataFrame, parts: int) -> DataFrame:
    """MARKS of docs(doc_id, row, text). Shards and buckets exchange one packed row each, whatever documents they share."""
    found = gathered(docs, parts).groupBy("shard").applyInPandas(lambda pdf: marked(pdf, parts), "bucket int, shard int, rows binary, counts binary, ranks binary, marks binary")
    return found.groupBy("bucket").applyInPandas(merged, MARKS)


def packed(batch: pa.RecordBatch, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and how many each row has."""
    column = batch.column(batch.schema.get_field_index(name)).fill_null(b"").cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = data[offs[0]:offs[-1]].to_pybytes() if data is not None else b""
    return np.frombuffer(raw, kind), np.diff(offs) // np.dtype(kind).itemsize


def applied(batch: pa.RecordBatch, doc: np.ndarray, code: np.ndarray, parts: int) -> np.ndarray:
    """The mark of each anchor (document in the batch and code) of a batch with MARKS."""
    out = np.zeros(len(code), np.uint8)
    shards_, n = packed(batch, "shards", "<u4")
    if not len(shards_):
        return out
    counts, rank, value = (packed(batch, c, t)[0] for c, t in (("counts", "<u4"), ("ranks", "<u4"), ("marks", np.uint8)))
    slot = doc * parts + shard_of(code, parts)
    order = np.argsort(slot, kind="stable")
    start = np.searchsorted(slot[order], np.repeat(np.arange(len(n)), n) * parts + shards_)
    out[order[np.repeat(start, counts) + rank]] = value
    return out


class RunIndex:
    """Run-length Burrows-Wheeler transform of many strings with the text position of both ends of every run, and for each
    text position the smallest document with the LENGTH bytes that start there."""

    def __init__(self, strings: list[bytes], docs: np.ndarray, length: int = LENGTH):
        at = np.cumsum([0] + [len(s) + 1 for s in strings])
        text = np.zeros(at[-1], np.int64)
        text[ranges(at[:-1], np.diff(at) - 1)] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        n = len(text)
        self.text, self.length = text, length
        ordered = text + len(strings)
        ordered[at[1:] - 1] = np.arange(len(strings))  # ends differ, so that no two suffixes are equal
        base = int(ordered.max()) + 2
        packed, have = ordered, 1
        while have < length and base ** (have + 1) < 1 << 63:  # as many first symbols as a number holds
            packed = packed * base
            packed[:n - have] += ordered[have:] + 1
            have += 1
        at_length, rank = self.sorted_suffixes(packed, have, length)
        suffix, _ = self.sorted_suffixes(rank, length, max(length, int(np.diff(at).max())))
        before = text[suffix - 1]
        start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.start, self.symbol = start, before[start]
        size = np.diff(np.append(start, n))
        self.low, self.high = suffix[start], suffix[start + size - 1]
        by_symbol = np.argsort(self.symbol, kind="stable")
        base = np.empty(len(start), np.int64)
        base[by_symbol] = np.cumsum(size[by_symbol]) - size[by_symbol]  # rows of the symbols before, and of the same one above
        self.base, self.runs = base, len(start)
        self.keys = self.symbol[by_symbol] * (self.runs + 1) + by_symbol
        self.by_symbol, self.size = by_symbol, size
        doc = np.repeat(docs, np.diff(at))[at_length]
        heads = np.flatnonzero(np.concatenate([[True], rank[at_length][1:] != rank[at_length][:-1]]))
        self.smallest = np.empty(n, np.int64)
        self.smallest[at_length] = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, n)))

    @staticmethod
    def sorted_suffixes(rank: np.ndarray, have: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes by their first `depth` symbols, and the rank of each, equal for equal ones. `rank` orders them by
        `have` symbols; each step doubles that."""
        n = len(rank)

        def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(key)
            out = np.empty(n, np.int64)
            out[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            return order, out

        order, rank = ranked(rank)
        while have < depth:
            step = min(have, depth - have)
            both = rank * (int(rank.max()) + 2)
            both[:n - step] += rank[step:] + 1
            order, rank = ranked(both)
            have += step
        return order, rank

    def lce(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common symbols of the text from x and from y, `most` at most."""
        same, on, j = np.zeros(len(x), np.int64), np.arange(len(x)), 0
        while len(on):
            on = on[(most[on] > j) & (x[on] + j < len(self.text)) & (y[on] + j < len(self.text))]
            on = on[self.text[x[on] + j] == self.text[y[on] + j]]
            same[on] += 1
            j += 1
        return same

    def matching_statistics(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For every position of the strings (right-aligned columns): the longest match with the index, and where.
        All strings stream from right to left at once. A symbol that the row's run lacks makes the row jump to the end
        of the nearest run above or below that has it, whichever keeps the longer match."""
        width = max(map(len, strings), default=0)
        query = np.zeros((len(strings), width), np.int64)
        for i, s in enumerate(strings):
            query[i, width - len(s):] = np.frombuffer(s, np.uint8).astype(np.int64) + 1
        row, long_, place = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64), np.full(len(strings), self.low[0])
        lengths, places = np.zeros((2, *query.shape), np.int64)
        for col in range(width - 1, -1, -1):
            c = query[:, col]
            run = np.searchsorted(self.start, row, "right") - 1
            off = np.flatnonzero((self.symbol[run] != c) & (c > 0))
            if len(off):
                at = np.searchsorted(self.keys, c[off] * (self.runs + 1) + run[off])
                best, best_row, best_place = np.full(len(off), -1), row[off].copy(), place[off].copy()
                for near, end in ((at - 1, True), (at, False)):
                    r = self.by_symbol[np.clip(near, 0, self.runs - 1)]
                    ok = (near >= 0) & (near < self.runs) & (self.symbol[r] == c[off])
                    sample = self.high[r] if end else self.low[r]
                    keep = np.where(ok, self.lce(place[off], sample, np.where(ok, long_[off], 0)), -1)
                    better = keep > best
                    best = np.where(better, keep, best)
                    best_row = np.where(better, self.start[r] + (self.size[r] - 1 if end else 0), best_row)
                    best_place = np.where(better, sample, best_place)
                row[off], place[off], long_[off] = best_row, best_place, np.where(best >= 0, best, -1)
                run[off] = np.searchsorted(self.start, row[off], "right") - 1
            on = (c > 0) & (long_ >= 0)
            row = np.where(on, self.base[run] + row - self.start[run], row)
            place = np.where(on, place - 1, place)
            long_ = np.where(on, long_ + 1, 0)
            lengths[:, col], places[:, col] = long_, place
        return lengths, places


def covered_by_smaller(parts: pd.DataFrame) -> pd.DataFrame:
    """Starts [start, stop) of the LENGTH bytes within the shard's surroundings that a smaller document's have too. Anchors
    with different codes share none, so the shard is indexed in runs of about STRINGS strings that end between two codes.
    A code's largest document is smaller than none and its smallest has none below: the one is not indexed, the other not
    looked up."""
    parts = parts.sort_values("code", kind="stable")
    code, doc, row, begin = (parts[c].to_numpy(np.int64) for c in ("code", "doc_id", "row", "start"))
    strings = parts["around"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    n = np.diff(np.append(first, len(code)))
    low, high = (np.repeat(op.reduceat(doc, first), n) for op in (np.minimum, np.maximum))
    kept, asked = np.flatnonzero(doc < high), np.flatnonzero(doc > low)
    last = np.append(first[1:], len(code))  # ends of the codes
    ends = np.searchsorted(kept, last)  # of their strings in the index
    out, at = [], 0
    while at < len(kept):
        k = int(np.searchsorted(ends, min(at + STRINGS, len(kept))))
        to = int(ends[k])
        own = kept[at:to]
        _, one = np.unique(np.stack([code[own], doc[own], np.array([hash(s) for s in strings[own]])]), axis=1, return_index=True)
        index = RunIndex(list(strings[own][one]), doc[own][one])
        lo, hi = np.searchsorted(asked, [first[np.searchsorted(last, own[0], "right")], last[k]])
        for a in range(lo, hi, STRINGS):
            own = asked[a:min(a + STRINGS, hi)]
            lengths, places = index.matching_statistics(list(strings[own]))
            size = np.array([len(s) for s in strings[own]])
            hit = (lengths >= LENGTH) & (index.smallest[places] < doc[own, None])
            edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
            i, start = np.nonzero(edge > 0)
            _, stop = np.nonzero(edge < 0)
            far = begin[own][i] - (lengths.shape[1] - size[i])
            out.append(pd.DataFrame({"row": row[own][i], "start": far + start, "stop": far + stop}).drop_duplicates())
        at = to
    return pd.concat(out) if out else pd.DataFrame({"row": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "stop": np.zeros(0, np.int64)})


def shared(docs: DataFrame, finish=None, schema: str = "doc_id bigint, row bigint, text string, spans array<array<bigint>>") -> DataFrame:
    """doc_id, text, `spans` of every row: the maximal byte ranges [start, end) that lie in LENGTH-byte strings which also start
    in a document with a smaller doc_id. `finish(batch, text bytes, offsets, spans)` makes a batch of another `schema` of
    them in the same worker, so that the texts need not pass through a second one.

    Equal strings have an anchor at the same place, so anchors with equal codes bring all candidates together. Where the
    surroundings are equal too, all of them are repeated; otherwise one copy of each kind goes to a run-length index of
    the shard, and the surroundings' matching statistics against it give the repeated part."""
    spark = docs.sparkSession
    parts = shards(spark)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    usable = own.where(F.col("doc_id").isNotNull())
    both = own.join(stash(marks(usable.select("doc_id", "row", "text"), parts)), "row", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in steps(batches, "text", STEP_BYTES // 2):
            prefix = Prefix(buf)
            pos, code = anchors(prefix, offs)
            doc, lo, hi, _ = surroundings(prefix, offs, pos)
            pick = np.flatnonzero(applied(batch, doc, code, parts) == TEXT)
            raw = buf.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(shard_of(code[pick], parts).astype(np.int32)), pa.array(code[pick].view(np.int64)), ints(batch, "doc_id").take(pa.array(doc[pick])), ints(batch, "row").take(pa.array(doc[pick])),
                pa.array(lo[pick] - offs[doc[pick]]), pa.array([raw[a:b] for a, b in zip(lo[pick], hi[pick])], pa.binary())], ["shard", "code", "doc_id", "row", "start", "around"])

    pieces = both.mapInArrow(texts, "shard int, code bigint, doc_id bigint, row bigint, start bigint, around binary")
    partly = pieces.groupBy("shard").applyInPandas(covered_by_smaller, "row bigint, start bigint, stop bigint").groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in steps(batches, "text", STEP_BYTES // 2):
            prefix = Prefix(buf)
            pos, code = anchors(prefix, offs)
            doc, lo, hi, _ = surroundings(prefix, offs, pos)
            full = np.flatnonzero(applied(batch, doc, code, parts) == FULL)
            full = full[hi[full] - lo[full] >= LENGTH]
            begin, end = [lo[full]], [hi[full]]
            for name, ends, more in (("starts", begin, 0), ("stops", end, LENGTH - 1)):
                column = batch.column(batch.schema.get_field_index(name))
                n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends.append(np.repeat(offs[:-1], n) + column.flatten().to_numpy(zero_copy_only=False) + more)
            cover = np.bincount(np.concatenate(begin), minlength=len(buf) + 1) - np.bincount(np.concatenate(end), minlength=len(buf) + 1)
            inside = np.cumsum(cover[:-1]) > 0
            out = [np.flatnonzero(np.diff(np.concatenate([[0], inside[a:b].view(np.int8), [0]]))).reshape(-1, 2).tolist() for a, b in zip(offs[:-1], offs[1:])]
            if finish is not None:
                yield finish(batch, buf, offs, out)
                continue
            yield pa.RecordBatch.from_arrays([ints(batch, "doc_id"), ints(batch, "row"), batch.column(batch.schema.get_field_index("text")), pa.array(out, pa.list_(pa.list_(pa.int64())))], ["doc_id", "row", "text", "spans"])

    return both.join(partly, "row", "left").mapInArrow(spans, schema)


def kept_bytes(text: bytes, spans: list) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, from its spans."""

    def run(batch: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, spans: list) -> pa.RecordBatch:
        raw = buf.tobytes()
        return pa.RecordBatch.from_arrays([
            ints(batch, "doc_id"), pa.array(np.diff(offs)), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
            pa.array([hashlib.sha256(kept_bytes(raw[a:b], s)).hexdigest() for a, b, s in zip(offs, offs[1:], spans)])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return shared(docs, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the shared bytes cut out of their texts (a character cut in half leaves a replacement character). A null
    text stays null and is no source; rows with a null doc_id stay whole and are no source; repeated rows are cut alike;
    other columns stay as they are, whatever their names."""

    def run(batch: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, spans: list) -> pa.RecordBatch:
        raw, on = buf.tobytes(), [d for d, s in enumerate(spans) if s]
        cut = [kept_bytes(raw[offs[d]:offs[d + 1]], spans[d]).decode("utf-8", "replace") for d in on]
        return pa.RecordBatch.from_arrays([ints(batch, "row").take(pa.array(on, pa.int64())), pa.array(cut, pa.string())], ["row", "cut"])

    cut = shared(docs, run, "row bigint, cut string").dropDuplicates(["row"])
    own = bundled(docs).withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return unbundled(own.join(cut, "row", "left").withColumn("text", F.coalesce("cut", "text")), docs.columns)
