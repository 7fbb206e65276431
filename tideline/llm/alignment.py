"""Alignment of two tokenizers' tokens by products of sparse incidence matrices."""
from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import STEP_BYTES, byte_letters, ints, owners, ranges, segment_sums, stash, steps

#: Text bytes whose links share one table of id pairs.
CHUNK_BYTES = 4 << 20
#: Letters of which both readers of the byte-level vocabulary are known to make the same words; other texts, and
#: texts with white space without end, go to the slower one.
PLAIN = re.compile("[\x00-ɏ‐-›€]*")
LONG_SPACE = re.compile(r"\s{2000}")


@dataclass
class Csr:
    """Compressed sparse rows: the columns of row r are indices[indptr[r]:indptr[r + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int
    values: np.ndarray | None = None

    @property
    def row(self) -> np.ndarray:
        return owners(self.indptr)

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(indptr, self.row[order], len(self.indptr) - 1, None if self.values is None else self.values[order])


def spread(sizes: np.ndarray) -> Csr:
    """Incidence of consecutive runs: row r covers the next sizes[r] columns."""
    total = int(sizes.sum())
    return Csr(np.concatenate([[0], np.cumsum(sizes)]), np.arange(total), total)


def product(a: Csr, b: Csr) -> Csr:
    """Row by row (Gustavson): row r of a·b gathers the rows of b that row r of a names; equal columns add up."""
    sizes = np.diff(b.indptr)[a.indices]
    row = np.repeat(a.row, sizes)
    at = ranges(b.indptr[a.indices], sizes)
    column = b.indices[at]
    value = np.ones(len(row), np.int64) if a.values is None else np.repeat(a.values, sizes)
    if b.values is not None:
        value = value * b.values[at]
    key = row * b.columns + column
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    sums = np.add.reduceat(value, first) if len(first) else value
    row, column = np.divmod(key[first], b.columns) if b.columns else (key[first], key[first])
    return Csr(np.searchsorted(row, np.arange(len(a.indptr))), column, b.columns, sums)


class Vocabulary:
    """Bytes of every id, flat."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.first = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.first[ids], self.size[ids])]


class ByteLevel:
    """Ids of a byte-level vocabulary. Texts of plain letters take the reader of the same vocabulary as ranks, which is
    several times faster; all other texts, and all where no ranks are given, take the vocabulary's own."""

    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        value = {letter: b for b, letter in enumerate(byte_letters())}
        by_id = {i: t for t, i in self.own.get_vocab(with_added_tokens=True).items()}
        added = set(self.own.get_added_tokens_decoder())
        self.vocabulary = Vocabulary([bytes(value.get(c, 63) for c in by_id.get(i, "")) if i not in added else by_id[i].encode() for i in range(max(by_id) + 1)])
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        plain = [self.fast is not None and PLAIN.fullmatch(t) is not None and LONG_SPACE.search(t) is None for t in texts]
        rest = iter(self.own.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain)]


class Pieces:
    """Ids of a piece vocabulary with byte fallback; it puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        names = [(self.own.id_to_piece(i), self.own.is_byte(i)) for i in range(self.own.get_piece_size())]
        self.vocabulary = Vocabulary([bytes([int(n[3:5], 16)]) if byte else n.replace("▁", " ").encode() for n, byte in names])

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


_TOKENIZERS: dict[tuple, tuple[ByteLevel, Pieces]] = {}


def tokenizers(paths: tuple[str, str | None, str]) -> tuple[ByteLevel, Pieces]:
    """One pair for each Python worker."""
    if paths not in _TOKENIZERS:
        _TOKENIZERS[paths] = ByteLevel(*paths[:2]), Pieces(paths[2])
    return _TOKENIZERS[paths]


@dataclass
class Aligned:
    """Tokens of some texts, one after the other: ids and n+1 token offsets of the texts on either side, the group
    of each token, and which token pairs overlap by how many bytes (rows: A, columns: B)."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_groups: Csr
    b_groups: Csr
    groups_at: np.ndarray
    overlaps: Csr

    @classmethod
    def of(cls, texts: list[str | None], byte_level: ByteLevel, pieces: Pieces) -> Aligned:
        spaced = [" " + t if t else "" for t in texts]
        ids = [[np.array(x, np.int64) for x in own([t for t in spaced if t])] for own in (byte_level, lambda ts: pieces([t[1:] for t in ts]))]
        vocabularies = byte_level.vocabulary, pieces.vocabulary
        none, tokens = np.zeros(0, np.int64), [[], []]
        full = iter(zip(*ids))
        for t in spaced:
            pair = next(full) if t else (none, none)
            raw = t.encode() if t else b""
            same = all(v.joined(x).tobytes() == raw for v, x in zip(vocabularies, pair))
            for side, x in zip(tokens, pair):
                side.append(x if same else none)
        a, b = (np.concatenate([none, *side]) for side in tokens)
        a_at, b_at = (np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in tokens)
        a_bytes, b_bytes = (spread(v.size[x]) for v, x in zip(vocabularies, (a, b)))
        marks = [np.zeros(a_bytes.columns + 1, bool) for _ in range(2)]
        marks[0][a_bytes.indptr[1:]], marks[1][b_bytes.indptr[1:]] = True, True
        ends = np.flatnonzero(marks[0] & marks[1])
        a_groups, b_groups = (spread(np.diff(np.searchsorted(m.indptr[1:], np.concatenate([[0], ends]), "right"))) for m in (a_bytes, b_bytes))
        return cls(a, b, a_at, b_at, a_groups, b_groups, np.searchsorted(a_groups.indptr, a_at), product(a_bytes, b_bytes.transposed()))

    def shared(self) -> Csr:
        """Token pairs of one group (rows: A, columns: B), whether they overlap or not."""
        return product(self.a_groups.transposed(), self.b_groups)

    def rendered(self) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        n_a, n_b = np.diff(self.a_groups.indptr), np.diff(self.b_groups.indptr)
        a_place = np.arange(len(self.a)) + np.repeat(self.b_groups.indptr[:-1], n_a)
        b_place = np.arange(len(self.b)) + np.repeat(self.a_groups.indptr[1:], n_b)
        ids, after = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[a_place], ids[b_place] = self.a, self.b
        after[a_place[self.a_groups.indptr[1:] - 1]] = ord("|")
        after[b_place[self.b_groups.indptr[1:] - 1]] = ord(";")
        digits = np.zeros((len(ids), 7), np.uint8)
        size = np.ones(len(ids), np.int64)
        for power in (10, 100, 1000, 10_000, 100_000):
            size += ids >= power
        for k in range(6):
            on = size > k
            digits[on, k] = 48 + ids[on] // 10 ** (size[on] - 1 - k) % 10
        digits[np.arange(len(ids)), size] = after
        text, ends = digits[digits != 0].tobytes(), np.concatenate([[0], np.cumsum(size + 1)])[self.a_at + self.b_at]
        return [text[lo:max(lo, hi - 1)] for lo, hi in zip(ends[:-1], ends[1:])]


DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_shared", pa.int64()), ("groups_sha256", pa.string())]))
DOC_TYPE = "doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, n_shared: bigint, groups_sha256: string"
ID_BITS = 24
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]


def chunked(docs: DataFrame, paths: tuple[str, str | None, str]) -> DataFrame:
    """(chunk, docs, links, pairs, counts): the documents of up to CHUNK_BYTES text, their links as numbers of id pairs,
    and the distinct id pairs with their numbers of links in the chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_level, pieces = tokenizers(paths)
        base, made = TaskContext.get().partitionId() << 32, 0
        rows, keys, size = [], [], 0

        def closed() -> pa.RecordBatch:
            pairs, number, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            often = np.argsort(-counts, kind="stable")  # frequent pairs get small numbers, which compress well
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            links = rank[number].astype("<u4")
            table = pa.StructArray.from_arrays([pa.concat_arrays([r[k] for r in rows]) for k in range(len(DOCS.value_type))], fields=list(DOCS.value_type))
            return pa.RecordBatch.from_arrays([
                pa.array([base + made]), pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table), pa.array([len(links)], pa.int64()),
                pa.array([pa.compress(links.tobytes(), "zstd", asbytes=True)], pa.binary()),
                pa.array([pairs[often].astype("<i8").tobytes()], pa.binary()), pa.array([counts[often].astype("<i8").tobytes()], pa.binary()),
            ], ["chunk", "docs", "n_links", "links", "pairs", "counts"])

        for batch, buf, _ in steps(batches, "text", STEP_BYTES // 2):
            found = Aligned.of(batch.column(batch.schema.get_field_index("text")).to_pylist(), byte_level, pieces)
            row = found.overlaps.row
            keys.append(found.a[row] << ID_BITS | found.b[found.overlaps.indices])
            links = np.diff(found.overlaps.indptr[found.a_at])
            shared = segment_sums(np.diff(found.a_groups.indptr) * np.diff(found.b_groups.indptr), found.groups_at)
            shas = [hashlib.sha256(t).hexdigest() if t else "" for t in found.rendered()]
            rows.append([ints(batch, "doc_id"), *(pa.array(x, pa.int64()) for x in (np.diff(found.a_at), np.diff(found.b_at), np.diff(found.groups_at), links, shared)), pa.array(shas, pa.string())])
            size += len(buf)
            if size >= CHUNK_BYTES:
                yield closed()
                rows, keys, size, made = [], [], 0, made + 1
        if rows:
            yield closed()

    return docs.select("doc_id", "text").mapInArrow(run, f"chunk bigint, docs array<struct<{DOC_TYPE}>>, n_links bigint, links binary, pairs binary, counts binary")


def unfolded(chunks: DataFrame) -> DataFrame:
    """(chunk, at, pair, n): a row for each id pair of each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                pairs = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(np.frombuffer(counts, "<i8"))], ["chunk", "at", "pair", "n"])

    return chunks.select("chunk", "pairs", "counts").mapInArrow(run, "chunk bigint, at int, pair bigint, n bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, links, top): links of each id pair in the corpus, and whether no other A id has more with its B id."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("links"))
    b = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    best = totals.groupBy(b.alias("b")).agg(F.max("links").alias("best"))  # a row for each B id of the vocabulary at most
    return totals.withColumn("b", b).join(F.broadcast(best), "b").select("pair", "links", (F.col("links") == F.col("best")).alias("top"))


def align(docs: DataFrame, byte_level: str, pieces: str, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256) of every document.

    Overlap links are the entries of A·Bᵀ, A and B being the token-byte incidences of a step of texts; groups end
    where tokens of both sides end; n_shared counts the token pairs of one group. The corpus count of an id pair comes from sums
    per chunk of text, and goes back to the chunks by a join; chunks are bounded, so that a frequent pair is one row of each.

    Null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens: zeros
    and ''. Repeated rows count each for itself; a null doc_id stays; only doc_id and text are read; an empty table gives no rows.
    """
    chunks = stash(chunked(docs, (byte_level, ranks, pieces)))
    pairs = unfolded(chunks)
    known = pairs.select("chunk", "at", "pair").join(pair_counts(pairs), "pair").select("chunk", "at", "links", "top")

    def run(counts: pa.Table, parts: pa.Table) -> pa.Table:
        out = []
        at, links, top = (np.asarray(counts[c].combine_chunks().cast(pa.int64())) for c in ("at", "links", "top"))
        order = np.argsort(at)
        links, top = links[order], top[order]
        packed = parts["docs"].combine_chunks()
        for k in range(parts.num_rows):
            rows = packed.slice(k, 1).flatten()
            columns = dict(zip([f.name for f in rows.type], rows.flatten()))
            number = np.frombuffer(pa.decompress(parts["packed"][k].as_py(), 4 * parts["n"][k].as_py(), "zstd", asbytes=True), "<u4")
            ends = np.concatenate([[0], np.cumsum(np.asarray(columns["n_links"]))])
            columns |= {"n_best": pa.array(segment_sums(top[number], ends)), "count_sum": pa.array(segment_sums(links[number], ends))}
            out.append(pa.table(columns).select(COLUMNS))
        return pa.concat_tables(out)

    held = chunks.select("chunk", "docs", F.col("n_links").alias("n"), F.col("links").alias("packed"))
    return known.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(run, ", ".join(f"{c} {'string' if c == COLUMNS[-1] else 'bigint'}" for c in COLUMNS))



def links(docs: DataFrame, byte_level: str, pieces: str, ranks: str | None = None, shared: bool = False) -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, n_bytes) of every overlapping token pair, or with `shared` of every pair of one
    group (n_bytes is 0 where the two only share the group). Edge cases are those of `align`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers((byte_level, ranks, pieces))
        for batch, _, _ in steps(batches, "text", STEP_BYTES // 2):
            found = Aligned.of(batch.column(batch.schema.get_field_index("text")).to_pylist(), *own)
            for k in range(batch.num_rows):
                lo, hi = found.a_at[k:k + 2]
                b_lo = found.b_at[k]
                cut = found.overlaps.indptr[lo:hi + 1]
                row, column, size = np.repeat(np.arange(lo, hi), np.diff(cut)), found.overlaps.indices[cut[0]:cut[-1]], found.overlaps.values[cut[0]:cut[-1]]
                if shared:
                    pairs = found.shared()
                    cut = pairs.indptr[lo:hi + 1]
                    known = dict(zip(zip(row.tolist(), column.tolist()), size.tolist()))
                    row, column = np.repeat(np.arange(lo, hi), np.diff(cut)), pairs.indices[cut[0]:cut[-1]]
                    size = np.array([known.get(p, 0) for p in zip(row.tolist(), column.tolist())], np.int64)
                doc = ints(batch, "doc_id")[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(row), pa.int64()), pa.array(row - lo), pa.array(column - b_lo), pa.array(found.a[row]), pa.array(found.b[column]), pa.array(size)],
                                                 ["doc_id", "a_at", "b_at", "a_id", "b_id", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, a_at bigint, b_at bigint, a_id bigint, b_id bigint, n_bytes bigint")

