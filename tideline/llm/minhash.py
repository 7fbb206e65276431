"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, WHITE, Prefix, ints, mixed, shards, stash, steps, words
from tideline.llm.graph import components

SHINGLE = 5
#: Signature: CHUNKS chunks of WIDTH values of BITS bits. Two signatures that differ in fewer than 2 * CHUNKS values have
#: a chunk with one error at most, which the enumerated chunks (each without one of its values) find for certain. A pair
#: at similarity 0.85 has such a chunk with probability 1 - 3e-7, whatever its signatures' distance.
CHUNKS, WIDTH, BITS = 10, 6, 16
#: Members and shingles of a block of a candidate group; blocks are compared pair by pair.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_500_000
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, CHUNKS * WIDTH, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 63, CHUNKS * WIDTH, dtype=np.int64).astype(np.uint64)


def shingles(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct codes of each text's shingles: SHINGLE lower-cased words, or all words of a shorter text."""
    buf = LOWER[buf]
    lo, hi, at = words(buf, offs, WHITE)
    code = Prefix(buf).of(lo, hi)
    padded = np.concatenate([code, np.zeros(SHINGLE, np.uint64)])
    total = np.zeros(len(code), np.uint64)
    for j in range(SHINGLE):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(padded[j:j + len(code)])
    whole = mixed(total)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(whole[a:b - SHINGLE + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for x in code[a:b]:
                short = mixed(short * np.uint64(31) + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(codes: np.ndarray) -> bytes:
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 2048):
        np.minimum(least, (np.multiply.outer(_FACTORS, codes[at:at + 2048]) + _SHIFTS[:, None]).min(axis=1), out=least)
    return ((least >> np.uint64(20)) & np.uint64((1 << BITS) - 1)).astype("<u2").tobytes()


def node_of(codes: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little", signed=True) if len(codes) else None


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (a code of the shingle set, null if empty) and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in steps(batches, "text"):
            sets = shingles(buf, offs)
            yield pa.RecordBatch.from_arrays([ints(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
                                             ["doc_id", "n_shingles", "node", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, signature binary")


def chunk_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): every chunk of the signature without each one of its values in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                node = ints(part, "node").to_numpy(zero_copy_only=False)
                raw = b"".join(part.column(part.schema.get_field_index("signature")).to_pylist())
                values = np.frombuffer(raw, "<u2").astype(np.uint64).reshape(len(node), CHUNKS, WIDTH)
                keys = []
                for left_out in range(WIDTH):
                    key = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out), values.shape[:2])
                    for j in range(WIDTH):
                        if j != left_out:
                            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, j])
                    keys.append(key)
                keys = np.concatenate(keys, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(node, keys.shape[1]))], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key bigint, node bigint")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members left and right, found by exact intersections of full sets."""
    size = np.array([len(s) for s in sets])
    code = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    new = np.concatenate([[True], code[1:] != code[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    both = np.zeros((len(left), len(right)))
    row_left, row_right = np.full(len(sets), -1), np.full(len(sets), -1)
    row_left[left], row_right[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        here, own = column[a:b] - at, owner[a:b]
        x, y = np.zeros((len(left), here[-1] + 1), np.float32), np.zeros((len(right), here[-1] + 1), np.float32)
        x[row_left[own[row_left[own] >= 0]], here[row_left[own] >= 0]] = 1
        y[row_right[own[row_right[own] >= 0]], here[row_right[own] >= 0]] = 1
        both += x @ y.T
    union = size[left][:, None] + size[right][None, :] - both
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in zip(*np.nonzero(100 * both >= percent * union)):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(left[i]), int(right[j])))
    return out


def links(docs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between nodes, enough to connect all that are connected.

    Signatures that share an enumerated chunk make candidate groups (a chunk links its members to its smallest, so that
    a frequent chunk costs a row for each member). Groups are cut into blocks; each pair of blocks goes to a task with
    the texts and tests all pairs on full shingle sets."""
    nodes = stash(found.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")))
    keys = chunk_keys(nodes)
    several = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    stars = keys.join(several, "key").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    groups = stash(components(stars).withColumnRenamed("component", "g"))
    members = groups.join(nodes.select("node", "doc_id", "n_shingles"), "node")
    blocks = members.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.select("doc_id", "text").where("text is not null").join(members, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = texts.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text").repartition(shards(docs.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def compare():
            rows = {}
            for own, node, codes in held:
                if node_of(codes) == node:  # another text of the same doc_id is not this node's
                    rows[node] = (own, codes)
            node = list(rows)
            own, sets = np.array([rows[n][0] for n in node]), [rows[n][1] for n in node]
            left, right = np.flatnonzero(own == last[1]), np.flatnonzero(own == last[2])
            pairs = linked(sets, left, right, percent) if len(left) and len(right) else []
            return pa.RecordBatch.from_arrays([pa.array([node[a] for a, _ in pairs], pa.int64()), pa.array([node[b] for _, b in pairs], pa.int64())], ["a", "b"])

        for batch, buf, offs in steps(batches, "text"):
            sets = shingles(buf, offs)
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("g", "i", "j", "own", "node")]
            for g, i, j, own, node, codes in zip(*columns, sets):
                if (g, i, j) != last:
                    if held:
                        yield compare()
                    held, last = [], (g, i, j)
                held.append((own, node, codes))
        if held:
            yield compare()

    return texts.mapInArrow(run, "a bigint, b bigint")


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that links reach. Equal sets are one node, so copies cost one row each. An empty or null text has no shingles
    and is linked with nothing; a null doc_id is linked with nothing, its component is null and it is kept; repeated rows
    of one doc_id are in one component and each is kept if its doc_id is the component's. Other columns are ignored."""
    found = stash(profiles(docs))
    joined = components(links(docs, found, percent))
    nodes = found.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    whole = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = whole.join(least, "component").select("node", "component_id")
    own = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(labels, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def remove_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the rows that are not kept; rows of one doc_id stay or go together."""
    gone = deduplicated(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.c, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) c ON c.x = w.doc_id
"""
