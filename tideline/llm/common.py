"""Vectorised byte and word work inside tasks, and tables written to the cluster's shared folder."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import prepare, shared_dir

#: One step of vectorised work; a longer text is a step of its own.
STEP_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Everything below 0x80 that is neither a digit nor a letter.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def start(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, as texts may be long."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return start(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back, so that lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tideline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct `rest`, so that no name of theirs meets a working column's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("rest"))


def unbundled(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that `bundled` took together, in their first order."""
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns))


def shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, parts: int):
    """crc32 of an id's decimal text, modulo parts; null ids go to fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(0))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * STEP_BYTES), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


class Prefix:
    """Polynomial hashes of any byte ranges of a buffer from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.empty(len(buf) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE[buf] * powers(_MULT, len(buf)), out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(buf) + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.inverse[lo])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n+1 offsets into them; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `limit` text bytes (one row at least), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), buf[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
            at = to


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and n+1 word offsets of the documents."""
    inside = ~sep[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    after = np.empty(len(buf), bool)
    if len(buf):
        before[0], before[1:] = True, ~inside[:-1]
        after[-1], after[:-1] = True, ~inside[1:]
    lo = np.flatnonzero(inside & (before | edge[:-1]))
    hi = np.flatnonzero(inside & (after | edge[1:])) + 1
    return lo, hi, np.searchsorted(lo, offs)


def owners(offs: np.ndarray) -> np.ndarray:
    """Document number of each element behind n+1 offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, then those of the next range."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def segment_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offs[1:]] - total[offs[:-1]]


def ints(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64())


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or b in range(161, 173) or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
