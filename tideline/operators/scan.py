"""Skew-proof ordered computation.

An ordinary ``Window.partitionBy(symbol)`` puts a whole series into one task. When one
symbol holds a third of all rows that task is the job. Everything here therefore works on
*pieces* of a series and never needs a whole group in one place:

``number_rows``   global position of a row in its group, from per-piece counts
``over_series``   bounded frames (lag, rolling mean, lead): pieces of fixed length, each
                  with a halo of copied neighbour rows, so results equal the plain window
``running``       unbounded frames (cumulative sum/max/min/last): a local window per piece
                  plus a carry from the (tiny) table of piece totals
``affine_scan``   v[t] = a[t]*v[t-1] + b[t]: pieces compose, so this is a two-level scan
``folds``         states along short series in one exchange; ``split_long`` tells the long ones, which need pieces
``relay``         state machines: every piece says what it makes of any state, the answers are
                  chained, then every piece runs from the state it really begins with
``chain``         rows reached by jumping from row to row, as a relay
``number_by_value`` / ``quantiles``  exact ranks and quantiles in a group of any size
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import cut_lineage

BLOCK_ROWS = 8192  # rows of one series handled by one task
EDGES = 64  # value buckets per group for exact ranking, at least; as many as shuffle partitions


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-key aggregate back on; AQE splits a skewed key, broadcasts only if it is small."""
    return df.join(side, list(keys), how) if keys else df.crossJoin(F.broadcast(side))


def with_group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group statistic on every row: map-side aggregate then join, not a one-task window."""
    return attach(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


def _numbered(df: DataFrame, keys, order, chunks: Sequence[str], name: str) -> DataFrame:
    sizes = df.groupBy(*keys, *chunks).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy(*chunks).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *keys, *chunks, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    local = F.row_number().over(Window.partitionBy(*keys, *chunks).orderBy(*order))
    return (
        df.join(offsets, [*keys, *chunks])
        .withColumn(name, (F.col("_off") + local - 1).cast("long"))
        .drop("_off", *chunks)
    )


def time_piece(col: str, chunk: str | int) -> Column:
    """Monotone piece of the order column: a calendar unit for time, a width for integers."""
    return F.floor(F.col(col) / chunk) if isinstance(chunk, int) else F.date_trunc(chunk, F.col(col))


def number_rows(
    df: DataFrame, keys=("symbol",), order=("ts",), chunk: str | int = "month", name: str = "_pos"
) -> DataFrame:
    """0-based position of each row within its key, ordered by time; ``order`` must be unique."""
    first = order[0]
    if chunk == "none":  # for tables with a handful of rows per key
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    cut = df.withColumn("_chunk", time_piece(first, chunk))
    return _numbered(cut, list(keys), list(order), ["_chunk"], name)


def _value_chunks(df: DataFrame, keys, value: str, tie: str | None) -> DataFrame:
    n = max(EDGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    aggs = [F.array_sort(F.array_distinct(F.percentile_approx(value, [i / n for i in range(1, n)], 30 * n))).alias("_edges")]
    if tie:  # what all ties of a group begin with is what its first and last one begin with
        low, high = F.min(F.col(tie).cast("string")), F.max(F.col(tie).cast("string"))
        same = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda k: F.substr(low, F.lit(1), k) == F.substr(high, F.lit(1), k))
        aggs.append(F.coalesce(F.size(same), F.lit(0)).alias("_same"))
    edges = df.groupBy(*keys).agg(*aggs)
    d = attach(df, edges, keys)
    x = F.col(value)
    on_edge = F.array_contains("_edges", x)
    below = F.size(F.filter("_edges", lambda e: e < x))
    # null values come last, in a bucket of their own
    d = d.withColumn("_vb", F.when(x.isNull(), 2 * n + 2).otherwise(F.coalesce(below * 2 + on_edge.cast("int"), F.lit(0))))
    # equal values are ordered by the tie column, so a hot value is cut by what follows the ties' common beginning
    prefix = F.when(on_edge | x.isNull(), F.substr(F.col(tie).cast("string"), F.col("_same") + 1, F.lit(3))) if tie else F.lit("")
    return d.withColumn("_vt", F.coalesce(prefix, F.lit(""))).drop("_edges", "_same")


def pieces(df: DataFrame, keys=("symbol",), order=("ts",), chunk: str | int = "month", rows: int | None = None) -> DataFrame:
    """Numbers the rows once and cuts each series into pieces (``_pos``, ``_blk``). Scans that are
    given the same pieces share one exchange."""
    d = number_rows(df, keys, order, chunk)
    return d.withColumn("_blk", F.floor(F.col("_pos") / (rows or BLOCK_ROWS)).cast("long"))


def number_by_value(
    df: DataFrame, keys, value: str, tie: str | None = None, name: str = "_pos"
) -> DataFrame:
    """0-based rank by (value, tie) ascending inside each key, for groups of any size.

    Rows are cut into value buckets at approximate percentiles; the counts of lower buckets
    give each bucket its offset, so the result is exact whatever the bucket edges are. Rows with a
    null value keep a null rank.
    ``tie`` must be a string column when given (ties are ordered by it).
    """
    d = _value_chunks(df, list(keys), value, tie)
    order = [F.asc_nulls_last(value)] + ([tie] if tie else [])
    return _numbered(d, list(keys), order, ["_vb", "_vt"], name).withColumn(name, F.when(F.col(value).isNotNull(), F.col(name)))


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, object], DataFrame],
    keys=("symbol",),
    order=("ts",),
    back: int = 0,
    ahead: int = 0,
    rows: int | None = None,
    chunk: str | int = "month",
) -> DataFrame:
    """Apply ``build(df, window)`` with frames reaching at most ``back``/``ahead`` rows.

    All columns built share one exchange and one sort. ``_pos`` is available inside ``build``.
    """
    size = max(rows or BLOCK_ROWS, back, ahead, 1)
    d = number_rows(df, keys, order, chunk)
    home = F.floor(F.col("_pos") / size).cast("long")
    off = F.col("_pos") % size
    copies = [home]
    if back:
        copies.append(F.when(off >= size - back, home + 1))
    if ahead:
        copies.append(F.when(off < ahead, home - 1))
    targets = F.filter(F.array(*copies), lambda b: b.isNotNull()) if len(copies) > 1 else F.array(home)
    d = d.withColumn("_blk", F.explode(targets))
    w = Window.partitionBy(*keys, "_blk").orderBy("_pos")
    out = build(d, w)
    return out.where(F.col("_blk") == home).drop("_blk", "_pos")


def map_blocks(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType,
    keys=("symbol",),
    order=("ts",),
    back: int = 0,
    rows: int | None = None,
    chunk: str | int = "month",
) -> DataFrame:
    """Custom rolling function in pandas on bounded pieces with ``back`` rows of warm-up.

    ``fn`` gets one piece sorted by position (with ``_pos``) and returns the same rows in order
    plus its columns; warm-up rows are dropped afterwards.
    """
    size = max(rows or BLOCK_ROWS, back, 1)
    d = number_rows(df, keys, order, chunk)
    home = F.floor(F.col("_pos") / size).cast("long")
    spill = F.when(F.col("_pos") % size >= size - back, home + 1)
    d = d.withColumn("_blk", F.explode(F.filter(F.array(home, spill), lambda b: b.isNotNull())))

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", kind="stable").reset_index(drop=True)
        blk = int(pdf["_blk"].iloc[0])
        out = fn(pdf)
        return out[(pdf["_pos"] // size == blk).to_numpy()][[f.name for f in schema.fields]]

    return d.groupBy(*keys, "_blk").applyInPandas(piece, schema)


def running(
    df: DataFrame,
    specs: Iterable[tuple[str, Column, str]],
    keys=("symbol",),
    order=("ts",),
    chunk: str | int = "month",
    chunk_cols: Sequence[str] | None = None,
    exclusive: bool = False,
    keep_chunks: bool = False,
) -> DataFrame:
    """Cumulative aggregates. ``specs`` are (kind, expression, output name), kind one of
    sum / max / min / last / first; ``last`` skips nulls. ``exclusive`` leaves out the own row."""
    specs = list(specs)
    keys, order = list(keys), list(order)
    if chunk_cols is None:
        df = df.withColumn("_chunk", time_piece(order[0], chunk))
        chunk_cols = ["_chunk"]
    chunk_cols = list(chunk_cols)
    stamp = F.struct(*order)

    def total(kind: str, x: Column) -> Column:
        if kind == "last":
            return F.max_by(x, F.when(x.isNotNull(), stamp))
        if kind == "first":
            return F.min_by(x, F.when(x.isNotNull(), stamp))
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](x)

    def roll(kind: str, x: Column, w) -> Column:
        if kind == "last":
            return F.last(x, ignorenulls=True).over(w)
        if kind == "first":
            return F.first(x, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](x).over(w)

    totals = df.groupBy(*keys, *chunk_cols).agg(
        *[total(k, x).alias(f"_t{i}") for i, (k, x, _) in enumerate(specs)]
    )
    before = Window.partitionBy(*keys).orderBy(*chunk_cols).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, *chunk_cols,
        *[roll(k, F.col(f"_t{i}"), before).alias(f"_c{i}") for i, (k, _, _) in enumerate(specs)],
    )
    here = (
        Window.partitionBy(*keys, *chunk_cols)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    out = df.join(carry, [*keys, *chunk_cols])
    cols = []
    for i, (kind, x, name) in enumerate(specs):
        c, local = F.col(f"_c{i}"), roll(kind, x, here)
        if kind == "sum":
            v = F.when(c.isNull(), local).when(local.isNull(), c).otherwise(c + local)
        elif kind == "max":
            v = F.greatest(c, local)
        elif kind == "min":
            v = F.least(c, local)
        elif kind == "last":
            v = F.coalesce(local, c)
        else:
            v = F.coalesce(c, local)
        cols.append(v.alias(name))
    gone = [f"_c{i}" for i in range(len(specs))] + ([] if keep_chunks else chunk_cols)
    return out.select("*", *cols).drop(*gone)


def streamed(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn, schema) -> DataFrame:
    """Feed ``fn`` the rows of whole groups in order, as batches of one partition.

    The exchange is on a hash *expression*: a plain ``repartition(*keys)`` right above a join on the
    same keys is dropped as redundant, and once that join turns into a broadcast join at run time
    with local shuffle reads the groups would no longer be together."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(fn, schema)


def split_long(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of series of at most ``rows`` rows, which need no pieces, and rows of the longer ones (None if there are none).
    Rows with a null key are in neither."""
    size = rows or BLOCK_ROWS
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    long = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size).drop("_n"))
    if long.isEmpty():
        return df, None
    return df.join(long, list(keys), "left_anti"), df.join(long, list(keys), "left_semi")


def folds(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: dict[str, Column], start: tuple, step: Callable[..., tuple], names: Sequence[str], last: bool = False) -> DataFrame:
    """States ``names`` (doubles) that ``state = step(*state, *inputs)`` takes along each series from ``start``: behind every
    row, or with ``last`` one row a key with its last state. One exchange and one sort; a series is read by one task, which
    keeps its state alone, so long ones are better cut into pieces. A NaN state is null in the result."""
    keys, names, kept = list(keys), list(names), df.columns
    d = df.withColumns({f"_i{k}": c.cast("double") for k, c in enumerate(inputs.values())})
    values = [f"_i{k}" for k in range(len(inputs))]
    if last:
        d = d.select(*dict.fromkeys([*keys, *order, *values]))
    states = [T.StructField(n, T.DoubleType()) for n in names]
    schema = T.StructType([*([df.schema[k] for k in keys] if last else df.schema.fields), *states])

    def run(batches):
        key, state = None, start
        for pdf in batches:
            out = []
            for now, *x in zip(zip(*(pdf[k].tolist() for k in keys)), *(pdf[v].tolist() for v in values)):
                if now != key:
                    if last and key is not None:
                        out.append((*key, *state))
                    key, state = now, start
                state = step(*state, *x)
                if not last:
                    out.append(state)
            yield pd.DataFrame(out, columns=schema.names) if last else pd.concat([pdf[kept], pd.DataFrame(out, columns=names, index=pdf.index)], axis=1)
        if last and key is not None:
            yield pd.DataFrame([(*key, *state)], columns=schema.names)

    return streamed(d, keys, order, run, schema)


def relay(cut: DataFrame, keys: Sequence[str], summarise, step, start, replay, schema: T.StructType | str) -> DataFrame:
    """State machine over pieces (``_pos``, ``_blk`` of ``pieces``), so that no task holds a series.

    ``summarise(piece)`` says what the piece makes of any state it may begin with, ``step(state, summary)``
    applies that, ``replay(piece, state)`` returns rows of ``schema`` for the state the piece begins with.
    A piece is a pandas frame in order of position. Only the summaries of a series meet in one task, as a stream.
    States and summaries travel pickled."""
    keys = list(keys)
    at = [*keys, "_blk"]

    def carrying(name: str) -> T.StructType:
        return T.StructType([*[cut.schema[k] for k in keys], T.StructField("_blk", T.LongType()), T.StructField(name, T.BinaryType())])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        return pdf.loc[:0, at].assign(_sum=[pickle.dumps(summarise(pdf))])

    def handed(batches):
        key, state = None, start
        for pdf in batches:
            entry = []
            for *now, summary in pdf[[*keys, "_sum"]].itertuples(index=False, name=None):
                if now != key:
                    key, state = now, start
                entry.append(pickle.dumps(state))
                state = step(state, pickle.loads(summary))
            yield pdf[at].assign(_entry=entry)

    def run(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return replay(pdf.sort_values("_pos", ignore_index=True), pickle.loads(entry["_entry"].iloc[0]))

    sums = cut.groupBy(*at).applyInPandas(summed, carrying("_sum"))
    entries = streamed(sums, keys, ["_blk"], handed, carrying("_entry"))
    return cut.groupBy(*at).cogroup(entries.groupBy(*at)).applyInPandas(run, schema)


def chain(df: DataFrame, at: str, after: str, keys=("symbol",), order=("ts",), chunk: str | int = "month", rows: int | None = None) -> DataFrame:
    """Rows reached by jumps: the first row of a key, then again and again the first row whose ``at`` is no less than
    ``after`` of the row before. ``at`` is a whole number that never falls along ``order``, ``after`` one above it."""
    names = df.columns

    def jumps(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        here, then = pdf[at].to_numpy(np.int64), pdf[after].to_numpy(np.int64)
        return here, then, np.searchsorted(here, then)

    def summarise(pdf: pd.DataFrame):
        here, then, hop = jumps(pdf)
        last = np.where(hop < len(here), hop, np.arange(len(here)))
        while not np.array_equal(last, last[last]):
            last = last[last]
        return here, then[last]

    def step(state: int, summary) -> int:
        here, leaving = summary
        k = int(np.searchsorted(here, state))
        return int(leaving[k]) if k < len(here) else state

    def replay(pdf: pd.DataFrame, state: int) -> pd.DataFrame:
        here, _, hop = jumps(pdf)
        k, taken = int(np.searchsorted(here, state)), []
        while k < len(here):
            taken.append(k)
            k = int(hop[k])
        return pdf.iloc[taken][names]

    cut = pieces(df, keys, order, chunk, rows)
    return relay(cut, keys, summarise, step, np.iinfo(np.int64).min, replay, df.schema)


def affine_scan(
    df: DataFrame,
    a: Column,
    b: Column,
    name: str,
    keys=("symbol",),
    order=("ts",),
    init: float = 0.0,
    prev: str | None = None,
    rows: int | None = None,
    chunk: str | int = "month",
) -> DataFrame:
    """v[t] = a[t]*v[t-1] + b[t] with v[-1] = init, as a two-level scan over pieces. ``prev`` names
    an extra column with v[t-1]; rows already cut by ``pieces`` keep their pieces."""
    keys = list(keys)
    cut = df if {"_pos", "_blk"} <= set(df.columns) else pieces(df, keys, order, chunk, rows)
    d = cut.withColumns({"_a": a.cast("double"), "_b": b.cast("double")})
    kf = [d.schema[k] for k in keys]
    blk = T.StructField("_blk", T.LongType())

    part_schema = T.StructType([*kf, blk, T.StructField("_ca", T.DoubleType()), T.StructField("_cb", T.DoubleType())])
    seed_schema = T.StructType([*kf, blk, T.StructField("_seed", T.DoubleType())])
    out_schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType()),
                               *([T.StructField(prev, T.DoubleType())] if prev else [])])
    names = {s: [f.name for f in s.fields] for s in (part_schema, seed_schema, out_schema)}

    def ids(pdf: pd.DataFrame, cols: list[str]) -> list[tuple]:
        return list(zip(*(pdf[c].tolist() for c in cols), strict=True))

    # The three passes read pieces in order as batches. Many tiny groups cost no more than one
    # big one, and no group is ever held as a whole.
    def compose(batches):
        cur, ca, cb = None, 1.0, 0.0
        for pdf in batches:
            out = []
            for k, x, y in zip(ids(pdf, [*keys, "_blk"]), pdf["_a"].tolist(), pdf["_b"].tolist(), strict=True):
                if k != cur:
                    if cur is not None:
                        out.append((*cur, ca, cb))
                    cur, ca, cb = k, 1.0, 0.0
                ca, cb = x * ca, x * cb + y
            yield pd.DataFrame(out, columns=names[part_schema])
        if cur is not None:
            yield pd.DataFrame([(*cur, ca, cb)], columns=names[part_schema])

    def carry(batches):
        cur, v = None, init
        for pdf in batches:
            seeds = []
            for k, x, y in zip(ids(pdf, keys), pdf["_ca"].tolist(), pdf["_cb"].tolist(), strict=True):
                if k != cur:
                    cur, v = k, init
                seeds.append(v)
                v = x * v + y
            yield pdf[[*keys, "_blk"]].assign(_seed=seeds)

    def fill(batches):
        cur, v = None, init
        for pdf in batches:
            vals, before = [], []
            for k, x, y, seed in zip(ids(pdf, [*keys, "_blk"]), pdf["_a"].tolist(), pdf["_b"].tolist(), pdf["_seed"].tolist(), strict=True):
                if k != cur:
                    cur, v = k, seed
                before.append(v)
                v = x * v + y
                vals.append(v)
            yield pdf.assign(**{name: vals, **({prev: before} if prev else {})})[names[out_schema]]

    piece = [*keys, "_blk"]
    parts = streamed(d.select(*piece, "_pos", "_a", "_b"), piece, ["_pos"], compose, part_schema)
    seeds = streamed(parts, keys, ["_blk"], carry, seed_schema)
    return streamed(d.join(seeds, piece), piece, ["_pos"], fill, out_schema)


def decayed_sums(df: DataFrame, terms: dict[str, tuple[float, Column]], keys=("symbol",), order=("ts",), rows: int | None = None, chunk: str | int = "month") -> DataFrame:
    """v[t] = a*v[t-1] + b[t] from 0 for several (name: (a, b)) with constant a in (0, 1], in one two-level scan: sums of
    the pieces, their carry, then the rows. Stretches of rows are one array operation."""
    keys, names = list(keys), list(terms)
    piece, decay = [*keys, "_blk"], np.array([a for a, _ in terms.values()])
    d = pieces(df, keys, order, chunk, rows).withColumns({f"_b{i}": F.coalesce(b.cast("double"), F.lit(0.0)) for i, (_, b) in enumerate(terms.values())})
    inputs = [f"_b{i}" for i in range(len(terms))]
    kf = [*(d.schema[k] for k in keys), T.StructField("_blk", T.LongType())]
    doubles = [T.StructField(x, T.DoubleType()) for x in inputs]
    total_schema = T.StructType([*kf, T.StructField("_n", T.LongType()), *doubles])
    seed_schema = T.StructType([*kf, *(T.StructField(f"_s{i}", T.DoubleType()) for i in range(len(terms)))])
    out_schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def runs(pdf: pd.DataFrame, cols: list[str]):
        new = (pdf[cols] != pdf[cols].shift()).any(axis=1).to_numpy()
        at = np.flatnonzero(new)
        return zip(at, [*at[1:], len(pdf)])

    def after(v: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Values behind each row of b, from v."""
        out = np.empty_like(b)
        for at in range(0, len(b), 64):
            part = b[at:at + 64]
            power = decay[None, :] ** np.arange(1, len(part) + 1)[:, None]
            out[at:at + 64] = power * (v + np.cumsum(part / power, axis=0))
            v = out[at + len(part) - 1]
        return out

    def totals(batches):
        cur, n, v = None, 0, None
        for pdf in batches:
            out = []
            for i, j in runs(pdf, piece):
                k = tuple(pdf[c].iloc[i] for c in piece)
                if k != cur:
                    if cur is not None:
                        out.append((*cur, n, *v))
                    cur, n, v = k, 0, np.zeros(len(names))
                n, v = n + j - i, after(v, pdf[inputs].iloc[i:j].to_numpy(float))[-1]
            yield pd.DataFrame(out, columns=total_schema.names)
        if cur is not None:
            yield pd.DataFrame([(*cur, n, *v)], columns=total_schema.names)

    def carry(batches):
        cur, v = None, None
        for pdf in batches:
            seeds = []
            for *k, n, b in zip(*(pdf[c] for c in keys), pdf["_n"], pdf[inputs].to_numpy(float)):
                if k != cur:
                    cur, v = k, np.zeros(len(names))
                seeds.append(v)
                v = decay ** n * v + b
            yield pd.concat([pdf[piece].reset_index(drop=True), pd.DataFrame(np.array(seeds).reshape(-1, len(names)), columns=seed_schema.names[len(piece):])], axis=1)

    def fill(batches):
        cur, v = None, None
        for pdf in batches:
            out = np.empty((len(pdf), len(names)))
            for i, j in runs(pdf, piece):
                k = tuple(pdf[c].iloc[i] for c in piece)
                if k != cur:
                    cur, v = k, pdf[seed_schema.names[len(piece):]].iloc[i].to_numpy(float)
                out[i:j] = after(v, pdf[inputs].iloc[i:j].to_numpy(float))
                v = out[j - 1]
            yield pdf.assign(**dict(zip(names, out.T)))[out_schema.names]

    parts = streamed(d.select(*piece, "_pos", *inputs), piece, ["_pos"], totals, total_schema)
    return streamed(d.join(streamed(parts, keys, ["_blk"], carry, seed_schema), piece), piece, ["_pos"], fill, out_schema)


def quantiles(df: DataFrame, keys, value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, for groups of any size."""
    keys = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    if not keys:
        d = d.withColumn("_g", F.lit(0))
        keys = ["_g"]
    ranked = number_by_value(d, keys, "_x")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = attach(ranked, n, keys)
    aggs = []
    for p, nm in zip(probs, names, strict=True):
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, frac = F.floor(h), h - F.floor(h)
        at_lo = F.max(F.when(F.col("_pos") == lo, F.col("_x")))
        at_hi = F.max(F.when(F.col("_pos") == F.ceil(h), F.col("_x")))
        aggs.append((at_lo + (at_hi - at_lo) * F.max(frac)).alias(nm))
    return r.groupBy(*keys).agg(*aggs).drop("_g")


def mid_ranks(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """Average rank (1-based, ties share the mean) per key: count distinct values first, so a
    value held by a third of the rows is one row before anything is ordered."""
    keys = list(keys)
    dist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"))
    cut = _value_chunks(dist, keys, value, None)
    cum = running(cut, [("sum", F.col("_m"), "_cum")], keys, [value], chunk_cols=["_vb", "_vt"])
    ranks = cum.select(*keys, value, (F.col("_cum") - (F.col("_m") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value])
