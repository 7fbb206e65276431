"""Slots for a user's own logic: mergeable aggregates, strategies, and scorers by kind of artefact."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial states of a key that one call merges; more are merged in a tree of salted groups.
FAN_IN = 256
#: Keys whose states a task holds before it sends them.
HELD_KEYS = 50_000


class Aggregate:
    """A user's aggregate of numeric columns as a state of float64 numbers that can be merged in any order.

    ``fold`` takes the state and one array for each input column (rows without nulls), ``merge`` two states, ``finish``
    gives the value, None for null. States must stay small: they are what the shuffle carries."""

    inputs: Sequence[str]

    def start(self) -> np.ndarray:
        raise NotImplementedError

    def fold(self, state: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def finish(self, state: np.ndarray) -> float | None:
        raise NotImplementedError


class LogVariance(Aggregate):
    """Sample variance of the logarithms of positive values, by counts, means and squared deviations."""

    def __init__(self, value: str):
        self.inputs = (value,)

    def start(self):
        return np.zeros(3)

    def fold(self, state, x):
        x = np.log(x[x > 0])
        return self.merge(state, np.array([len(x), x.mean(), ((x - x.mean()) ** 2).sum()])) if len(x) else state

    def merge(self, a, b):
        n = a[0] + b[0]
        if not n:
            return a
        gap = b[1] - a[1]
        return np.array([n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n])

    def finish(self, state):
        return float(state[2] / (state[0] - 1)) if state[0] > 1 else None


class TailMean(Aggregate):
    """Mean of the k greatest values (all, if there are fewer): a rank-based aggregate with a state of k numbers."""

    def __init__(self, value: str, k: int):
        self.inputs, self.k = (value,), k

    def start(self):
        return np.zeros(0)

    def fold(self, state, x):
        return self.merge(state, x)

    def merge(self, a, b):
        x = np.concatenate([a, b])
        return np.partition(x, len(x) - self.k)[-self.k:] if len(x) > self.k else x

    def finish(self, state):
        return float(np.sort(state).mean()) if len(state) else None


def aggregate(df: DataFrame, keys: Sequence[str], parts: dict[str, Aggregate], fan_in: int = FAN_IN) -> DataFrame:
    """One row for each group with the value of every aggregate in ``parts``; null keys are a group of their own.

    Tasks fold their rows batch by batch into a state for each key they meet; only states are shuffled. A key of all tasks
    has a state from each, so states are first merged in salted groups of about ``fan_in``, then across the salts: no
    task ever holds a group's rows. Rows with a null input are left out for that aggregate."""
    names, types = list(keys), [df.schema[k] for k in keys]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
    inputs = list(dict.fromkeys(c for a in parts.values() for c in a.inputs))
    work = list(parts.values())
    states = [f"_state{i}" for i in range(len(work))]

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            columns = [pa.array([k[i] for k in held], kinds[0][i]) for i in range(len(names))]
            columns += [pa.array([s[i].tobytes() for s in held.values()], pa.binary()) for i in range(len(work))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *states])

    kinds: list = [None]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            kinds[0] = [table.schema.field(k).type for k in names]
            group = table.select(names).append_column("_n", pa.array(np.arange(batch.num_rows))).group_by(names, use_threads=False).aggregate([("_n", "list")])
            values = [np.asarray(table[c].combine_chunks().cast(pa.float64())) for c in inputs]  # null is NaN here
            found = [~np.asarray(table[c].combine_chunks().is_null()) for c in inputs]
            where = group["_n_list"].combine_chunks()
            for at, *key in zip(range(len(group)), *(group[k].to_pylist() for k in names)):
                own = np.asarray(where[at].values)
                state = held.setdefault(tuple(key), [a.start() for a in work])
                for i, a in enumerate(work):
                    cols = [inputs.index(c) for c in a.inputs]
                    use = own[np.logical_and.reduce([found[c][own] for c in cols])]
                    state[i] = a.fold(state[i], *(values[c][use] for c in cols))
            if len(held) > HELD_KEYS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    def merge(table: pa.Table) -> pa.Table:
        out = [table[k].slice(0, 1) for k in names]
        for name, a in zip(states, work):
            state = a.start()
            for raw in table[name].to_pylist():
                state = a.merge(state, np.frombuffer(raw, np.float64))
            out.append(pa.chunked_array([pa.array([state.tobytes()], pa.binary())]))
        return pa.table(out, names=[*names, *states])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            columns = [table[k].combine_chunks() for k in names]
            columns += [pa.array([a.finish(np.frombuffer(raw, np.float64)) for raw in table[s].to_pylist()], pa.float64()) for s, a in zip(states, work)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *parts])

    schema = key_schema + "".join(f", {s} binary" for s in states)
    partial = df.select(*names, *(c for c in inputs if c not in names)).mapInArrow(fold, schema)
    salted = partial.withColumn("_salt", F.floor(F.spark_partition_id() / fan_in))
    kept = [*names, *states]
    first = salted.groupBy(*names, "_salt").applyInArrow(lambda t: merge(t.select(kept)), schema)
    return first.groupBy(*names).applyInArrow(merge, schema).mapInArrow(finish, key_schema + "".join(f", `{n}` double" for n in parts))


class Strategy:
    """A named rule from a panel to signals (symbol, ts, direction, confidence and what the evaluation needs), with its
    parameters, so that variants are registered, listed and compared alike."""

    def __init__(self, name: str, signals: Callable[..., DataFrame], **params):
        self.name, self.fn, self.params = name, signals, params

    def signals(self, panel: DataFrame) -> DataFrame:
        return self.fn(panel, **self.params).withColumn("strategy", F.lit(self.name))


def compare(strategies: Sequence[Strategy], panel: DataFrame, evaluate: Callable[[DataFrame, Sequence[str]], DataFrame], at: str = "ts") -> DataFrame:
    """The signals of all strategies, evaluated in one plan with the strategy as a further key."""
    if len({s.name for s in strategies}) < len(strategies):
        raise ValueError("strategies need names of their own")
    found = None
    for s in strategies:
        rows = s.signals(panel)
        found = rows if found is None else found.unionByName(rows)
    return evaluate(found, ["strategy", at])


SCORERS: dict[str, Callable[[dict], Column]] = {}


def scorer(kind: str):
    """Registers how an artefact of this kind becomes a score column."""
    def register(fn):
        SCORERS[kind] = fn
        return fn

    return register


@scorer("logistic")
def _logistic(artefact: dict) -> Column:
    z = F.lit(float(artefact["bias"]))
    for name, weight, mean, scale in zip(artefact["features"], artefact["weights"], artefact["means"], artefact["scales"]):
        z = z + (F.col(name) - float(mean)) / float(scale) * float(weight)
    return 1 / (1 + F.exp(-z))


@scorer("linear")
def _linear(artefact: dict) -> Column:
    z = F.lit(float(artefact["bias"]))
    for name, weight in zip(artefact["features"], artefact["weights"]):
        z = z + F.col(name) * float(weight)
    return z


@scorer("trees")
def _trees(artefact: dict) -> Column:
    """Sum of binary trees, each a nested tuple (feature, cut, left, right) or a leaf; left is below the cut."""
    def node(tree) -> Column:
        if not isinstance(tree, (tuple, list)):
            return F.lit(float(tree))
        name, cut, left, right = tree
        return F.when(F.col(name) < float(cut), node(left)).otherwise(node(right))

    total = F.lit(float(artefact.get("bias", 0.0)))
    for tree in artefact["trees"]:
        total = total + node(tree)
    return total


def scored(streams: DataFrame, artefacts: dict[str, dict], kind: str = "stream_type", name: str = "score") -> DataFrame:
    """The rows with the score of the artefact of their stream type; types without one score null. All artefacts are
    columns of one projection, so no stream is read twice."""
    score = F.lit(None).cast("double")
    for stream_type, artefact in artefacts.items():
        if artefact["kind"] not in SCORERS:
            raise ValueError(f"no scorer for artefacts of kind {artefact['kind']}")
        score = F.when(F.col(kind) == stream_type, SCORERS[artefact["kind"]](artefact)).otherwise(score)
    return streams.withColumn(name, score)
