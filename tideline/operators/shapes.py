"""Causal pivots of a price path, valley-peak-valley shapes and how well they cluster."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import scan
from tideline.session import cut_lineage

TOLERANCES = (0.05, 0.10, 0.20, 0.35)
SHAPE_POINTS = 24
PIVOT_SCHEMA = "symbol string, tol double, pos long, ts timestamp_ntz, close double, kind int, confirm_pos long"


def _fall(x: np.ndarray, factor: float, first: int, top: float) -> tuple[int, float, int]:
    """First row from ``first`` on where x is down to ``factor`` times its maximum so far, which begins as ``top``; that
    maximum; and the row of it (-1: still ``top``). Without such a row, the length of x."""
    width, where = 64, -1
    while first < len(x):
        part = x[first:first + width]
        hits = np.flatnonzero(part <= factor * np.fmax.accumulate(np.fmax(part, top)))
        seen = np.where(np.isnan(part), -np.inf, part)[:hits[0] if len(hits) else None]
        if len(seen) and seen.max() > top:
            top, where = float(seen.max()), first + int(seen.argmax())
        if len(hits):
            return first + int(hits[0]), top, where
        first, width = first + len(part), 2 * width
    return len(x), top, where


class _Piece:
    """One piece of a price path. A state is a dict of open searches: way 1 for a peak, -1 for a valley, each with its
    extreme so far as (way * price, position, time). Two searches are open until the first turn, one after it. A
    valley is the peak of the price with its sign turned, so both ways are one rule."""

    def __init__(self, pdf: pd.DataFrame):
        self.close, self.pos, self.ts = pdf["close"].to_numpy(float), pdf["_pos"].to_numpy(), pdf["ts"].to_numpy()
        self.tol, self.size = float(pdf["tol"].iloc[0]), len(pdf)

    def mark(self, way: int, row: int) -> tuple:
        return float(way * self.close[row]), int(self.pos[row]), self.ts[row]

    def search(self, way: int, first: int, extreme: tuple) -> tuple[int, tuple]:
        row, _, where = _fall(way * self.close, 1 - way * self.tol, first, extreme[0])
        return row, extreme if where < 0 else self.mark(way, where)

    def turn(self, state: dict, first: int) -> tuple[int, int, dict]:
        """Way and row of the next turn (no turn: the length) and the open searches up to it."""
        found = {way: self.search(way, first, extreme) for way, extreme in state.items()}
        way = min(found, key=lambda w: (found[w][0], w))
        return way, found[way][0], {w: extreme for w, (_, extreme) in found.items()}

    def leaving(self, way: int, row: int, known: dict) -> dict:
        """State at the end of the piece after a search of this way turned at the row."""
        path = []
        while (way, row) not in known:
            path.append((way, row))
            nxt, at, open_ = self.turn({-way: self.mark(-way, row)}, row + 1)
            if at == self.size:
                known[way, row] = open_
            else:
                way, row = nxt, at
        for step in path:
            known[step] = known[way, row]
        return known[way, row]


UNSEEN = (-np.inf, -1, np.datetime64("NaT"))


def _answers(pdf: pd.DataFrame) -> dict:
    """What a piece makes of any state. A search that comes with extreme e turns at the first row down to factor * e, if
    that is before the piece's own first turn: only the piece's new lows can be that row, and each has its own end."""
    piece, known, out = _Piece(pdf), {}, {}
    for way in (1, -1):
        x = way * piece.close
        own, extreme = piece.search(way, 0, UNSEEN)
        rows = np.flatnonzero(x[:own] < np.fmin.accumulate(np.concatenate([[np.inf], x[:own]]))[:-1])
        turns = [*rows.tolist(), *([own] if own < piece.size else [])]
        out[way] = {"factor": 1 - way * piece.tol, "lows": x[rows], "turns": turns, "ends": [piece.leaving(way, r, known) for r in turns], "extreme": extreme}
    return out


def _cross(state: dict, answers: dict) -> dict:
    """State behind a piece."""
    turns = []
    for way, extreme in state.items():
        a = answers[way]
        k = int(np.searchsorted(-a["lows"], -a["factor"] * extreme[0]))
        if k < len(a["turns"]):
            turns.append((a["turns"][k], way, k))
    if turns:
        _, way, k = min(turns)
        return answers[way]["ends"][k]
    return {way: answers[way]["extreme"] if answers[way]["extreme"][0] > extreme[0] else extreme for way, extreme in state.items()}


def _turns(pdf: pd.DataFrame, state: dict) -> pd.DataFrame:
    piece, out, row = _Piece(pdf), [], -1
    symbol = pdf["symbol"].iloc[0]
    while True:
        way, row, state = piece.turn(state, row + 1)
        if row == piece.size:
            return pd.DataFrame(out, columns=[f.split()[0] for f in PIVOT_SCHEMA.split(", ")])
        top, pos, ts = state[way]
        out.append((symbol, piece.tol, pos, ts, way * top, way, int(piece.pos[row])))
        state = {-way: piece.mark(-way, row)}


def pivots(closes: DataFrame, tolerances: Sequence[float] = TOLERANCES, chunk: str = "month", rows: int | None = None) -> DataFrame:
    """A valley is confirmed once the price stands tol above it, a peak once it stands tol below. Prices are positive
    and tolerances below 1; a row without a price turns nothing. A series is cut into pieces of ``rows`` rows that hand
    their open searches on, so no task holds a symbol; the pieces do not change the result."""
    d = scan.pieces(closes.select("symbol", "ts", "close"), chunk=chunk, rows=rows)
    d = d.withColumn("tol", F.explode(F.array(*[F.lit(float(x)) for x in tolerances])))
    return scan.relay(d, ["symbol", "tol"], _answers, _cross, {1: UNSEEN, -1: UNSEEN}, _turns, PIVOT_SCHEMA)


def mountains(closes: DataFrame, piv: DataFrame, points: int = SHAPE_POINTS, chunk: str = "month") -> DataFrame:
    """Confirmed valley-peak-valley triples with attributes and a scale-free shape. The path is
    sampled at ``points`` positions by equi-joins on the row number."""

    def nxt(d, w):
        return d.withColumns({f"{c}{k}": F.lead(c, k).over(w) for k in (1, 2) for c in ("pos", "ts", "close", "kind", "confirm_pos")})

    m = scan.over_series(piv, nxt, keys=("symbol", "tol"), order=("pos",), ahead=2, chunk=512)
    m = m.where("kind = -1 AND kind1 = 1 AND kind2 = -1")
    dur, up = F.col("pos2") - F.col("pos"), F.col("pos1") - F.col("pos")
    m = m.select(
        "symbol", "tol", F.col("pos").alias("v1"), F.col("ts").alias("t_v1"), F.col("ts1").alias("t_peak"), F.col("ts2").alias("t_v2"), F.col("confirm_pos2").alias("confirm_pos"),
        dur.alias("dur"), up.alias("up"), (dur - up).alias("down"), ((F.col("close1") / F.col("close") - 1) * 100).alias("height_pct"), ((1 - F.col("close2") / F.col("close1")) * 100).alias("drop_pct"),
        (up / dur).alias("asym_time"), (F.col("close2") / F.col("close")).alias("valley_ratio"))
    at = F.col("v1") + F.col("dur") * F.col("_i") / (points - 1.0)
    s = m.select("symbol", "tol", "v1", "dur", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")).withColumns({"_at": at, "_lo": F.floor(at)})
    s = s.withColumn("_hi", F.least(F.col("_lo") + 1, F.col("v1") + F.col("dur")))
    px = scan.number_rows(closes.select("symbol", "ts", "close"), chunk=chunk).select("symbol", F.col("_pos"), "close")
    s = s.join(px.select("symbol", F.col("_pos").alias("_lo"), F.col("close").alias("_cl")), ["symbol", "_lo"]).join(
        px.select("symbol", F.col("_pos").alias("_hi"), F.col("close").alias("_ch")), ["symbol", "_hi"])
    s = s.withColumn("_y", F.col("_cl") + (F.col("_ch") - F.col("_cl")) * (F.col("_at") - F.col("_lo")))
    g = s.groupBy("symbol", "tol", "v1").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_y"))), lambda e: e["_y"]).alias("_p"))
    lo, hi = F.array_min("_p"), F.array_max("_p")
    g = g.withColumns({"_lo": lo, "_rng": hi - lo})
    g = g.withColumn("shape", F.transform("_p", lambda y: F.when(F.col("_rng") > 0, (y - F.col("_lo")) / F.nullif(F.col("_rng"), F.lit(0.0))).otherwise(0.0)))
    return m.join(g.select("symbol", "tol", "v1", "shape"), ["symbol", "tol", "v1"])


def silhouette_by_k(shapes: DataFrame, ks: Sequence[int], seed: int = 42) -> list[tuple[int, float]]:
    d = cut_lineage(shapes.select(array_to_vector("shape").alias("features")))
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    return [(k, float(ev.evaluate(KMeans(k=k, seed=seed).fit(d).transform(d)))) for k in ks]
