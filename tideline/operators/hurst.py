"""Rolling estimates that need a small numeric kernel: Hurst exponent and GARCH(1,1). Spark cuts
each series into overlapping pieces (``scan.map_blocks``); the kernels below see one piece."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import scan


def rescaled_range(closes: np.ndarray, window: int, n_scales: int = 6) -> np.ndarray:
    """Rolling simplified R/S exponent: slope of log(range/std of the price increments) on
    log(scale) over log-spaced scales, vectorised over all windows of the piece."""
    n = len(closes)
    out = np.full(n, np.nan)
    if n < window:
        return out
    win = np.lib.stride_tricks.sliding_window_view(closes.astype(float), window)
    scales = np.unique(np.floor(np.logspace(np.log10(8), np.log10(window), n_scales)).astype(int))
    logs = []
    for m in scales:
        k = window // m
        seg = win[:, : k * m].reshape(len(win), k, m)
        spread = seg.max(axis=2) - seg.min(axis=2)
        sd = np.diff(seg, axis=2).std(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            rs = np.where(sd > 0, spread / sd, np.nan)
        logs.append(np.log(np.nanmean(rs, axis=1)))
    y, x = np.array(logs), np.log(scales)[:, None]
    xc = x - x.mean()
    with np.errstate(invalid="ignore"):
        slope = (xc * (y - y.mean(axis=0))).sum(axis=0) / (xc**2).sum()
    out[window - 1:] = np.clip(slope, 0.0, 1.0)
    return out


def rolling_hurst(candles: DataFrame, window: int = 200, name: str = "hurst", rows: int | None = None, chunk: str = "month") -> DataFrame:
    schema = T.StructType([*candles.schema.fields, T.StructField(name, T.DoubleType())])

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        h = rescaled_range(pdf["close"].to_numpy(), window)
        return pdf.assign(**{name: pd.Series(h, dtype="object").where(~np.isnan(h), None)})

    return scan.map_blocks(candles, piece, schema, back=window - 1, rows=rows, chunk=chunk)


def garch_filter(r: np.ndarray, omega: float, alpha: float, beta: float, v0: float) -> np.ndarray:
    v, out = v0, np.empty(len(r))
    for i, x in enumerate(r):
        v = omega + alpha * x * x + beta * v
        out[i] = v
    return out


GRID = np.array([(a, b) for a in (0.02, 0.05, 0.08, 0.12, 0.18, 0.25) for b in (0.5, 0.65, 0.75, 0.82, 0.88, 0.92, 0.95) if a + b < 0.999])


def garch_fit(r: np.ndarray) -> tuple[float, float, float]:
    """Gaussian likelihood on a coarse grid with variance targeting, all grid points at once; returns omega, alpha, beta."""
    var, (alpha, beta) = float(np.var(r)), GRID.T
    omega = var * (1 - alpha - beta)
    v, nll = np.full(len(GRID), var), np.zeros(len(GRID))
    for x in r:
        nll += np.log(v) + x * x / v
        v = omega + alpha * x * x + beta * v
    best = int(np.argmin(nll))
    return float(omega[best]), float(alpha[best]), float(beta[best])


def rolling_garch(returns: DataFrame, ret: str = "log_ret", window: int = 500, min_rows: int = 50, refit: int = 24, step_seconds: int = 3600,
                  name: str = "garch_vol", rows: int | None = None, chunk: str = "month") -> DataFrame:
    """Conditional volatility for each row: parameters refitted every ``refit`` steps of ``step_seconds`` since the epoch
    on the ``window`` returns (scaled by 100) up to the first row of the stretch, filtered over that window in between.
    Stretches follow the clock, so a piece or the tail of a series gives the same values as the whole; rows must be
    ``step_seconds`` apart at least."""
    schema = T.StructType([*returns.schema.fields, T.StructField(name, T.DoubleType())])

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf[ret].to_numpy(dtype=float) * 100
        stretch = pdf["ts"].to_numpy("datetime64[s]").astype(np.int64) // (step_seconds * refit)
        out = np.full(len(r), np.nan)
        for first in np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]])) if len(r) else ():
            fit = r[max(0, first - window + 1):first + 1]
            fit = fit[~np.isnan(fit)]
            if len(fit) < min_rows:
                continue
            var = float(np.var(fit))
            if var <= 0:
                continue
            w, a, b = garch_fit(fit)
            v = float(garch_filter(fit, w, a, b, var)[-1])
            for i in range(first, len(r)):
                if stretch[i] != stretch[first]:
                    break
                if i > first:
                    x = 0.0 if np.isnan(r[i]) else r[i]
                    v = w + a * x * x + b * v
                out[i] = np.sqrt(v) / 100
        return pdf.assign(**{name: pd.Series(out, dtype="object").where(~np.isnan(out), None)})

    return scan.map_blocks(returns, piece, schema, back=window + refit, rows=rows, chunk=chunk)


def garch_fixed(returns: DataFrame, omega: float, alpha: float, beta: float, v0: float, ret: str = "ret", name: str = "garch_var",
                **kw) -> DataFrame:
    """Fixed-parameter conditional variance, an affine scan over the series."""
    x = F.coalesce(F.col(ret), F.lit(0.0))
    return scan.affine_scan(returns, F.lit(beta), omega + alpha * x * x, name, init=v0, **kw)
