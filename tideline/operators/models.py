"""Model fitting and scoring: MLlib estimators, ridge from mergeable moment sums, frozen scores."""
from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import rules
from tideline.operators import joins, scan
from tideline.session import cut_lineage

SEED = 42


def _stages(features: Sequence[str], scaled: bool):
    va = VectorAssembler(inputCols=list(features), outputCol="_raw" if scaled else "_x", handleInvalid="skip")
    return [va, StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)] if scaled else [va]


def with_balance(df: DataFrame, y: str) -> DataFrame:
    """Class weights n / (2 * n_class), from one small aggregate."""
    n = df.groupBy(y).agg(F.count(F.lit(1)).alias("_c"))
    tot = n.agg(F.sum("_c").alias("_n"))
    w = n.crossJoin(F.broadcast(tot)).select(y, (F.col("_n") / (2.0 * F.col("_c"))).alias("_w"))  # two rows x one row
    return df.join(F.broadcast(w), y)


def fit_logistic(train: DataFrame, features: Sequence[str], y: str = "y", c: float = 1.0, balanced: bool = True) -> PipelineModel:
    """L2 logistic regression in the C convention: regParam = 1 / (C * total weight)."""
    d = train.dropna(subset=[*features, y])
    d = cut_lineage(d.select(*features, y))  # every solver pass reads this, not the joins behind it
    d = with_balance(d, y) if balanced else d.withColumn("_w", F.lit(1.0))
    total = d.agg(F.sum("_w")).first()[0]
    lr = LogisticRegression(featuresCol="_x", labelCol=y, weightCol="_w", regParam=1.0 / (c * total), elasticNetParam=0.0,
                            standardization=False, maxIter=200, tol=1e-9, probabilityCol="_prob", rawPredictionCol="_rawp", predictionCol="_pred")
    return Pipeline(stages=[*_stages(features, True), lr]).fit(d.withColumn(y, F.col(y).cast("double")))


def _sums(rows: DataFrame, features: Sequence[str], y: str, at: str, dates: list[np.ndarray], part) -> np.ndarray:
    """Sum over all rows of part(x, y, member): one row of numbers for each fit. Tasks read the rows once for all
    fits, whose training dates they know, and send one partial sum for each cell; the driver gets fits x numbers."""
    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.asarray(batch.column(c)) for c in features]).astype(float)
            when, code = np.unique(np.asarray(batch.column(at).cast("timestamp[us]")).astype("datetime64[us]").astype(np.int64), return_inverse=True)
            member = np.column_stack([np.isin(when, d, assume_unique=True) for d in dates])[code].astype(float)
            own = part(x, np.asarray(batch.column(y)).astype(float), member)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    cells = rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r["cell"] for r in cells), default=-1) + 1)
    for r in cells:
        out[r["cell"]] = r["v"]
    return out.reshape(len(dates), -1) if len(out) else np.zeros((len(dates), 0))


def fit_logistic_many(train: DataFrame, features: Sequence[str], dates: dict, y: str = "y", at: str = "ts", c: float | dict = 1.0, balanced: bool = True,
                      tol: float = 1e-10, most: int = 50) -> dict:
    """One penalised logistic fit, as ``fit_logistic``, for every key of ``dates`` on the rows of its training dates
    (datetime64 arrays, bounded by the calendar), all at once: {key: {features, mean, scale, coef, intercept}}.

    Newton steps; one job a step sums the gradients, Hessians and losses of all fits in one pass over the rows, which
    are not copied for a fit. A step that raises a fit's loss is halved for that fit. Fits without rows of both classes are left out."""
    d = cut_lineage(train.dropna(subset=[*features, y]).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("double").alias(y), at))
    keys, p = list(dates), len(features)
    when = [np.sort(np.asarray(dates[k], "datetime64[us]").astype(np.int64)) for k in keys]
    moments = _sums(d, features, y, at, when, lambda x, t, m: np.column_stack([m.sum(0), m.T @ t, m.T @ x, m.T @ (x * x)]))
    if not moments.size:
        return {}
    good = np.flatnonzero((moments[:, 1] > 0) & (moments[:, 1] < moments[:, 0]) & (moments[:, 0] > 1))
    keys, when, moments = [keys[i] for i in good], [when[i] for i in good], moments[good]
    n, ones = moments[:, 0], moments[:, 1]
    mean = moments[:, 2:2 + p] / n[:, None]
    scale = np.sqrt(np.maximum(moments[:, 2 + p:] - n[:, None] * mean ** 2, 0) / (n - 1)[:, None])
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    weight = np.stack([n / (2 * (n - ones)), n / (2 * ones)], axis=1) if balanced else np.ones((len(keys), 2))
    penalty = np.array([[0.0] + [1.0 / (c[k] if isinstance(c, dict) else c)] * p for k in keys])
    beta = np.zeros((len(keys), p + 1))
    last, step = np.full(len(keys), np.inf), np.zeros_like(beta)
    live = np.ones(len(keys), bool)

    def part(x, t, member, beta):
        out = np.empty((len(beta), 1 + (p + 1) + (p + 1) ** 2))
        for k in range(len(beta)):
            on = member[:, k] > 0
            z = np.column_stack([np.ones(on.sum()), (x[on] - mean[k]) * inverse[k]])
            w, own = weight[k][t[on].astype(int)], t[on]
            eta = z @ beta[k]
            prob = 1 / (1 + np.exp(-eta))
            out[k, 0] = (w * (np.logaddexp(0, eta) - own * eta)).sum()
            out[k, 1:p + 2] = z.T @ (w * (prob - own))
            out[k, p + 2:] = ((z * (w * prob * (1 - prob))[:, None]).T @ z).ravel()
        return out

    for _ in range(most):
        sums = _sums(d, features, y, at, when, lambda x, t, m, b=beta.copy(): part(x, t, m, b))
        loss = sums[:, 0] + 0.5 * (penalty * beta ** 2).sum(1)
        worse = live & (loss > last + 1e-9 * np.abs(last))
        step[worse] /= 2
        beta[worse] -= step[worse]
        for k in np.flatnonzero(live & ~worse):
            hessian = sums[k, p + 2:].reshape(p + 1, p + 1) + np.diag(penalty[k])
            step[k] = -np.linalg.solve(hessian, sums[k, 1:p + 2] + penalty[k] * beta[k])
            live[k] = np.abs(step[k]).max() > tol
            beta[k] += step[k]
            last[k] = loss[k]
        if not live.any():
            break
    return {k: {"features": list(features), "mean": mean[i].tolist(), "scale": scale[i].tolist(), "coef": beta[i, 1:].tolist(), "intercept": float(beta[i, 0])} for i, k in enumerate(keys)}


def score_many(df: DataFrame, fits: dict, key: str, name: str = "p") -> DataFrame:
    """Each row's probability from the fit of its key; rows of keys without a fit go. The fits are a table of one row each."""
    if not fits:
        return df.withColumn(name, F.lit(None).cast("double")).limit(0)
    features = next(iter(fits.values()))["features"]
    rows = [(k, f["intercept"], *f["coef"], *f["mean"], *f["scale"]) for k, f in fits.items()]
    names = [f"_{part}{i}" for part in ("c", "m", "s") for i in range(len(features))]
    table = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(n, T.DoubleType()) for n in ("_b", *names)]]))
    z = F.col("_b")
    for i, f in enumerate(features):
        z = z + F.when(F.col(f"_s{i}") > 0, F.col(f"_c{i}") * (F.col(f) - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(F.col(f) * 0)
    return df.join(F.broadcast(table), key).withColumn(name, 1 / (1 + F.exp(-z))).drop("_b", *names)


def fit_boosted(train: DataFrame, features: Sequence[str], y: str = "y", kind: str = "class", depth: int = 3, step: float = 0.05,
                rounds: int = 20, validation: str | None = None):
    extra = [validation] if validation else []
    d = cut_lineage(train.dropna(subset=[*features, y]).select(*features, *extra, F.col(y).cast("double").alias(y)))
    common = dict(featuresCol="_x", labelCol=y, maxDepth=depth, stepSize=step, maxIter=rounds, seed=SEED)
    if validation:
        common["validationIndicatorCol"] = validation
    est = (GBTClassifier(predictionCol="_pred", **common).setProbabilityCol("_prob").setRawPredictionCol("_rawp") if kind == "class"
           else GBTRegressor(predictionCol="_pred", **common))
    return Pipeline(stages=[*_stages(features, False), est]).fit(d)


def score(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df)
    value = vector_to_array("_prob")[1] if "_prob" in out.columns else F.col("_pred")
    return out.withColumn(name, value).drop("_raw", "_x", "_prob", "_rawp", "_pred", "_w")


# ---- frozen artefacts -------------------------------------------------------------------------
def _digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def freeze(model: PipelineModel, features: Sequence[str]) -> dict:
    """JSON artefact of a fitted logistic pipeline, sealed with a hash of its canonical form."""
    sc, lr = model.stages[1], model.stages[2]
    body = {"features": list(features), "mean": [float(v) for v in sc.mean], "scale": [float(v) for v in sc.std],
            "coef": [float(v) for v in lr.coefficients], "intercept": float(lr.intercept)}
    return {**body, "sha256": _digest(body)}


def seal(body: dict) -> dict:
    return {**body, "sha256": _digest(body)}


def score_frozen(df: DataFrame, artefact: dict, name: str = "p") -> DataFrame:
    """Scores with a frozen model; refuses one whose content no longer matches its hash."""
    body = {k: v for k, v in artefact.items() if k != "sha256"}
    if _digest(body) != artefact.get("sha256"):
        raise ValueError("frozen model does not match its hash")
    return df.withColumn(name, rules.logistic_score(artefact))


# ---- ridge from moment sums ------------------------------------------------------------------
def moment_terms(features: Sequence[str], y: str) -> dict[str, F.Column]:
    x = [F.col(f) for f in features]
    t = {"m_n": F.lit(1.0), "m_y": F.col(y)}
    for i, a in enumerate(x):
        t[f"m_{i}"] = a
        t[f"m_{i}_y"] = a * F.col(y)
        for j in range(i, len(x)):
            t[f"m_{i}_{j}"] = a * x[j]
    return t


def _solve(row: dict, p: int, alpha: float) -> list[float]:
    n = row["m_n"]
    mean = np.array([row[f"m_{i}"] / n for i in range(p)])
    cov = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] / n for j in range(p)] for i in range(p)]) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    sd[sd == 0] = 1.0
    ybar = row["m_y"] / n
    xy = np.array([row[f"m_{i}_y"] / n for i in range(p)]) - mean * ybar
    beta = np.linalg.solve(n * cov / np.outer(sd, sd) + alpha * np.eye(p), n * xy / sd) / sd
    return [float(ybar - beta @ mean), *map(float, beta)]


def _solver(features: Sequence[str], keep: Sequence[T.StructField], alpha: float, min_rows: int):
    p = len(features)
    schema = T.StructType([*keep, T.StructField("n_train", T.DoubleType()), T.StructField("train_mean", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
                           *[T.StructField(f"w_{f}", T.DoubleType()) for f in features]])

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if r["m_n"] is not None and r["m_n"] >= max(min_rows, p + 2):
                    rows.append([r[k.name] for k in keep] + [r["m_n"], r["m_y"] / r["m_n"]] + _solve(r, p, alpha))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return run, schema


def ridge(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """One ridge fit per key on standardised features; a single pass of mergeable sums."""
    d = df.dropna(subset=[*features, y])
    g = d.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in moment_terms(features, y).items()])
    run, schema = _solver(features, [df.schema[k] for k in keys], alpha, 0)
    return g.mapInPandas(run, schema)


def walk_forward_ridge(df: DataFrame, stamps: DataFrame, features: Sequence[str], y: str, gap_hours: int, alpha: float = 1.0,
                       min_rows: int = 30, chunk: str = "month") -> DataFrame:
    """One fit per stamp on rows with ts <= stamp - gap. Moments are summed per date, accumulated
    over dates, and looked up as of each stamp: no row is read once per stamp."""
    terms = moment_terms(features, y)
    d = df.dropna(subset=[*features, y])
    per_date = d.groupBy("ts").agg(*[F.sum(c).alias(n) for n, c in terms.items()]).withColumn("_g", F.lit(0))
    per_date = cut_lineage(per_date)  # one row per date
    cum = scan.running(per_date, [("sum", F.col(n), f"c_{n}") for n in terms], ["_g"], ["ts"], chunk)
    cum = cum.select("_g", "ts", *[F.col(f"c_{n}").alias(n) for n in terms])
    probe = stamps.select("ts").withColumns({"_g": F.lit(0), "_at": F.col("ts") - F.expr(f"interval {gap_hours} hours")})
    got = joins.as_of(probe, cum, ["_g"], list(terms), at="_at", chunk=chunk).drop("_g", "_at", "asof_ts")
    run, schema = _solver(features, [df.schema["ts"]], alpha, min_rows)
    return got.mapInPandas(run, schema)


def apply_linear(df: DataFrame, weights: DataFrame, features: Sequence[str], name: str = "pred") -> DataFrame:
    """Prediction of each row with the model of its date."""
    d = df.join(weights, "ts")
    z = F.col("intercept")
    for f in features:
        z = z + F.col(f"w_{f}") * F.col(f)
    return d.withColumn(name, z).drop("intercept", "n_train", *[f"w_{f}" for f in features])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key with average ranks for ties."""
    keys = list(keys)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    d = scan.mid_ranks(scan.mid_ranks(d, keys, "_x", "_rx"), keys, "_y", "_ry")
    return d.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("ic"), F.count(F.lit(1)).alias("n"))


def skill(preds: DataFrame, pred: str, y: str, active: float, baseline: str = "train_mean") -> DataFrame:
    """Out-of-sample R2 against the training mean of each stamp, rank IC and hit rate on
    predictions beyond the dead zone."""
    d = preds.dropna(subset=[pred, y]).withColumn("_g", F.lit(0))
    hit = F.when(F.abs(pred) >= active, (F.signum(pred) == F.signum(y)).cast("double"))
    a = d.groupBy("_g").agg(
        (1 - F.sum(F.pow(F.col(y) - F.col(pred), 2)) / F.sum(F.pow(F.col(y) - F.col(baseline), 2))).alias("r2_oos"),
        F.avg(hit).alias("hit_rate"), F.count(hit).alias("n_active"))
    return a.join(spearman(d, ["_g"], pred, y), "_g").drop("_g")


def dead_zone(preds: DataFrame, pred: str, tau: float, cap: float = 0.95) -> DataFrame:
    """Predictions beyond the dead zone as signals with capped confidence."""
    return preds.where(F.abs(pred) >= tau).withColumns({
        "direction": F.when(F.col(pred) > 0, "BUY").otherwise("SELL"), "confidence": F.least(F.abs(pred), F.lit(cap))})
