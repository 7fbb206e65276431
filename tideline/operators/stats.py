"""Serial-dependence statistics as sums over lagged rows, and resampling where a replicate is a
key: replicates spread over the cluster instead of looping on one core."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import normal
from tideline.operators import sampling, scan
from tideline.operators import timeseries as ts
from tideline.operators.timeseries import ratio

MIN_OBS = 100


# ---- Sharpe family -----------------------------------------------------------------------------
def sharpe_moments(df: DataFrame, keys: Sequence[str], ret: str) -> DataFrame:
    """n, Sharpe (sample std), population skew and non-excess kurtosis, and the PSR denominator."""
    g = df.groupBy(*keys).agg(
        F.count(ret).alias("n"), ratio(F.avg(ret), F.stddev_samp(ret)).alias("sharpe"), F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurt"))
    s = F.col("sharpe")
    return g.withColumn("scale", F.sqrt(F.greatest(1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s, F.lit(1e-12))))


def psr(df: DataFrame, keys: Sequence[str], ret: str, benchmark: float = 0.0) -> DataFrame:
    """Probability that the true Sharpe ratio exceeds the benchmark."""
    m = sharpe_moments(df, keys, ret)
    z = (F.col("sharpe") - benchmark) * F.sqrt(F.col("n") - 1) / F.col("scale")
    return m.withColumn("z", z).withColumn("psr", normal.cdf("z"))


def deflated(df: DataFrame, keys: Sequence[str], ret: str, trials: int) -> DataFrame:
    """PSR against the expected best Sharpe ratio of ``trials`` independent tries."""
    m = sharpe_moments(df, keys, ret)
    var = (1 + F.col("sharpe") ** 2 / 2) / (F.col("n") - 1)
    bench = F.sqrt(var) * normal.expected_max_z(trials)
    z = (F.col("sharpe") - bench) * F.sqrt(F.col("n") - 1) / F.col("scale")
    return m.withColumns({"benchmark": bench, "z": z}).withColumn("dsr", normal.cdf("z"))


# ---- dependence statistics ------------------------------------------------------------------
def _centred(df: DataFrame, keys, x: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull())
    return scan.with_group(d, keys, _mu=F.avg(x)).withColumn("_d", F.col(x) - F.col("_mu"))


def variance_ratio(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, q: int, with_z: bool = True, chunk: str | int = "month") -> DataFrame:
    """VR(q) from overlapping sums, bias-corrected, with the heteroskedasticity-robust z. Null
    below max(4q, 100) observations or for a constant series."""
    keys = list(keys)
    lags = range(1, q) if with_z else []

    def build(d, w):
        d = d.withColumn("_s", F.when(F.count("_d").over(w.rowsBetween(-(q - 1), 0)) == q, F.sum(x).over(w.rowsBetween(-(q - 1), 0))))
        return d.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in lags}) if with_z and q > 1 else d

    d = scan.over_series(_centred(df, keys, x), build, keys=keys, order=order, back=q, chunk=chunk)
    d2 = F.col("_d") * F.col("_d")
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d2).alias("_ss"), F.sum(F.pow(F.col("_s") - q * F.col("_mu"), 2)).alias("_sq"),
        *[F.sum(d2 * F.col(f"_l{k}") * F.col(f"_l{k}")).alias(f"_k{k}") for k in lags])
    t = F.col("n").cast("double")
    m = q * (t - q + 1) * (1 - q / t)
    vr = ratio(F.col("_sq") / m, F.col("_ss") / (t - 1))
    theta = sum(((2.0 * (q - k) / q) ** 2 * F.col(f"_k{k}") for k in lags), F.lit(0.0)) / F.nullif(F.col("_ss") * F.col("_ss"), F.lit(0.0))
    ok = (t >= max(4 * q, MIN_OBS)) & (F.col("_ss") > 0)
    g = g.withColumn("vr", F.when(ok, vr))
    z = F.when(theta > 0, (F.col("vr") - 1) / F.sqrt(theta)) if with_z else F.lit(None).cast("double")
    return g.withColumn("z", z).select(*keys, "n", "vr", "z")


def rho_robust(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, chunk: str | int = "month") -> DataFrame:
    """AR(1) coefficient and its White standard error from one pass of cross moments."""
    keys = list(keys)
    d = scan.over_series(_centred(df, keys, x), lambda d, w: d.withColumn("_p", F.lag("_d").over(w)), keys=keys, order=order, back=1, chunk=chunk)
    a, b = F.col("_d"), F.col("_p")
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a * b).alias("_ab"), F.sum(b * b).alias("_bb"), F.sum(a * a * b * b).alias("_aabb"),
        F.sum(a * b * b * b).alias("_abbb"), F.sum(b * b * b * b).alias("_bbbb"))
    rho = ratio(F.col("_ab"), F.col("_bb"))
    var = F.col("_aabb") - 2 * rho * F.col("_abbb") + rho * rho * F.col("_bbbb")
    ok = (F.col("n") >= MIN_OBS) & (F.col("_bb") > 0)
    return g.select(*keys, "n", F.when(ok, rho).alias("rho"), F.when(ok, F.sqrt(F.greatest(var, F.lit(0.0))) / F.col("_bb")).alias("se"))


def sign_persistence(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, chunk: str | int = "month") -> DataFrame:
    keys = list(keys)
    d = df.where(F.col(x).isNotNull())
    d = scan.over_series(d, lambda d, w: d.withColumn("_p", F.lag(x).over(w)), keys=keys, order=order, back=1, chunk=chunk)
    d = d.where((F.col(x) != 0) & (F.col("_p") != 0))
    same = (F.signum(x) == F.signum("_p")).cast("double")
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.when(F.count(F.lit(1)) >= MIN_OBS, F.avg(same)).alias("persistence"))


def trend_premium(df: DataFrame, keys: Sequence[str], past: str, fwd: str, min_rows: int = 30, min_side: int = 5) -> DataFrame:
    """Mean forward return after an up and after a down past, their difference and the share of equal signs, over rows
    with a past that is not 0. Null below ``min_rows`` rows; the means also where a side has under ``min_side`` rows."""
    d = df.where(F.col(past).isNotNull() & F.col(fwd).isNotNull() & (F.col(past) != 0))
    up, dn = F.col(past) > 0, F.col(past) < 0
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(up).alias("_up"), F.avg(F.when(up, F.col(fwd))).alias("after_up"), F.avg(F.when(dn, F.col(fwd))).alias("after_down"),
                             F.avg((F.signum(past) == F.signum(fwd)).cast("double")).alias("persistence"))
    enough = F.col("n") >= min_rows
    sides = enough & (F.col("_up") >= min_side) & (F.col("n") - F.col("_up") >= min_side)
    g = g.withColumns({"persistence": F.when(enough, F.col("persistence")), "after_up": F.when(sides, F.col("after_up")), "after_down": F.when(sides, F.col("after_down"))})
    return g.withColumn("premium", F.col("after_up") - F.col("after_down")).drop("_up")


def stepped_returns(df: DataFrame, horizons: Sequence[int], value: str = "close", chunk: str | int = "month") -> DataFrame:
    """(symbol, ts, h, past, fwd): for every horizon the rows h apart in each symbol, so that their returns don't overlap."""
    far = max(horizons)

    def build(d, w):
        return d.withColumns({**{f"_p{h}": ts.lag_return(value, h, w) for h in horizons}, **{f"_f{h}": ts.lead_return(value, h, w) for h in horizons}})

    d = scan.over_series(scan.number_rows(df, chunk=chunk, name="row_no"), build, back=far, ahead=far, chunk=chunk)
    parts = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_p{h}").alias("past"), F.col(f"_f{h}").alias("fwd")) for h in horizons])
    return d.select("symbol", "ts", "row_no", F.explode(parts).alias("_r")).select("symbol", "ts", "row_no", "_r.*").where("row_no > 0 AND row_no % h = 0").drop("row_no")


# ---- resampling ------------------------------------------------------------------------------
def replicated(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def wild_bootstrap(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, q: int, reps: int, seed: int = 42, chunk: str | int = "month") -> DataFrame:
    """Two-sided p-value of VR(q) = 1 under random signs, hashed from (seed, replicate, row)."""
    keys = list(keys)
    flip = F.when(F.xxhash64(F.lit(seed), "rep", *keys, *order).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
    r = replicated(df.where(F.col(x).isNotNull()), reps).withColumn("_x", F.col(x) * flip)
    boot = variance_ratio(r, [*keys, "rep"], order, "_x", q, False, chunk).select(*keys, "rep", F.col("vr").alias("_vb"))
    real = variance_ratio(df, keys, order, x, q, False, chunk).select(*keys, "vr")
    j = boot.join(real, keys)
    hits = F.count_if(F.abs(F.col("_vb") - 1) >= F.abs(F.col("vr") - 1))
    return j.groupBy(*keys).agg(F.max("vr").alias("vr"), F.when(F.max("vr").isNotNull(), (hits + 1) / (F.count(F.lit(1)) + 1.0)).alias("p_value"))


def block_index(dates: DataFrame, reps: int, block: int, seed: int = 42) -> DataFrame:
    """(rep, pos, k): positions of a replicate mapped to source positions k in moving blocks.
    ``dates`` has one row per date with its index k."""
    n = dates.agg(F.max("k").alias("_t")).withColumn("_t", F.col("_t") + 1)
    r = n.select("_t", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    r = r.select("rep", "_t", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_t") / block).cast("int") - 1)).alias("_b"))
    start = F.floor(sampling.hash01(seed, "rep", "_b") * (F.col("_t") - block + 1))
    r = r.withColumn("_s", start).select("rep", "_t", "_b", "_s", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_i"))
    return r.select("rep", (F.col("_b") * block + F.col("_i")).cast("long").alias("pos"), (F.col("_s") + F.col("_i")).alias("k"), "_t").where(F.col("pos") < F.col("_t")).drop("_t")


def block_bootstrap_median(panel: DataFrame, x: str, q: int, reps: int, block: int = 56, seed: int = 42, chunk: str = "month") -> DataFrame:
    """90 % interval of the cross-sectional median of VR(q), resampling dates in moving blocks so
    that symbols keep their common dates."""
    from tideline.operators import cross

    dates = cross.numbered_dates(panel, "k")
    idx = block_index(dates, reps, block, seed).join(dates, "k").select("rep", "pos", "ts")
    rows = idx.join(panel.select("symbol", "ts", x), "ts").select("rep", "symbol", "pos", x)
    vr = variance_ratio(rows, ["rep", "symbol"], ["pos"], x, q, False, 512)
    med = scan.quantiles(vr, ["rep"], "vr", [0.5], ["_m"])
    real = scan.quantiles(variance_ratio(panel, ["symbol"], ["ts"], x, q, False, chunk), [], "vr", [0.5], ["median"])
    return scan.quantiles(med, [], "_m", [0.05, 0.95], ["lo90", "hi90"]).crossJoin(F.broadcast(real))  # one row x one row


def permutation_twin(df: DataFrame, keys: Sequence[str], x: str, order: Sequence[str], q: int, reps: int, seed: int = 42, chunk: str | int = "month") -> DataFrame:
    """VR(q) minus the median VR of hash-ordered permutations."""
    keys = list(keys)
    r = replicated(df.where(F.col(x).isNotNull()), reps)
    r = r.withColumn("_h", sampling.hash01(seed, "rep", *keys, *order)).withColumn("_t", F.concat_ws("|", *[F.col(o).cast("string") for o in order]))
    r = scan.number_by_value(r, [*keys, "rep"], "_h", "_t", "pos")
    return _residual(df, r, keys, x, order, q, chunk)


def block_twin(df: DataFrame, keys: Sequence[str], x: str, order: Sequence[str], q: int, reps: int, block: int = 20, seed: int = 42,
               chunk: str | int = "month") -> DataFrame:
    """VR(q) minus the median VR of series rebuilt from moving blocks of themselves."""
    return _residual(df, twin_rows(df, keys, x, order, reps, block, seed, chunk), list(keys), x, order, q, chunk)


def twin_rows(df: DataFrame, keys: Sequence[str], x: str, order: Sequence[str], reps: int, block: int = 20, seed: int = 42, chunk: str | int = "month") -> DataFrame:
    """(keys, rep, pos, x): block-resampled twins of every series."""
    keys = list(keys)
    src = scan.number_rows(df.where(F.col(x).isNotNull()), keys, order, chunk, "k").select(*keys, "k", x)
    t = src.groupBy(*keys).agg((F.max("k") + 1).alias("_t")).where(F.col("_t") >= block)
    r = replicated(t, reps)
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_t") / block).cast("int") - 1)).alias("_b"))
    r = r.withColumn("_s", F.floor(sampling.hash01(seed, "rep", "_b", *keys) * (F.col("_t") - block + 1)))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_i"))
    r = r.withColumns({"pos": (F.col("_b") * block + F.col("_i")).cast("long"), "k": F.col("_s") + F.col("_i")}).where(F.col("pos") < F.col("_t"))
    return r.select(*keys, "rep", "pos", "k").join(src, [*keys, "k"]).drop("k")


def synthetic_twin(prices: DataFrame, reps: int, block: int = 20, seed: int = 42, chunk: str = "month") -> DataFrame:
    """Price paths rebuilt from moving blocks of log returns, starting at the real first price."""
    from tideline.operators import timeseries as ts

    r = ts.returns(prices, chunk=chunk).where("log_ret IS NOT NULL")
    t = twin_rows(r, ["symbol"], "log_ret", ["ts"], reps, block, seed, chunk)
    p0 = prices.groupBy("symbol").agg(F.min_by("close", "ts").alias("_p0"))
    c = scan.running(t, [("sum", F.col("log_ret"), "_lr")], ["symbol", "rep"], ["pos"], 512)
    return c.join(p0, "symbol").select("symbol", "rep", "pos", (F.col("_p0") * F.exp("_lr")).alias("close"))


def _residual(df, rows, keys, x, order, q, chunk):
    twins = variance_ratio(rows, [*keys, "rep"], ["pos"], x, q, False, 512)
    med = scan.quantiles(twins, keys, "vr", [0.5], ["_twin"])
    real = variance_ratio(df, keys, order, x, q, False, chunk)
    return real.join(med, keys).select(*keys, "vr", (F.col("vr") - F.col("_twin")).alias("residual"))


def structure_table(df: DataFrame, keys: Sequence[str], x: str, q: int, order: Sequence[str] = ("ts",), chunk: str = "month") -> DataFrame:
    vr = variance_ratio(df, keys, order, x, q, True, chunk)
    rho = rho_robust(df, keys, order, x, chunk).drop("n")
    sp = sign_persistence(df, keys, order, x, chunk)
    return vr.join(rho, list(keys)).join(sp, list(keys), "left")


def mincer_zarnowitz(df: DataFrame, keys: Sequence[str], realised: str, forecast: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_intercept(realised, forecast).alias("a"), F.regr_slope(realised, forecast).alias("b"),
        F.regr_r2(realised, forecast).alias("r2"), F.regr_count(realised, forecast).alias("n"))


def constant_mix(df: DataFrame, keys: Sequence[str], ret: str, w: float) -> DataFrame:
    """Growth of a portfolio kept at weight w against buying w once and holding."""
    mix = F.exp(F.sum(F.log1p(w * F.col(ret))))
    return df.groupBy(*keys).agg(mix.alias("constant_mix"), (w * F.exp(F.sum(F.log1p(ret))) + 1 - w).alias("buy_hold"))


def falsifier(ci: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Verdict by interval: below, above or undecided against the null value."""
    return ci.withColumn("verdict", F.when(F.col("hi90") < threshold, "anti-persistent").when(F.col("lo90") > threshold, "persistent").otherwise("undecided"))
