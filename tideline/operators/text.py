"""News-like text: cleaning, scanning, trust, similarity, clustering, and forward vectors."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import rules
from tideline.operators import joins
from tideline.operators.timeseries import ratio
from tideline.session import cut_lineage
from tideline.sources import sinks

INJECTION_THRESHOLD = 0.5
# Phrases that score a text as a possible instruction, with weights.
SUSPICIOUS = ((r"ignore (all |any )?(previous|prior|above)", 0.6), (r"system prompt", 0.5), (r"you are now", 0.4),
              (r"disregard", 0.3), (r"(api[_ ]?key|password|token)\s*[:=]", 0.3), (r"<script", 0.4))


def clean(df: DataFrame, col: str, out: str, limit: int | None = None) -> DataFrame:
    """Text of markup without tags and comments, entities decoded; whole, unless a limit is given."""
    text = rules.strip_html(F.col(col))
    return df.withColumn(out, text if limit is None else F.substring(text, 1, limit))


def scan_text(df: DataFrame, col: str, model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """injection_score in [0, 1] and its flag: rule weights as columns, or a plugged-in model called
    on Arrow batches."""
    if model is not None:
        @F.pandas_udf(T.DoubleType())
        def score_udf(x: pd.Series) -> pd.Series:
            return model(x)

        score = score_udf(F.col(col))
    else:
        low = F.lower(F.col(col))
        score = F.lit(0.0)
        for pattern, w in SUSPICIOUS:
            score = score + F.when(low.rlike(pattern), w).otherwise(0.0)
        score = F.least(F.lit(1.0), score)
    s = F.round(F.coalesce(score, F.lit(0.0)), 4)
    return df.withColumns({"injection_score": s, "injection_flag": s >= INJECTION_THRESHOLD})


# ---- vectors -----------------------------------------------------------------------------------
def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: (x / F.nullif(n, F.lit(0.0))).cast("float"))


#: Most pivots, and the rows they are chosen from; both bound what is collected and sent to tasks.
MAX_PIVOTS, PIVOT_SAMPLE = 4096, 16_384
#: Rings of a cell that does not fit a block.
RINGS = 32
#: Entries of a matrix that a task holds at once; most vectors and bytes of a block where all block pairs are multiplied; and
#: how many multiplied pairs of vectors take as long as a vector's copy.
ENTRIES, WIDE_BLOCK, BLOCK_BYTES, COPY = 1 << 21, 16_384, 8 << 20, 256


def _pivots(vectors: DataFrame, vec: str, k: int) -> np.ndarray:
    """k vectors far from each other: farthest-first over a sample of fixed size (the rows of smallest hash)."""
    rows = vectors.orderBy(F.xxhash64(F.col(vec))).limit(max(k, min(PIVOT_SAMPLE, 8 * k))).select(vec).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    if len(x) <= k:
        return x
    chosen, gap = [0], np.full(len(x), np.inf)
    norm = (x * x).sum(1)
    for _ in range(k - 1):
        gap = np.minimum(gap, norm + norm[chosen[-1]] - 2 * (x @ x[chosen[-1]]))
        chosen.append(int(gap.argmax()))
    return x[chosen]


def _distances(x: np.ndarray, piv: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (piv * piv).sum(1)[None] - 2 * x @ piv.T, 0))


def _strips(n: int, width: int):
    """Slices of n rows, as many rows at once as make ENTRIES entries with ``width`` columns."""
    rows = max(1, ENTRIES // max(1, width))
    for k in range(0, n, rows):
        yield slice(k, min(k + rows, n))


def _parts(pdf: pd.DataFrame, width: int):
    for k in _strips(len(pdf), width):
        yield pdf.iloc[k]


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (each node's root, a root is its own) after the edges a-b have joined their trees."""
    while True:
        x, y = label[a], label[b]
        on = x != y
        if not on.any():
            return label
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


SCHEMAS = {"pairs": "a {0}, b {0}, cosine double", "counts": "a {0}, partners long", "links": "a {0}, b {0}, core boolean"}


def _packed(rep: DataFrame, blocks: int, idt: str, threshold: float, kind: str, dtype: type) -> DataFrame:
    """A row for each block of rep(_id, _m, _v, _c), alone in its partition. For links it holds what each core row is joined to
    inside the block."""
    rows = rep.withColumn("_p", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))

    def pack(batches):
        pdf = pd.concat(list(batches), ignore_index=True)
        if pdf.empty:
            return
        x, core = np.vstack(pdf["_v"].to_numpy()).astype(dtype), pdf["_c"].to_numpy(bool)
        root = np.arange(len(pdf), dtype="int32")
        if kind == "links":
            own, y = np.flatnonzero(core), x[core].astype(np.float64)
            for k in _strips(len(own), len(own)):
                i, j = np.nonzero(y[k] @ y.T >= threshold)
                root = _merged(root, own[i + k.start], own[j])
        yield pd.DataFrame({"_p": [int(pdf["_p"].iloc[0])], "_ids": [pdf["_id"].to_numpy()], "_ms": [pdf["_m"].to_numpy("int64").tobytes()], "_vs": [x.tobytes()], "_cs": [core.tobytes()], "_rs": [root.tobytes()]})

    return cut_lineage(rows.repartitionById(blocks, "_p").mapInPandas(pack, f"_p int, _ids array<{idt}>, _ms binary, _vs binary, _cs binary, _rs binary"))


def _block_pairs(rep: DataFrame, n: int, dim: int, block: int, idt: str, threshold: float, kind: str, work) -> DataFrame:
    """What `_matches` returns, of all n rows of rep: blocks of bounded size, every pair of them a product that is made strip
    by strip. Each block is written once, and the task of a pair reads its two: no vector is copied through a shuffle."""
    dtype = np.float64 if dict(rep.dtypes)["_v"] == "array<double>" else np.float32
    width = min(WIDE_BLOCK, max(block, -(-n // 16)), max(1, BLOCK_BYTES // max(1, dim * np.dtype(dtype).itemsize)))
    packed = _packed(rep, max(1, -(-n // width)), idt, threshold, kind, dtype)
    other = packed.select(*[F.col(c).alias(f"q{c}") for c in packed.columns])

    def unpacked(ids, ms, vs, cs, rs):
        ids = np.asarray(ids)
        return ids, np.frombuffer(ms, "int64"), np.frombuffer(vs, dtype).reshape(len(ids), -1).astype(np.float64), np.frombuffer(cs, bool), np.frombuffer(rs, "int32")

    def multiply(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                yield from {"pairs": pairs, "counts": counts, "links": links}[kind](unpacked(*r[1:6]), unpacked(*r[7:]), r[0] == r[6])

    def strips(x, y):
        for k in _strips(len(x), len(y)):
            if work is not None:
                work.add((k.stop - k.start) * len(y))
            i, j = np.divmod(np.flatnonzero((s := x[k] @ y.T).ravel() >= threshold), len(y))
            yield i + k.start, j, s[i, j]

    def pairs(one, two, same):
        hid, gid = one[0], two[0]
        for i, j, cosine in strips(one[2], two[2]):
            keep = hid[i] < gid[j] if same else slice(None)
            i, j = i[keep], j[keep]
            yield pd.DataFrame({"a": np.minimum(hid[i], gid[j]), "b": np.maximum(hid[i], gid[j]), "cosine": cosine[keep]})

    def counts(one, two, same):
        ours, theirs = np.zeros(len(one[0]), "int64"), np.zeros(len(two[0]), "int64")
        for i, j, _ in strips(one[2], two[2]):
            keep = one[0][i] < two[0][j] if same else slice(None)
            i, j = i[keep], j[keep]
            ours += np.bincount(i, two[1][j], len(ours)).astype("int64")
            theirs += np.bincount(j, one[1][i], len(theirs)).astype("int64")
        for ids, found in ((one[0], ours), (two[0], theirs)):
            yield pd.DataFrame({"a": ids[found > 0], "partners": found[found > 0]})

    def links(one, two, same):
        (hid, _, x, ours, hr), (gid, _, y, theirs, gr) = one, two
        if same:  # the block's own trees are known
            up = np.flatnonzero(hr != np.arange(len(hr)))
            yield pd.DataFrame({"a": hid[up], "b": hid[hr[up]], "core": True})
        ids, roots = np.concatenate([hid, gid]), np.concatenate([hr, gr + len(hr)]).astype("int64")
        label = np.arange(len(ids))
        rows = np.flatnonzero(~ours) if same else np.arange(len(hid))
        for i, j, _ in strips(x[rows], y):
            i = rows[i]
            both, left, right = ours[i] & theirs[j], ~ours[i] & theirs[j], ours[i] & ~theirs[j]
            label = _merged(label, roots[i[both]], roots[j[both] + len(hr)])
            yield pd.DataFrame({"a": np.concatenate([hid[i[left]], gid[j[right]]]), "b": np.concatenate([gid[j[left]], hid[i[right]]]), "core": False})
        up = np.flatnonzero(label != np.arange(len(ids)))
        yield pd.DataFrame({"a": ids[up], "b": ids[label[up]], "core": True})

    both = packed.hint("shuffle_replicate_nl").join(other, F.col("_p") <= F.col("q_p"))
    return both.mapInPandas(multiply, SCHEMAS[kind].format(idt))


def _collapsed(d: DataFrame, ident: str) -> DataFrame:
    """Equal vectors as one row with a multiplicity."""
    return cut_lineage(d.groupBy("_v").agg(F.min(ident).alias("_id"), F.count(F.lit(1)).alias("_m")).select("_id", "_m", "_v", F.lit(False).alias("_c")))


def _vectors(vectors: DataFrame, vec: str) -> DataFrame:
    double = dict(vectors.dtypes)[vec] == "array<double>"
    return vectors.where(F.col(vec).isNotNull()).withColumn("_v", F.col(vec).cast("array<double>" if double else "array<float>"))


def similar(vectors: DataFrame, ident: str, vec: str, threshold: float, pivots: int | None = None, block: int = 2048, counts: bool = False, work=None) -> DataFrame:
    """Exact pairs (a < b, cosine >= threshold) of vectors, copies among them, or with ``counts`` the number of
    such partners per row. ``work``, an accumulator, counts the multiplied pairs.

    For counts, equal vectors are first collapsed to one with a multiplicity; pairs are those of all rows, so each row
    stands for itself. Rows without an id are in no pair. The rest is done by `_matches`."""
    d = _vectors(vectors, vec)
    if not counts:
        rows = d.where(F.col(ident).isNotNull()).select(F.col(ident).alias("_id"), F.lit(1).cast("long").alias("_m"), "_v", F.lit(False).alias("_c"))
        return _matches(cut_lineage(rows), threshold, pivots, block, "pairs", work)
    rep = _collapsed(d, ident)
    n = _matches(rep, threshold, pivots, block, "counts", work).groupBy("a").agg(F.sum("partners").alias("_p")).withColumnRenamed("a", "_id")
    per = rep.join(n, "_id", "left").select("_v", (F.coalesce("_p", F.lit(0)) + F.col("_m") - 1).cast("long").alias("neighbours"))
    return d.join(per, "_v").select(ident, "neighbours")


def _matches(rep: DataFrame, threshold: float, pivots: int | None, block: int, kind: str, work=None) -> DataFrame:
    """Of the rows of rep(_id, _m, _v, _c) with a product of `threshold` or more: all pairs, for each row the sum of its
    partners' _m ("counts"), or "links": trees that connect the core rows (_c) as all their pairs do, and all pairs of a
    row that is no core (a) with one that is (b). Trees are as many rows as nodes for each product, whatever its pairs.

    Each vector goes to the cell
    of its nearest pivot, and as a guest to every cell it can still reach by the triangle inequality:
    a partner in cell j needs d(x, pivot_j) - d(x, own pivot) <= 2*eps, and d(x, pivot_j) <= the
    cell's radius + eps. The longest vector sets eps, which is the largest distance of partners. There are as many pivots as the
    root of the number of vectors (MAX_PIVOTS at
    most). Cells are cut into rings by the distance to their pivot, which are blocks of bounded size;
    only block pairs whose rings lie within eps of each other are multiplied as matrices, so no cell,
    however full, sits in one task and only true partners are emitted. Pivots and blocks only
    prune: any number gives the same result. Where the cells would prune too little to be worth their copies (counted
    before any is made, unless ``pivots`` is given), all pairs of blocks are multiplied."""
    piv = _pivots(rep, "_v", pivots or min(MAX_PIVOTS, max(16, math.isqrt(rep.count()))))
    if len(piv) == 0:
        piv = np.zeros((1, 1))
    idt, vt = dict(rep.dtypes)["_id"], dict(rep.dtypes)["_v"]

    def homes(batches):
        for pdf in batches:
            for part in _parts(pdf, len(piv)):
                x = np.vstack(part["_v"].to_numpy()).astype(np.float64)
                dist = _distances(x, piv)
                home = dist.argmin(1)
                yield part.assign(_hc=home.astype("int32"), _d=dist[np.arange(len(part)), home], _q=(x * x).sum(1))

    rep_type = f"_id {idt}, _m long, _v {vt}, _c boolean"
    at_home = cut_lineage(rep.select("_id", "_m", "_v", "_c").mapInPandas(homes, f"{rep_type}, _hc int, _d double, _q double"))
    cells = at_home.groupBy("_hc").agg(F.count(F.lit(1)).alias("_size"), F.max("_d").alias("_radius"), F.max("_q").alias("_q"))
    known = {r["_hc"]: r for r in cells.collect()}  # one row per pivot
    radius = np.array([known[j]["_radius"] if j in known else -1.0 for j in range(len(piv))])
    square = max((r["_q"] for r in known.values()), default=1.0)
    eps = float(np.sqrt(max(0.0, 2 * square - 2 * threshold))) + 1e-6 * max(1.0, math.sqrt(square))

    def reached(x, home, own):
        """Distances to the pivots, and the cells a vector goes to."""
        dist = _distances(x, piv)
        reach = (dist - own[:, None] <= 2 * eps) & (dist <= radius[None, :] + eps) & (radius[None, :] >= 0)
        reach[np.arange(len(x)), home] = True
        return dist, reach

    def guests(batches):
        n = np.zeros(len(piv), "int64")
        for pdf in batches:
            for part in _parts(pdf, len(piv)):
                n += reached(np.vstack(part["_v"].to_numpy()).astype(np.float64), part["_hc"].to_numpy(), part["_d"].to_numpy())[1].sum(0)
        yield pd.DataFrame({"_hc": np.arange(len(piv), dtype="int32"), "_n": n})

    if pivots is None:
        n = sum(r["_size"] for r in known.values())
        visits = {r["_hc"]: r["_n"] for r in at_home.select("_v", "_hc", "_d").mapInPandas(guests, "_hc int, _n long").groupBy("_hc").agg(F.sum("_n").alias("_n")).collect()}  # one row per pivot
        by_cells = sum(r["_size"] * visits[j] for j, r in known.items()) + COPY * sum(visits.values())
        if by_cells >= n * n / 2 + COPY * n:
            return _block_pairs(rep, n, piv.shape[1], block, idt, threshold, kind, work)
    # ring edges of each cell: as many as its size needs; equal distances share a ring, which a hash cuts further
    full = {j: int(-(-r["_size"] // block)) for j, r in known.items()}
    edges = {}
    if any(n > 1 for n in full.values()):
        big = at_home.where(F.col("_hc").isin([j for j, n in full.items() if n > 1]))
        probs = big.groupBy("_hc").agg(F.percentile_approx("_d", F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)]), 10_000).alias("q"))
        edges = {r["_hc"]: np.unique(r["q"]) for r in probs.collect()}
    nothing = np.zeros(0)

    def place(batches):
        for pdf in batches:
            for part in _parts(pdf, len(piv) * 16):
                yield placed_part(part)

    def placed_part(pdf):
        x, home, own = np.vstack(pdf["_v"].to_numpy()).astype(np.float64), pdf["_hc"].to_numpy(), pdf["_d"].to_numpy()
        dist, reach = reached(x, home, own)
        i, j = np.nonzero(reach)
        ring = np.array([np.searchsorted(edges.get(int(c), nothing), v) for c, v in zip(j, dist[i, j])], "int32")
        ring[home[i] == j] = [np.searchsorted(edges.get(int(c), nothing), v) for c, v in zip(home[i[home[i] == j]], own[i[home[i] == j]])]
        low = np.array([np.searchsorted(edges.get(int(c), nothing), v - eps) for c, v in zip(j, dist[i, j])], "int32")
        high = np.array([np.searchsorted(edges.get(int(c), nothing), v + eps) for c, v in zip(j, dist[i, j])], "int32")
        return pd.DataFrame({"_id": pdf["_id"].to_numpy()[i], "_m": pdf["_m"].to_numpy()[i], "_v": pdf["_v"].to_numpy()[i], "_c": pdf["_c"].to_numpy()[i], "_cell": j.astype("int32"), "_home": home[i] == j,
                             "_hc": home[i].astype("int32"), "_ring": ring, "_low": low, "_high": high})

    placed = cut_lineage(at_home.mapInPandas(place, f"{rep_type}, _cell int, _home boolean, _hc int, _ring int, _low int, _high int"))
    filled = placed.groupBy("_cell", "_ring").agg(F.count(F.lit(1)).alias("_size")).withColumn("_nb", F.ceil(F.col("_size") / block).cast("int")).select("_cell", "_ring", "_nb")
    placed = placed.join(F.broadcast(filled), ["_cell", "_ring"]).withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int"))  # RINGS rows per pivot at most
    # a host block meets the guest blocks of the rings within eps; block pairs are tasks
    rings = filled.select("_cell", F.col("_ring").alias("_r"), F.col("_nb").alias("_n"))
    host = placed.where("_home").join(F.broadcast(rings), "_cell").where(F.col("_r").between(F.col("_low"), F.col("_high")))
    host = host.select("_cell", F.col("_ring").alias("_hr"), F.col("_b").alias("_hb"), F.col("_r").alias("_gr"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_gb"), F.lit(1).alias("_side"), "_id", "_m", "_v", "_c", "_hc")
    guest = placed.join(F.broadcast(rings), "_cell").where(F.col("_r").between(F.col("_low"), F.col("_high")))
    guest = guest.select("_cell", F.col("_r").alias("_hr"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_hb"), F.col("_ring").alias("_gr"), F.col("_b").alias("_gb"), F.lit(0).alias("_side"), "_id", "_m", "_v", "_c", "_hc")
    both = host.unionByName(guest)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        h, g = pdf[pdf["_side"] == 1], pdf[pdf["_side"] == 0]
        cols = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
        if h.empty or g.empty:
            return pd.DataFrame([], columns=cols)
        x, y = np.vstack(h["_v"].to_numpy()).astype(np.float64), np.vstack(g["_v"].to_numpy()).astype(np.float64)
        hid, gid, gm = h["_id"].to_numpy(), g["_id"].to_numpy(), g["_m"].to_numpy()
        if work is not None:
            work.add(len(x) * len(y))
        s = x @ y.T
        hit = (s >= threshold) & (hid[:, None] != gid[None, :])
        if kind == "counts":
            n = (hit * gm[None, :]).sum(1)
            return pd.DataFrame({"a": hid[n > 0], "partners": n[n > 0]})
        if kind == "links":
            ours, theirs = h["_c"].to_numpy(bool), g["_c"].to_numpy(bool)
            ids, node = np.unique(np.concatenate([hid, gid]), return_inverse=True)
            i, j = np.nonzero(hit & ours[:, None] & theirs[None, :])
            label = _merged(np.arange(len(ids)), node[i], node[j + len(hid)])
            up = np.flatnonzero(label != np.arange(len(ids)))
            i, j = np.nonzero(hit & ~ours[:, None] & theirs[None, :])
            k, m = np.nonzero(hit & ours[:, None] & ~theirs[None, :])
            return pd.DataFrame({"a": np.concatenate([ids[up], hid[i], gid[m]]), "b": np.concatenate([ids[label[up]], gid[j], hid[k]]), "core": np.arange(len(up) + len(i) + len(k)) < len(up)})
        # a pair whose homes differ is met in both home cells; keep it in the lower one's
        ghc, hc = g["_hc"].to_numpy(), h["_hc"].to_numpy()
        hit &= (hc[:, None] < ghc[None, :]) | ((hc[:, None] == ghc[None, :]) & (hid[:, None] < gid[None, :]))
        i, j = np.nonzero(hit)
        a, b = np.minimum(hid[i], gid[j]), np.maximum(hid[i], gid[j])
        return pd.DataFrame({"a": a, "b": b, "cosine": s[i, j]})

    return both.groupBy("_cell", "_hr", "_hb", "_gr", "_gb").applyInPandas(multiply, SCHEMAS[kind].format(idt))


def trust(df: DataFrame, weights: dict[str, float] | None = None, default: float = 0.5) -> Column:
    """Source weight raised by corroboration: x (1 + .2 x min(neighbours, 4)), at most 1."""
    w = rules.lookup(F.col("source"), weights or rules.SOURCE_WEIGHTS, default)
    return F.round(F.least(F.lit(1.0), w * (1 + 0.2 * F.least(F.col("neighbours"), F.lit(4)))), 4)


# ---- clustering ------------------------------------------------------------------------------
def kmeans(vectors: DataFrame, vec: str, k: int, seed: int = 42, bisecting: bool = False) -> DataFrame:
    d = cut_lineage(vectors.withColumn("_f", array_to_vector(F.transform(vec, lambda x: x.cast("double")))))
    est = BisectingKMeans if bisecting else KMeans
    return est(k=k, seed=seed, featuresCol="_f", predictionCol="cluster_id").fit(d).transform(d).drop("_f")


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by propagating the smallest label with pointer jumping; each round is
    checkpointed, and the rounds grow with the logarithm of a chain's length."""
    e = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = cut_lineage(nodes.select(F.col("id"), F.col("id").alias("label")))
    for _ in range(max_rounds):
        near = e.join(lab, e["b"] == lab["id"]).groupBy("a").agg(F.min("label").alias("_n")).withColumnRenamed("a", "id")
        step = lab.join(near, "id", "left").select("id", F.least("label", F.coalesce("_n", "label")).alias("label"), F.col("label").alias("_old"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("_j"))
        new = cut_lineage(step.join(jump, "label", "left").select("id", F.least("label", F.coalesce("_j", "label")).alias("label"), "_old"))
        moved = new.where(F.col("label") != F.col("_old")).limit(1).count()
        lab = new.drop("_old")
        if not moved:
            return lab
    raise RuntimeError("components did not settle")


def dbscan(vectors: DataFrame, ident: str, vec: str, cosine: float, min_samples: int) -> DataFrame:
    """Density clusters of unit vectors (eps as a cosine): core rows joined through near pairs, the
    rest attached to the smallest neighbouring cluster or noise (-1). Equal vectors count with
    their multiplicity and share one label.

    Near pairs are not written: one pass counts them, a second one keeps trees of what connects core rows and the
    pairs of other rows, which are fewer than ``min_samples`` each."""
    d = _vectors(vectors.select(ident, vec), vec).select(ident, "_v")
    rep = _collapsed(d, ident)
    near = _matches(rep, cosine, None, 2048, "counts").groupBy("a").agg(F.sum("partners").alias("_k")).withColumnRenamed("a", "_id")
    rep = cut_lineage(rep.drop("_c").join(near, "_id", "left").select("_id", "_m", "_v", (F.coalesce("_k", F.lit(0)) + F.col("_m") >= min_samples).alias("_c")))
    links = cut_lineage(_matches(rep, cosine, None, 2048, "links"))
    core = rep.where("_c").select(F.col("_id").alias("id"))
    lab = components(links.where("core"), core)
    edge = links.where("not core").join(lab.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("_l")).withColumnRenamed("a", "id")
    full = rep.select(F.col("_id").alias("id"), "_v").join(lab, "id", "left").join(edge, "id", "left").select("_v", F.coalesce("label", "_l", F.lit(-1)).cast("long").alias("cluster_id"))
    return d.join(full, "_v").select(ident, "cluster_id")


def cluster_quality(df: DataFrame, vec: str, label: str = "cluster_id") -> DataFrame:
    """Cluster and noise counts with Davies-Bouldin and Calinski-Harabasz from centroid sums."""
    long = df.where(F.col(label) != -1).select(label, F.posexplode(vec).alias("i", "x"))
    cen = long.groupBy(label, "i").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double") ** 2).alias("xx"))
    glob = long.groupBy("i").agg(F.avg("x").alias("g"))
    per = cen.join(glob, "i").groupBy(label).agg(
        F.max("n").alias("n"), F.sum(F.col("xx") - F.col("n") * F.col("c") * F.col("c")).alias("within"), F.sum(F.col("n") * F.pow(F.col("c") - F.col("g"), 2)).alias("between"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda e: e["c"]).alias("cen"))
    dist = df.where(F.col(label) != -1).join(per.select(label, "cen"), label)
    sq = F.aggregate(F.zip_with(vec, "cen", lambda x, c: x - c), F.lit(0.0), lambda a, x: a + x * x)
    spread = dist.groupBy(label).agg(F.avg(F.sqrt(sq)).alias("s"))
    c = per.join(spread, label)
    a, b = c.select(F.col(label).alias("l1"), F.col("s").alias("s1"), F.col("cen").alias("c1")), c.select(F.col(label).alias("l2"), F.col("s").alias("s2"), F.col("cen").alias("c2"))
    gap = F.sqrt(F.aggregate(F.zip_with("c1", "c2", lambda x, y: x - y), F.lit(0.0), lambda acc, x: acc + x * x))
    # centroids only: k rows, k is the number of clusters
    db = a.join(b, F.col("l1") != F.col("l2")).groupBy("l1").agg(F.max((F.col("s1") + F.col("s2")) / F.nullif(gap, F.lit(0.0))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    k, n = F.count(F.lit(1)), F.sum("n")
    ch = per.agg(k.alias("n_clusters"), n.alias("n_clustered"), (ratio(F.sum("between") / F.nullif(k - 1, F.lit(0)), F.sum("within") / F.nullif(n - k, F.lit(0)))).alias("calinski_harabasz"))
    noise = df.agg(F.count_if(F.col(label) == -1).alias("n_noise"))
    return ch.crossJoin(F.broadcast(db)).crossJoin(F.broadcast(noise))  # one row each


def silhouette(df: DataFrame, vec: str, label: str = "cluster_id") -> float:
    d = df.where(F.col(label) != -1).select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("prediction"))
    return float(ClusteringEvaluator().evaluate(cut_lineage(d)))


def silhouettes(df: DataFrame, vec: str, label: str = "cluster_id") -> DataFrame:
    """Rows that are no noise with the silhouette of their squared distances: own and nearest other mean distance come
    from counts, centroids and sums of squares: one row a cluster, fetched and sent to every task, where the distances are
    matrix products. A row alone in its cluster has 0, without a second cluster it is null."""
    on = df.where(F.col(label) != -1)
    long = on.select(label, F.posexplode(vec).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    per = long.groupBy(label, "i").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx")).groupBy(label).agg(
        F.max("n").alias("n"), F.sum("xx").alias("xx"), F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda e: e["c"]).alias("c"))
    every = per.collect()  # one row a cluster
    index = {r[label]: i for i, r in enumerate(every)}
    n, centre = np.array([r["n"] for r in every], float), np.array([r["c"] for r in every], float)
    mean = np.array([r["xx"] for r in every]) / n
    schema = T.StructType([*on.schema.fields, T.StructField("silhouette", T.DoubleType())])
    step = max(1, (4 << 20) // max(len(every), 1))  # distances held at once

    def score(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        far = (x * x).sum(axis=1)[:, None] + mean - 2 * (x @ centre.T)
        rows, size = np.arange(len(x)), n[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = size * far[rows, at] / (size - 1)
            far[rows, at] = np.inf
            b = far.min(axis=1)
            s = np.where(size == 1, 0.0, (b - a) / np.maximum(a, b))
        return np.where(np.isfinite(b) & np.isfinite(s), s, np.nan)

    def run(batches):
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            known = np.flatnonzero(pdf[vec].notna().to_numpy() & pdf[label].isin(index).to_numpy())
            for lo in range(0, len(known), step):
                rows = known[lo:lo + step]
                x = np.vstack(pdf[vec].to_numpy()[rows]).astype(float)
                out[rows] = score(x, np.array([index[v] for v in pdf[label].to_numpy()[rows].tolist()]))
            yield pdf.assign(silhouette=out)

    return on.mapInPandas(run, schema)


def rank_clusterings(found: dict[str, DataFrame], vec: str) -> DataFrame:
    """method, its cluster quality, mean silhouette and score, of clusterings given as tables with a cluster_id."""
    rows = None
    for method, df in found.items():
        sil = silhouettes(df, vec).agg(F.avg("silhouette").alias("silhouette"))
        one = cluster_quality(df, vec).crossJoin(F.broadcast(sil)).select(F.lit(method).alias("method"), "n_clusters", "n_noise", "silhouette", "davies_bouldin", "calinski_harabasz")  # one row each
        rows = one if rows is None else rows.unionByName(one)
    score = method_score(*[F.col(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz", "n_noise", "n_clusters")])
    return rows.withColumn("score", score)


def method_score(sil: Column, db: Column, ch: Column, n_noise: Column, n_clusters: Column) -> Column:
    noise = n_noise / F.greatest(n_noise + n_clusters, F.lit(1))
    z = F.lit(0.0)
    return (F.coalesce(sil, z) - 0.5 * F.coalesce(db, z) + F.coalesce(ch, z) / 1000 - F.when(noise > 0.5, 2 * noise).otherwise(noise))


def label_clusters(df: DataFrame, keys: Sequence[str], title: str, trust_col: str, ident: str, n: int = 5) -> DataFrame:
    """Taxonomy label of each cluster from its most trusted titles."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(trust_col), ident))
    top = df.withColumn("_r", rn).where(F.col("_r") <= n)  # each task keeps its own best first
    line = F.concat(F.lit("- "), F.col(title))
    g = top.groupBy(*keys).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("t")))), lambda s: s["t"])).alias("_h"))
    return g.select(*keys, rules.topic(F.col("_h")).alias("cluster_label"))


def noise_share(df: DataFrame, keys: Sequence[str], label: str = "cluster_id", limit: float = 0.30) -> DataFrame:
    share = F.avg((F.col(label) == -1).cast("double"))
    return df.groupBy(*keys).agg(share.alias("noise_share"), (share > limit).alias("drift_alert"))


# ---- forward log -----------------------------------------------------------------------------
def forward_vectors(news: DataFrame, probes: DataFrame, hours: int = 24) -> DataFrame:
    """Per (symbol, as_of): count, novelty, trust-weighted sentiment over (as_of - h, as_of]. News
    and probes meet in hour-wide buckets of the window length, at most two per item."""
    width = hours * 3600
    n = news.withColumn("_s", F.unix_timestamp("published_at"))
    n = n.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_s") / width) + 1)))
    p = probes.withColumn("_a", F.unix_timestamp("as_of")).withColumn("_k", F.floor(F.col("_a") / width))
    j = n.join(p, ["symbol", "_k"]).where((F.col("published_at") > F.col("as_of") - F.expr(f"interval {hours} hours")) & (F.col("published_at") <= F.col("as_of")))
    known = F.col("cluster_label").isNotNull() & ~F.coalesce("is_noise", F.lit(False))
    t = F.when(known, F.coalesce("trust", F.lit(0.5)))
    g = j.groupBy("symbol", "as_of").agg(
        F.count(F.lit(1)).alias("n_news"), (1 - F.count_if(known) / F.count(F.lit(1))).alias("novelty"),
        F.coalesce(ratio(F.sum(rules.sentiment(F.col("cluster_label")) * t), F.sum(t)), F.lit(0.0)).alias("sentiment"))
    return probes.join(g, ["symbol", "as_of"], "left").na.fill({"n_news": 0, "novelty": 0.0, "sentiment": 0.0})


def fill_outcomes(log: DataFrame, candles: DataFrame, horizons: Sequence[int] = (24, 168), chunk: str = "month") -> DataFrame:
    """Outcome per horizon once it has closed (a candle at or after t+h exists); filled values stay,
    and a row is sealed when all are there."""
    d = log
    end = candles.groupBy("symbol").agg(F.max("ts").alias("_end"))
    got = joins.as_of_many(d.select("symbol", F.col("as_of").alias("ts")).distinct(), candles, "close", [0, *horizons], ["_p0", *[f"_p{h}" for h in horizons]], chunk)
    d = d.join(got.withColumnRenamed("ts", "as_of"), ["symbol", "as_of"], "left").join(end, "symbol", "left")
    for h in horizons:
        closed = F.col("_end") >= F.col("as_of") + F.expr(f"interval {h} hours")
        new = F.when(closed, ratio(F.col(f"_p{h}"), F.col("_p0")) - 1)
        d = d.withColumn(f"ret_{h}h", F.coalesce(f"ret_{h}h", new) if f"ret_{h}h" in log.columns else new)
    done = F.lit(True)
    for h in horizons:
        done = done & F.col(f"ret_{h}h").isNotNull()
    return d.withColumn("sealed", done).drop("_end", "_p0", *[f"_p{h}" for h in horizons])


def log_forward(path: str, news: DataFrame, probes: DataFrame, candles: DataFrame, stamp: str) -> None:
    """One run of the forward log at ``path``: rows that wait for outcomes get those that ``candles`` close by now, then
    the vector of every probe is written without outcomes. A repeated run replaces its own rows, so the log stays the
    same; ``stamp``, the time of the run, grows from run to run. Partitions are months of ``as_of``."""
    none = F.lit(None)
    at = F.lit(stamp).cast("timestamp_ntz")
    vectors = forward_vectors(news, probes).select(
        "symbol", "as_of", "n_news", "novelty", "sentiment", none.cast("double").alias("ret_24h"), none.cast("double").alias("ret_168h"), none.cast("timestamp_ntz").alias("scored_at"),
        at.alias("created_at"), at.alias("written_at"), F.date_format("as_of", "yyyy-MM").alias("month"))
    waiting = sinks.read_table(vectors.sparkSession, path, vectors.schema).where("scored_at IS NULL").join(probes, ["symbol", "as_of"], "left_anti")
    scored = fill_outcomes(waiting, candles).withColumns({"scored_at": F.when(F.col("sealed"), at), "written_at": at}).select(*vectors.columns)
    sinks.upsert(cut_lineage(vectors.unionByName(scored)), path, ["symbol", "as_of"], "written_at", ["month"])


def forward_status(log: DataFrame, gate_days: int = 90) -> DataFrame:
    return log.agg(F.count_distinct(F.to_date("as_of")).alias("days"), F.count_distinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("rows"),
                   F.count_if(F.col("sealed")).alias("sealed"), F.max("as_of").alias("latest"), (F.count_distinct(F.to_date("as_of")) >= gate_days).alias("gate_open"))
