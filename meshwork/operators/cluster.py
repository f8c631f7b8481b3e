"""Clusterings.

One pass of Lloyd's algorithm is a DataFrame step (broadcast centres, an aggregation) and takes any
number of rows. What the reference problem needs beside it are thousands of
fits of small slices; those are fanned out by key and each runs on one slice in an Arrow task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import euclid, ratio
from meshwork.operators.panel import best_assignment
from meshwork.operators.validity import centroids

#: Rows that a fit widens to doubles at once.
SLICE = 8_192


def assign(nodes: DataFrame, centres: DataFrame, digits: int = 9) -> DataFrame:
    """(id, label, d1, d2, ratio): nearest and second-nearest centre, ties to the smaller label."""
    c = F.broadcast(centres.groupBy().agg(F.sort_array(F.collect_list(F.struct("label", "x"))).alias("_c")))
    d = F.array_sort(F.transform("_c", lambda c: F.struct(F.round(euclid(F.col("x"), c["x"]), digits).alias("d"), c["label"].alias("label"))))
    n = nodes.join(c).withColumn("_d", d)
    d1, d2 = F.col("_d")[0]["d"], F.get("_d", F.lit(1))["d"]
    return n.select("id", F.col("_d")[0]["label"].alias("label"), d1.alias("d1"), d2.alias("d2"), ratio(d1, d2).alias("ratio"))


def lloyd(nodes: DataFrame, centres: DataFrame, rounds: int) -> DataFrame:
    """(id, label) after so many rounds from given centres (label, x); the centres, k rows, are what is broadcast."""
    base = nodes.select("id", "x")
    for _ in range(rounds):
        centres = centroids(base.join(assign(base, centres).select("id", "label"), "id")).select("label", "x")
    return assign(base, centres).select("id", "label", "d1")


def slices(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows in slices, as doubles: a whole run's vectors stay as they are stored."""
    for at in range(0, len(x), SLICE):
        own = slice(at, min(len(x), at + SLICE))
        yield own, x[own].astype(float)


def nearest_of(x: np.ndarray, c: np.ndarray, measured: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of a few centres to each row, by products around their mean, and, if ``measured``, its squared distance, by differences."""
    lab, near = np.empty(len(x), np.int64), np.empty(len(x))
    middle = c.mean(axis=0)
    b = c - middle
    half = np.square(b).sum(axis=1) / 2
    for own, v in slices(x):
        lab[own] = (half - (v - middle) @ b.T).argmin(axis=1)
        if measured:
            near[own] = np.square(v - c[lab[own]]).sum(axis=1)
    return lab, near


def kmeans_fit(x: np.ndarray, k: int, seed: int, inits: int = 4, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of some k-means++ starts."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(inits):
        c = [x[rng.integers(len(x))].astype(float)]
        near = None
        for _ in range(1, k):
            d = nearest_of(x, np.array(c[-1:]))[1]
            near = d if near is None else np.minimum(near, d)
            c.append(x[rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x))].astype(float))
        c = np.array(c)
        for _ in range(rounds):
            lab, _ = nearest_of(x, c, False)
            total, n = np.zeros_like(c), np.bincount(lab, minlength=k)
            for own, v in slices(x):
                total += np.eye(k)[lab[own]].T @ v
            new = np.array([total[j] / n[j] if n[j] else x[nearest_of(x, c)[1].argmax()].astype(float) for j in range(k)])
            if np.abs(new - c).max() < 1e-9:
                break
            c = new
        lab, near = nearest_of(x, c)
        fit = (round(float(near.sum()), 6), lab)
        if best is None or fit[0] < best[0]:
            best = fit
    return best[1], best[0]


def ward_merges(x: np.ndarray, size: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (cost, a, b), a < b, of clusters with these centres and sizes by nearest-neighbour chains; a merged cluster goes on as a."""
    n = len(x)
    size, centre, alive, merges, chain = size.copy(), x.astype(float).copy(), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            cost = ((centre - centre[i]) ** 2).sum(1) * size * size[i] / (size + size[i])
            cost[~alive] = np.inf
            cost[i] = np.inf
            j = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        a, b = min(i, j), max(i, j)
        merges.append((cost[j], a, b))
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    return merges


def ward_fit(x: np.ndarray, k: int) -> np.ndarray:
    """Ward's agglomeration by nearest-neighbour chains, cut at k clusters."""
    n = len(x)
    merges = ward_merges(x, np.ones(n))
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        parent[root(b)] = root(a)
    return np.unique([root(v) for v in range(n)], return_inverse=True)[1]


def gmm_fit(x: np.ndarray, k: int, seed: int, rounds: int = 100, reg: float = 1e-6) -> tuple[np.ndarray, float]:
    """Labels and log likelihood of a full-covariance Gaussian mixture by EM, from a k-means start."""
    n, p = x.shape
    r = np.eye(k)[kmeans_fit(x, k, seed, 1)[0]]
    last = -np.inf
    for _ in range(rounds):
        w = r.sum(0) + 1e-12
        mu = r.T @ x / w[:, None]
        logp = np.empty((n, k))
        for j in range(k):
            d = x - mu[j]
            cov = (r[:, j, None] * d).T @ d / w[j] + reg * np.eye(p)
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, d.T)
            logp[:, j] = np.log(w[j] / n) - 0.5 * (p * np.log(2 * np.pi) + (z**2).sum(0)) - np.log(np.diag(low)).sum()
        top = logp.max(1, keepdims=True)
        norm = top + np.log(np.exp(logp - top).sum(1, keepdims=True))
        r = np.exp(logp - norm)
        if abs(norm.mean() - last) < 1e-6:
            break
        last = norm.mean()
    return r.argmax(1), float(norm.sum())


def spectral_fit(w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Labels from the leading eigenvectors of the normalised adjacency, then k-means."""
    d = w.sum(1)
    s = np.divide(1.0, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    _, vec = np.linalg.eigh(s[:, None] * w * s[None])
    y = vec[:, -k:] * s[:, None]
    return kmeans_fit(y, k, seed)[0]


def sorted_vectors(batches: Iterator[pa.RecordBatch]) -> tuple[dict, np.ndarray, np.ndarray]:
    """The other columns of the first row as Python values, and ids and vectors by ascending id, as they are stored."""
    first, ids, parts = None, [], []
    for b in batches:
        if b.num_rows:
            first = first or {c: b.column(i)[0].as_py() for i, c in enumerate(b.schema.names) if c not in ("id", "x")}
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False)
            ids.append(b.column("id").to_numpy())
            parts.append(flat.reshape(b.num_rows, -1))
    ids = np.concatenate(ids).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    x, at = np.empty((len(ids), parts[0].shape[1]), parts[0].dtype), len(ids)
    while parts:
        p = parts.pop()  # each batch is let go as soon as it is copied
        at -= len(p)
        x[place[at : at + len(p)]] = p
    return first, ids[order], x


def fits(nodes: DataFrame, runs: DataFrame, method: str = "kmeans", by: list[str] | None = None) -> DataFrame:
    """(by, seed, k, id, label, score): one fit for each slice and run (seed, k), slices and runs dealt out."""
    by = by or []
    fan = nodes.select(*by, "id", "x").join(F.broadcast(runs))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids, x = sorted_vectors(batches)
        k, seed = first["k"], first["seed"]
        x = x if method == "kmeans" else x.astype(float)
        if method == "kmeans":
            label, score = kmeans_fit(x, k, seed)
        elif method == "gmm":
            label, score = gmm_fit(x, k, seed)
        elif method == "ward":
            label, score = ward_fit(x, k), 0.0
        else:
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            sim = np.maximum(u @ u.T, 0)
            np.fill_diagonal(sim, 0)
            label, score = spectral_fit(sim, k, seed), 0.0
        n = len(ids)
        same = [pa.repeat(first[c], n) for c in (*by, "seed", "k")]
        yield pa.RecordBatch.from_arrays([*same, pa.array(ids), pa.array(label.astype(np.int64)), pa.array(np.full(n, score, float))], [*by, "seed", "k", "id", "label", "score"])

    kinds = dict(nodes.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "seed long", "k long", "id long", "label long", "score double"])
    return fan.groupBy(*by, "seed", "k").applyInArrow(fit, schema)


def best_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the run with the lowest score, ties to the smallest seed."""
    b = runs.groupBy(*by).agg(F.min(F.struct(F.bround("score", 6).alias("s"), "seed")).alias("_b"))
    return runs.join(F.broadcast(b.select(*by, F.col("_b.seed").alias("seed"))), [*by, "seed"])


def overlap_relabel(runs: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(seed, id, label): labels of each run renamed so that they share most members with the reference."""
    met = runs.select("seed", "id", F.col("label").alias("a")).join(reference.select("id", F.col("label").alias("b")), "id").groupBy("seed", "a", "b").agg(F.count(F.lit(1)).alias("n"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        cost = np.zeros((k, k))
        cost[pdf.a, pdf.b] = -pdf.n
        return pd.DataFrame({"seed": pdf.seed.iloc[0], "a": np.arange(k), "b": best_assignment(cost)})

    names = met.groupBy("seed").applyInPandas(match, "seed long, a long, b long")
    return runs.join(names, (runs.seed == names.seed) & (runs.label == names.a)).select(runs.seed, "id", F.col("b").alias("label"))


def confidence(relabelled: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, confidence): share of runs that agree with the reference."""
    return relabelled.join(reference.select("id", F.col("label").alias("_r")), "id").groupBy("id").agg(F.avg((F.col("label") == F.col("_r")).cast("double")).alias("confidence"))


def halves(nodes: DataFrame, splits: int) -> DataFrame:
    """(split, half, id, x): nodes halved by a replayable md5 order in each split."""
    fan = nodes.join(F.broadcast(nodes.sparkSession.range(splits).select(F.col("id").alias("split"))))
    key = F.md5(F.concat_ws("-", F.col("split").cast("string"), nodes["id"].cast("string")))
    return fan.select("split", (F.row_number().over(Window.partitionBy("split").orderBy(key)) % 2).alias("half"), nodes["id"].alias("id"), "x")


def prediction_strength(nodes: DataFrame, k: int, splits: int) -> DataFrame:
    """(split, half, strength) over both directions of each split."""
    h = halves(nodes, splits)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, split = [], int(pdf.split.iloc[0])
        pdf = pdf.sort_values("id", kind="stable")
        part = {a: np.array(pdf[pdf.half == a].x.tolist(), float) for a in (0, 1)}
        lab = {a: kmeans_fit(part[a], k, split, 2)[0] for a in (0, 1)}
        for test in (0, 1):
            c = np.array([part[1 - test][lab[1 - test] == j].mean(0) for j in range(k) if (lab[1 - test] == j).any()])
            pred = ((part[test][:, None] - c[None]) ** 2).sum(2).argmin(1)
            ratios = []
            for j in range(k):
                m = np.bincount(pred[lab[test] == j], minlength=k)
                n = m.sum()
                if n >= 2:
                    ratios.append((m * (m - 1)).sum() / (n * (n - 1)))
            out.append((split, test, float(min(ratios))))
        return pd.DataFrame(out, columns=["split", "half", "strength"])

    return h.groupBy("split").applyInPandas(run, "split long, half long, strength double")


def uniform_in_box(x: np.ndarray, seed: int) -> np.ndarray:
    """As many vectors, of the same kind, drawn uniformly from the box around x along its principal axes."""
    m = sum(v.sum(axis=0) for _, v in slices(x)) / len(x)
    axes = np.linalg.eigh(sum((v - m).T @ (v - m) for _, v in slices(x)))[1].T[::-1]
    low, high = np.full(x.shape[1], np.inf), np.full(x.shape[1], -np.inf)
    for _, v in slices(x):
        v = (v - m) @ axes.T
        low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
    rng, out = np.random.default_rng(seed), np.empty_like(x)
    for own, v in slices(x):
        out[own] = rng.uniform(low, high, v.shape) @ axes + m
    return out


def gap_curve(nodes: DataFrame, ks: list[int], refs: int) -> DataFrame:
    """(k, gap, s): log inertia against uniform references in the box of the principal axes."""
    fan = nodes.select("id", "x").join(F.broadcast(nodes.sparkSession.createDataFrame([(k, b) for k in ks for b in range(-1, refs)], "k int, ref int")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, _, x = sorted_vectors(batches)
        k, ref = first["k"], first["ref"]
        if ref >= 0:
            x = uniform_in_box(x, ref)
        w = float(np.log(max(kmeans_fit(x, k, 0, 2)[1], 1e-12)))
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([ref], pa.int32()), pa.array([w])], ["k", "ref", "w"])

    return gaps(fan.groupBy("k", "ref").applyInArrow(run, "k int, ref int, w double"), refs)


def gaps(w: DataFrame, refs: int) -> DataFrame:
    """(k, gap, s) from the log inertias (k, ref, w), those of ref -1 being of the vectors themselves."""
    g = w.groupBy("k").agg(F.avg(F.when(F.col("ref") >= 0, F.col("w"))).alias("m"), F.max(F.when(F.col("ref") < 0, F.col("w"))).alias("own"), F.stddev_pop(F.when(F.col("ref") >= 0, F.col("w"))).alias("sd"))
    return g.select("k", (F.col("m") - F.col("own")).alias("gap"), (F.col("sd") * (1 + 1 / refs) ** 0.5).alias("s"))


def pca(nodes: DataFrame, sign: int = 0) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Projections (id, pc), variance shares and loadings; each loading's entry ``sign`` is made positive.

    The covariance, p by p, is aggregated; only it goes to the driver.
    """
    v = nodes.select("id", F.posexplode("x").alias("d", "v"))
    mean = [r[1] for r in v.groupBy("d").agg(F.avg("v")).orderBy("d").collect()]
    a, b = v.alias("a"), v.alias("b")
    cov = a.join(b, F.col("a.id") == F.col("b.id")).groupBy(F.col("a.d").alias("i"), F.col("b.d").alias("j")).agg(F.covar_pop("a.v", "b.v").alias("c")).collect()
    m = np.zeros((len(mean), len(mean)))
    for r in cov:
        m[r["i"], r["j"]] = r["c"]
    val, vec = np.linalg.eigh(m)
    val, vec = val[::-1], vec[:, ::-1]
    vec = vec * np.where(vec[sign] < 0, -1, 1)
    centred = F.transform("x", lambda x, i: x - F.array(*map(F.lit, mean))[i])
    pc = F.array(*[F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(c)) for c in vec[:, j]]), lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t) for j in range(min(3, len(mean)))])
    return nodes.select("id", pc.alias("pc")), [float(x) for x in val / val.sum()], vec.T.tolist()
