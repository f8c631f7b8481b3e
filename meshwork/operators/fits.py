"""Many k-means fits at once: every (slice, k, seed) is a run, and a round of Lloyd's algorithm is one pass over the nodes for all runs.

Nodes (by, id, x) stay where they are. A task assigns its rows to the centres of all runs of their slices and returns
sums by (run, label); what is shuffled is runs times labels for each batch of rows, whatever the slices hold. The centres of all runs, slices x
seeds x the sum of k vectors, go through the driver and to every task: their number follows from the parameters and
the number of slices, and ``MOST`` bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio
from meshwork.operators.runs import ari_of

#: Numbers in the centres of all runs.
MOST = 20_000_000


class Run(NamedTuple):
    k: int
    seed: int


class Fits(NamedTuple):
    """The runs, and for each slice the centres of each run."""

    by: str
    runs: list[Run]
    centres: dict[object, list[np.ndarray]]
    rounds: int


def seeded(nodes: DataFrame, by: str, ks: list[int], seeds: int) -> Fits:
    """Runs that start from nodes drawn by a hash of id and seed; slices of fewer nodes than k have no run of that k and are left out."""
    draws = nodes.select(by, "id", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    w = Window.partitionBy(by, "seed").orderBy(F.xxhash64("id", "seed"), "id")
    first = draws.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(ks))
    found: dict[tuple, list] = {}
    for r in first.join(nodes.select(by, "id", "x"), [by, "id"]).collect():  # slices x seeds x the greatest k
        found.setdefault((r[by], r["seed"]), []).append((r["r"], r["x"]))
    runs = [Run(k, s) for k in ks for s in range(seeds)]
    centres = {}
    for slice_ in {s for s, _ in found}:
        points = [np.array([x for _, x in sorted(found[slice_, s])], float) for s in range(seeds)]
        if len(points[0]) >= max(ks):
            centres[slice_] = [points[r.seed][: r.k] for r in runs]
    if sum(c.size for own in centres.values() for c in own) > MOST:
        raise ValueError("the centres of so many runs are too large; fit fewer slices at once")
    return Fits(by, runs, centres, 0)


def _slices(pdf: pd.DataFrame, fits: Fits) -> Iterator[tuple[object, pd.DataFrame, np.ndarray]]:
    for slice_, rows in pdf.groupby(fits.by, sort=False):
        if slice_ in fits.centres:
            yield slice_, rows, np.array(rows.x.tolist(), float)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, by differences."""
    return np.stack([np.square(x - m).sum(axis=1) for m in c], axis=1)


def _sums(fits: Fits):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for slice_, _, x in _slices(pdf, fits):
                out = []
                for i, c in enumerate(fits.centres[slice_]):
                    d = distances(x, c)
                    lab = d.argmin(axis=1)
                    for j in np.unique(lab):
                        own = lab == j
                        out.append((slice_, i, int(j), int(own.sum()), float(d[own, j].sum()), x[own].sum(axis=0).tolist()))
                yield pd.DataFrame(out, columns=[fits.by, "run", "label", "n", "inertia", "s"])

    return run


def lloyd(nodes: DataFrame, fits: Fits, rounds: int, tolerance: float = 1e-9) -> Fits:
    """The runs after at most ``rounds`` rounds, fewer if no centre moves any more; a label without nodes keeps its centre."""
    kind = dict(nodes.dtypes)[fits.by]
    size = next((c[0].shape[1] for c in fits.centres.values()), 0)
    at = 0
    while at < rounds and fits.centres:
        at += 1
        part = nodes.select(fits.by, "x").mapInPandas(_sums(fits), f"`{fits.by}` {kind}, run int, label int, n long, inertia double, s array<double>")
        total = part.groupBy(fits.by, "run", "label").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
        new = {s: [c.copy() for c in own] for s, own in fits.centres.items()}
        moved = 0.0
        for r in total.collect():  # a row for each label of each run
            centre = np.array([r[f"s{i}"] for i in range(size)]) / r["n"]
            moved = max(moved, float(np.abs(centre - new[r[fits.by]][r["run"]][r["label"]]).max()))
            new[r[fits.by]][r["run"]][r["label"]] = centre
        fits = fits._replace(centres=new, rounds=fits.rounds + 1)
        if moved < tolerance:
            break
    return fits


def _figures(fits: Fits):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for slice_, _, x in _slices(pdf, fits):
                out = []
                for (k, seed), c in zip(fits.runs, fits.centres[slice_]):
                    d = np.sort(distances(x, c), axis=1)
                    near = np.sqrt(d[:, :2])
                    gap = np.divide(near[:, 1] - near[:, 0], near[:, 1], out=np.zeros(len(x)), where=near[:, 1] > 0) if k > 1 else np.zeros(len(x))
                    out.append((slice_, k, seed, len(x), float(d[:, 0].sum()), float(gap.sum()), float(np.square(x).sum()), x.sum(axis=0).tolist()))
                yield pd.DataFrame(out, columns=[fits.by, "k", "seed", "n", "inertia", "gap", "squares", "s"])

    return run


def indices(nodes: DataFrame, fits: Fits) -> DataFrame:
    """(by, k, seed, n, inertia, ch, silhouette) of all runs in one pass; the silhouette is the simplified one, by distances to the nearest two centres."""
    kind = dict(nodes.dtypes)[fits.by]
    size = next((c[0].shape[1] for c in fits.centres.values()), 0)
    part = nodes.select(fits.by, "x").mapInPandas(_figures(fits), f"`{fits.by}` {kind}, k int, seed int, n long, inertia double, gap double, squares double, s array<double>")
    a = part.groupBy(fits.by, "k", "seed").agg(*[F.sum(c).alias(c) for c in ("n", "inertia", "gap", "squares")], *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
    mean = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(size)), F.lit(0.0)) / F.col("n")
    between = F.col("squares") - mean - F.col("inertia")
    ch = ratio(between / F.nullif(F.col("k") - 1, F.lit(0)), F.col("inertia") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    return a.select(fits.by, "k", "seed", "n", "inertia", ch.alias("ch"), (F.col("gap") / F.col("n")).alias("silhouette"))


def best_seeds(figures: DataFrame, by: str) -> DataFrame:
    """The run of least inertia (to six digits, then the smaller seed) for each slice and k."""
    return figures.groupBy(by, "k").agg(F.min_by(F.struct(*[c for c in figures.columns if c not in (by, "k")]), F.struct(F.round("inertia", 6), "seed")).alias("b")).select(by, "k", "b.*")


def _pairs(fits: Fits):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for slice_, _, x in _slices(pdf, fits):
                labels = [distances(x, c).argmin(axis=1) for c in fits.centres[slice_]]
                out = []
                for p, q in combinations(range(len(fits.runs)), 2):
                    k = fits.runs[p].k
                    if fits.runs[q].k == k:
                        n = np.bincount(labels[p] * k + labels[q], minlength=k * k)
                        out += [(slice_, k, fits.runs[p].seed, fits.runs[q].seed, int(at // k), int(at % k), int(n[at])) for at in np.flatnonzero(n)]
                yield pd.DataFrame(out, columns=[fits.by, "k", "a", "b", "i", "j", "n"])

    return run


def seed_agreement(nodes: DataFrame, fits: Fits) -> DataFrame:
    """(by, k, a, b, n, ari): how alike two seeds' partitions of a slice are; tables of labels are counted where the nodes are."""
    kind = dict(nodes.dtypes)[fits.by]
    part = nodes.select(fits.by, "x").mapInPandas(_pairs(fits), f"`{fits.by}` {kind}, k int, a int, b int, i int, j int, n long")
    return ari_of(part.groupBy(fits.by, "k", "a", "b", "i", "j").agg(F.sum("n").alias("n")), [fits.by, "k", "a", "b"])


def stability_curve(agreement: DataFrame, figures: DataFrame, by: str) -> DataFrame:
    """(k, n_slices, ari_mean, ari_least, ch_mean, silhouette_mean, is_peak): medians of a slice's seeds, then over slices; a peak is better than k - 1 and k + 1."""
    own = agreement.groupBy(by, "k").agg(F.median("ari").alias("ari")).join(best_seeds(figures, by), [by, "k"])
    c = own.groupBy("k").agg(F.count(F.lit(1)).alias("n_slices"), F.avg("ari").alias("ari_mean"), F.min("ari").alias("ari_least"), F.avg("ch").alias("ch_mean"), F.avg("silhouette").alias("silhouette_mean"))
    beside = lambda step, name: c.select((F.col("k") + step).alias("k"), F.col("ari_mean").alias(name))
    met = c.join(F.broadcast(beside(1, "_before")), "k", "left").join(F.broadcast(beside(-1, "_after")), "k", "left")
    peak = (F.col("ari_mean") > F.col("_before")) & (F.col("ari_mean") > F.col("_after"))
    return met.withColumn("is_peak", F.coalesce(peak, F.lit(False))).drop("_before", "_after")
