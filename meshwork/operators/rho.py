"""Bootstrap intervals of a rank correlation, ranked anew in every draw.

A draw weighs rows by Poisson(1) numbers that follow from id and draw. A row's rank in a draw is the weight of lower values plus the middle of its ties.
Values fall into ranges, a frequent value into one of its own. A batch of draws at a time,

* each range of y and its weights give the ranks of its rows, an array with a number for each draw of the batch;
* the rows meet again by their range of x, where their place among x follows, up to the weight of the ranges below;
* that weight is added to the ranges' sums of products, so that only sums by (range, draw) meet in the end.

What is shuffled is one array for each row and batch; no task holds more than a range, and no draw is ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.rank import with_ranks, with_within_ranks
from meshwork.operators.resample import poisson_weights
from meshwork.session import materialize, small_side

#: Rows that a range has about, draws of a batch, and parts of a range that holds one frequent value alone.
RANGE, BATCH, SALTS = 4096, 500, 16
SUMS = ["w", "a", "q", "b", "c", "p"]


def _dealt(rows: DataFrame, v: str, ranges: int) -> DataFrame:
    """Adds ``<v>b``, the range of v within its stratum (odd: one value alone), and ``<v>s``, a part of the range (else 0)."""
    splits = rows.groupBy("r").agg(F.percentile_approx(v, [i / ranges for i in range(1, ranges)], 10_000).alias("_s"))
    cut = rows.join(small_side(splits, 1000), "r")
    hot = F.size(F.filter("_s", lambda e: e == F.col(v))) > 1
    place = F.size(F.filter("_s", lambda e: e < F.col(v))) * 2 + hot.cast("int")
    return cut.withColumn(f"{v}b", place.cast("int")).withColumn(f"{v}s", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")).drop("_s")


def _draws(batch: int, n: int) -> np.ndarray:
    return np.arange(batch * BATCH, min(n, (batch + 1) * BATCH))


def _places(v: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The ranks of ascending v in each draw, ties sharing the middle of theirs."""
    upto = np.cumsum(weights, axis=0)
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    last = np.r_[first[1:], len(v)] - 1
    size = np.diff(np.r_[first, len(v)])
    top = upto[last]
    below = np.vstack([np.zeros((1, upto.shape[1])), top[:-1]])
    return np.repeat(below + (top - below + 1) / 2, size, axis=0)


def _totals(n: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(len(_draws(pdf.batch[0], n)), np.int64)
        for at in range(0, len(pdf), 1024):
            w += poisson_weights(pdf.id[at : at + 1024].to_numpy(np.int64), _draws(pdf.batch[0], n)).sum(axis=0)
        return pd.DataFrame({"r": [pdf.r[0]], "bin": [pdf.bin[0]], "batch": [pdf.batch[0]], "total": [w.astype("<i8").tobytes()]})

    return run


def _bases(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is added to places within a range: the weight below it, and for one value alone the middle of its own."""
    pdf = pdf.groupby("bin", sort=True).total.apply(lambda t: sum(np.frombuffer(b, "<i8") for b in t)).reset_index().assign(r=pdf.r[0], batch=pdf.batch[0])
    below, out = 0, []
    for b, total in zip(pdf.bin, pdf.total):
        out.append((below + ((total + 1) / 2 if b % 2 else 0.0) + np.zeros(len(total))).astype("<f8").tobytes())
        below = below + total
    return pd.DataFrame({"r": pdf.r, "bin": pdf.bin, "batch": pdf.batch, "base": out})


def _ranks(n: int):
    """Rows of a range of y, as (r, xb, xs, batch, id, x, ranks of y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.slice(i, 1).to_pylist()[0]
                ids, v = np.array([e["id"] for e in d["rows"]], np.int64), np.array([e["y"] for e in d["rows"]])
                ranks = np.frombuffer(d["base"], "<f8")[None, :] + np.zeros((len(ids), 1))
                if d["yb"] % 2 == 0:
                    ranks = ranks + _places(v, poisson_weights(ids, _draws(d["batch"], n)))
                ranks = ranks.astype("<f8")
                yield pa.RecordBatch.from_pydict({
                    "r": pa.array([d["r"]] * len(ids), pa.string()), "xb": pa.array([e["xb"] for e in d["rows"]], pa.int32()), "xs": pa.array([e["xs"] for e in d["rows"]], pa.int32()),
                    "batch": pa.array([d["batch"]] * len(ids), pa.int32()), "id": ids, "x": [e["x"] for e in d["rows"]], "ry": [row.tobytes() for row in ranks],
                })

    return run


def _products(n: int):
    """Sums of a range of x in each draw: weights, places, their squares, ranks of y, their squares, products."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable").reset_index(drop=True)
        draws = _draws(pdf.batch[0], n)
        w, ry = poisson_weights(pdf.id.to_numpy(np.int64), draws), np.stack([np.frombuffer(b, "<f8") for b in pdf.ry])
        at = _places(pdf.x.to_numpy(float), w) if pdf.xb[0] % 2 == 0 else np.zeros(ry.shape)
        sums = [w, w * at, w * at * at, w * ry, w * ry * ry, w * at * ry]
        return pd.DataFrame({"r": pdf.r[0], "bin": pdf.xb[0], "batch": pdf.batch[0], "draw": draws} | {c: s.sum(axis=0).astype(float) for c, s in zip(SUMS, sums)})

    return run


def bootstrap_draws(df: DataFrame, id: str, x: str, y: str, n: int = 5000, region: str | None = None, size: int = RANGE) -> DataFrame:
    """(draw, rho) of n draws; within ``region``, ranks are (rank - 0.5) / weight of the region. A draw without spread has no rho.

    ``id`` is a whole number; rows without x, y or region are left out.
    """
    r = F.col(region).cast("string") if region else F.lit("")
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), r.alias("r")).dropna()
    rows = materialize(rows)
    most = rows.groupBy("r").count().agg(F.max("count")).first()[0] or 0
    ranges = max(2, -(-most // size))
    rows = materialize(_dealt(_dealt(rows, "x", ranges), "y", ranges))
    batches = rows.sparkSession.range(-(-n // BATCH)).select(F.col("id").cast("int").alias("batch"))

    def bases(v: str) -> DataFrame:
        part = rows.select("r", F.col(f"{v}b").alias("bin"), F.col(f"{v}s").alias("s"), "id").join(F.broadcast(batches))  # n / BATCH rows
        totals = part.groupBy("r", "bin", "s", "batch").applyInPandas(_totals(n), "r string, bin int, batch int, total binary")
        return materialize(totals.groupBy("r", "batch").applyInPandas(_bases, "r string, bin int, batch int, base binary"))

    of_y = bases("y").withColumnRenamed("bin", "yb")
    blocks = materialize(rows.groupBy("r", "yb", "ys").agg(F.sort_array(F.collect_list(F.struct("y", "id", "x", "xb", "xs"))).alias("rows")))
    ranked = blocks.join(of_y, ["r", "yb"]).mapInArrow(_ranks(n), "r string, xb int, xs int, batch int, id long, x double, ry binary")
    kinds = ", ".join(f"{c} double" for c in SUMS)
    sums = ranked.groupBy("r", "xb", "xs", "batch").applyInPandas(_products(n), f"r string, bin int, batch int, draw long, {kinds}")
    base = F.element_at(F.col("bs"), (F.col("draw") % BATCH + 1).cast("int"))
    unpacked = bases("x").mapInPandas(lambda frames: (f.assign(bs=[np.frombuffer(b, "<f8").tolist() for b in f.base])[["r", "bin", "batch", "bs"]] for f in frames), "r string, bin int, batch int, bs array<double>")
    met = sums.join(unpacked, ["r", "bin", "batch"]).withColumn("o", base).drop("bs")
    # a place is o + what is known within the range
    whole = met.groupBy("r", "draw").agg(
        F.sum("w").alias("n"), F.sum(F.col("a") + F.col("o") * F.col("w")).alias("x"), F.sum("b").alias("y"),
        F.sum(F.col("q") + 2 * F.col("o") * F.col("a") + F.col("o") * F.col("o") * F.col("w")).alias("xx"),
        F.sum("c").alias("yy"), F.sum(F.col("p") + F.col("o") * F.col("b")).alias("xy"),
    ).where("n > 0")
    if region:
        m, sx, sy = F.col("n"), F.col("x"), F.col("y")
        shift = {"x": (sx - m / 2) / m, "y": (sy - m / 2) / m, "xx": (F.col("xx") - sx + m / 4) / (m * m), "yy": (F.col("yy") - sy + m / 4) / (m * m), "xy": (F.col("xy") - sx / 2 - sy / 2 + m / 4) / (m * m)}
        whole = whole.select("draw", "n", *[c.alias(k) for k, c in shift.items()]).groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    m, sx, sy = F.col("n"), F.col("x"), F.col("y")
    spread = (F.col("xx") - sx * sx / m) * (F.col("yy") - sy * sy / m)
    return whole.select("draw", F.when(spread > 1e-9 * m, (F.col("xy") - sx * sy / m) / F.sqrt(spread)).alias("rho"))


def bootstrap_rho(df: DataFrame, id: str, x: str, y: str, n: int = 5000, region: str | None = None) -> DataFrame:
    """One row (rho, low, high, n_rows, n_draws): the correlation and its 2.5 and 97.5 percent points over the draws."""
    rows = df.dropna(subset=[x, y, *([region] if region else [])]).select(F.col(id).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y"), *([F.col(region).alias("stratum")] if region else []))
    if region:
        ranked = with_within_ranks(with_within_ranks(rows, "_x", "_u", ["stratum"]), "_y", "_v", ["stratum"])
    else:
        ranked = with_ranks(with_ranks(rows, "_x", "_u"), "_y", "_v")
    own = ranked.agg(F.corr("_u", "_v").alias("rho"), F.count(F.lit(1)).alias("n_rows"))
    q = bootstrap_draws(df, id, x, y, n, region).agg(F.percentile("rho", [0.025, 0.975]).alias("q"), F.count("rho").alias("n_draws"))
    return own.join(F.broadcast(q)).select("rho", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n_rows", "n_draws")
