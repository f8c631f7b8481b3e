"""S_Dbw of permuted labels, and how far the real labels lie from them.

Rows are dealt once into blocks of vectors. How many rows of each label a block gets in each permutation is drawn from the multivariate
hypergeometric distribution, block after block, and a block shuffles its own labels under these counts, from a seed of its own: so each pass draws the same
labels again, and none is ever written. Three passes go over the blocks, for sums, for the points nearest to the means, and for densities; what meets
are totals by (permutation, label) or (permutation, label, label), combined within a task first.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio
from meshwork.session import materialize

#: Vectors of a block, and the most numbers that the centres of all permutations may have, since each task gets them all.
BLOCK = 4096
MOST = 20_000_000


class Permuted:
    """``n`` permutations of the labels of ``nodes`` (id, x, label), each label as frequent as before. Rows without a label or vector are left out."""

    def __init__(self, nodes: DataFrame, n: int = 100, seed: int = 0, block: int = BLOCK):
        self.spark, self.n, self.seed = nodes.sparkSession, n, seed
        rows = nodes.where(F.col("x").isNotNull() & F.col("label").isNotNull()).select(F.col("id").cast("long").alias("id"), "x", F.col("label").cast("string").alias("label"))
        parts = max(1, -(-rows.count() // block))
        dealt = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("b"))
        self.blocks = materialize(dealt.agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("rows"), F.count(F.lit(1)).cast("int").alias("m")))
        sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("c")).orderBy("label").collect()
        self.labels, self.sizes = [r.label for r in sizes], [r.c for r in sizes]
        self.dims = (self.blocks.select(F.size(F.col("rows")[0]["x"]).alias("d")).first() or [0])[0]
        if n * len(sizes) * self.dims > MOST:
            raise ValueError(f"{n} permutations of {len(sizes)} centres with {self.dims} numbers each are more than {MOST}; ask for fewer permutations")
        self.counts = materialize(self._counts())

    def _counts(self) -> DataFrame:
        """(b, counts): how many rows of each label a block gets in each permutation. The permutations are dealt to tasks; each goes through the blocks' sizes."""
        sizes, seed = self.sizes, self.seed
        blocks = self.blocks.agg(F.sort_array(F.collect_list(F.struct("b", "m"))).alias("blocks"))
        perms = self.spark.range(self.n).withColumnRenamed("id", "perm").repartition(min(self.n, 32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    left, rng, out = np.array(sizes, np.int64), np.random.default_rng([seed, r["perm"]]), []
                    for at in r["blocks"]:
                        taken = rng.multivariate_hypergeometric(left, at["m"], method="marginals")
                        left = left - taken
                        out.append(taken.tolist())
                    yield pa.RecordBatch.from_pydict({"b": pa.array([at["b"] for at in r["blocks"]], pa.int32()), "perm": pa.array([r["perm"]] * len(out), pa.int64()), "c": pa.array(out, pa.list_(pa.int64()))})

        drawn = perms.join(F.broadcast(blocks)).mapInArrow(run, "b int, perm long, c array<bigint>")  # the blocks are one row
        return drawn.groupBy("b").agg(F.transform(F.sort_array(F.collect_list(F.struct("perm", "c"))), lambda p: p["c"]).alias("counts"))

    def _each(self, work: Callable, schema: str) -> DataFrame:
        """``work(blocks)`` in each task; a block is (ids, vectors, labels of all permutations)."""
        seed = self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def blocks():
                for batch in batches:
                    for i in range(batch.num_rows):
                        r = batch.slice(i, 1).to_pylist()[0]
                        ids, x = np.array([v["id"] for v in r["rows"]], np.int64), np.array([v["x"] for v in r["rows"]], float)
                        rng = np.random.default_rng([seed, zlib.crc32(str(r["b"]).encode()), 1])
                        yield ids, x, [rng.permutation(np.repeat(np.arange(len(c)), c)) for c in r["counts"]]

            yield from work(blocks())

        return self.blocks.join(self.counts, "b").mapInArrow(run, schema)

    def labelled(self) -> DataFrame:
        """(perm, id, label) of all permutations, for tests and small tables."""
        names = self.labels

        def work(blocks):
            for ids, _, drawn in blocks:
                for p, lab in enumerate(drawn):
                    yield pa.RecordBatch.from_pydict({"perm": pa.array([p] * len(ids), pa.int32()), "id": ids, "label": [names[k] for k in lab]})

        return self._each(work, "perm int, id long, label string")

    def _sums(self) -> np.ndarray:
        """Sums and sums of squares by permutation, label and dimension, about the mean of all rows, and those of all rows."""
        n, k, d = self.n, len(self.labels), self.dims
        mean = self._mean()

        def work(blocks):
            total = np.zeros((2, n, k, d))
            for _, x, drawn in blocks:
                x = x - mean
                for p, lab in enumerate(drawn):
                    own = np.zeros((k, len(x)))
                    own[lab, np.arange(len(x))] = 1.0
                    total[0, p] += own @ x
                    total[1, p] += own @ (x * x)
            p, g, at = (v.ravel() for v in np.indices((n, k, d)))
            yield pa.RecordBatch.from_pydict({"p": p.astype(np.int32), "g": g.astype(np.int32), "d": at.astype(np.int32), "s": total[0].ravel(), "q": total[1].ravel()})

        met = self._each(work, "p int, g int, d int, s double, q double").groupBy("p", "g", "d").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).toPandas()
        out = np.zeros((2, n, k, d))
        out[:, met.p, met.g, met.d] = met[["s", "q"]].to_numpy().T
        return out

    def _mean(self) -> np.ndarray:
        v = self.blocks.select(F.explode("rows").alias("r")).select(F.posexplode("r.x").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("m")).orderBy("d").collect()
        return np.array([r.m for r in v])

    def s_dbw(self) -> DataFrame:
        """(perm, scat, dens_bw, s_dbw) of each permutation, null where two labels have no point near either centre."""
        n, k, mean = self.n, len(self.labels), self._mean()
        sums, squares = self._sums()
        c = np.array(self.sizes, float)[None, :, None]
        own = np.sqrt((np.maximum(squares / c - (sums / c) ** 2, 0.0) ** 2).sum(axis=2))
        whole = np.sqrt(((squares[0].sum(axis=0) / c.sum() - (sums[0].sum(axis=0) / c.sum()) ** 2) ** 2).sum())
        scat, sd, centres = own.mean(axis=1) / whole, np.sqrt(own.sum(axis=1)) / k, sums / c + mean
        nearest = self._nearest(centres)
        met = self._densities(nearest, sd)
        i, j = met.alias("i"), met.alias("j")  # n * k * k rows
        pair = i.join(j, (F.col("i.p") == F.col("j.p")) & (F.col("i.g") == F.col("j.h")) & (F.col("i.h") == F.col("j.g")) & (F.col("i.g") < F.col("i.h")))
        own = met.where("g = h").select("p", F.col("g").alias("of"), F.col("at").alias("home"))
        pair = pair.select(F.col("i.p").alias("p"), F.col("i.g").alias("a"), F.col("i.h").alias("b"), (F.col("i.mid") + F.col("j.mid")).alias("mid"), F.col("j.at").alias("ja"), F.col("i.at").alias("ib"))
        pair = pair.join(own.withColumnsRenamed({"of": "a", "home": "ha"}), ["p", "a"]).join(own.withColumnsRenamed({"of": "b", "home": "hb"}), ["p", "b"])
        r = ratio(F.col("mid").cast("double"), F.greatest(F.col("ha") + F.col("ja"), F.col("hb") + F.col("ib")).cast("double"))
        dens = pair.withColumn("r", r).groupBy("p").agg(F.sum("r").alias("r"), F.count_if(F.col("r").isNull()).alias("open"))
        bw = F.when(F.col("open") == 0, 2 * F.col("r") / (k * (k - 1)))
        scats = self.spark.createDataFrame([(p, float(scat[p])) for p in range(n)], "p int, scat double")
        return scats.join(dens, "p").select(F.col("p").alias("perm"), "scat", bw.alias("dens_bw"), (F.col("scat") + bw).alias("s_dbw"))

    def _nearest(self, centres: np.ndarray) -> np.ndarray:
        """The point of each permutation and label that is nearest to the label's mean, the smallest id of equally near ones."""

        def work(blocks):
            best = {}
            for ids, x, drawn in blocks:
                for p, lab in enumerate(drawn):
                    d = np.round(np.sqrt(((x - centres[p, lab]) ** 2).sum(axis=1)), 9)
                    order = np.lexsort((ids, d, lab))
                    for at in order[np.unique(lab[order], return_index=True)[1]]:
                        key, found = (p, int(lab[at])), (float(d[at]), int(ids[at]))
                        if key not in best or found < best[key][:2]:
                            best[key] = (*found, x[at].tolist())
            if best:
                rows = list(best.items())
                yield pa.RecordBatch.from_pydict({
                    "p": pa.array([key[0] for key, _ in rows], pa.int32()), "g": pa.array([key[1] for key, _ in rows], pa.int32()),
                    "d": [v[0] for _, v in rows], "id": pa.array([v[1] for _, v in rows], pa.int64()), "x": pa.array([v[2] for _, v in rows], pa.list_(pa.float64())),
                })

        out = np.zeros_like(centres)
        met = self._each(work, "p int, g int, d double, id long, x array<double>").groupBy("p", "g").agg(F.min(F.struct("d", "id", "x"))["x"].alias("x"))
        for r in met.collect():  # one row for each permutation and label, bounded by MOST
            out[r.p, r.g] = r.x
        return out

    def _densities(self, near: np.ndarray, sd: np.ndarray) -> DataFrame:
        """(p, g, h, mid, at): rows of label g within sd of the middle of the centres of g and h, and of the centre of h."""
        n, k = near.shape[:2]

        def work(blocks):
            mid, at = np.zeros((n, k, k), np.int64), np.zeros((n, k, k), np.int64)
            for _, x, drawn in blocks:
                for p, lab in enumerate(drawn):
                    for g in range(k):
                        mine = x[lab == g]
                        for h in range(k):
                            at[p, g, h] += (np.sqrt(((mine - near[p, h]) ** 2).sum(axis=1)) <= sd[p]).sum()
                            if g != h:
                                mid[p, g, h] += (np.sqrt(((mine - (near[p, g] + near[p, h]) / 2) ** 2).sum(axis=1)) <= sd[p]).sum()
            p, g, h = (v.ravel().astype(np.int32) for v in np.indices((n, k, k)))
            yield pa.RecordBatch.from_pydict({"p": p, "g": g, "h": h, "mid": mid.ravel(), "at": at.ravel()})

        return materialize(self._each(work, "p int, g int, h int, mid long, at long").groupBy("p", "g", "h").agg(F.sum("mid").alias("mid"), F.sum("at").alias("at")))


def standing(real: DataFrame, null: DataFrame, value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """One row: the real value, mean and standard deviation of the null's values, z of the real one, and z's 2.5 and 97.5 percent points over resamples of the null.

    ``real`` is one row; a null with an undefined value gives no z. ``undefined`` counts these.
    """
    v = null.agg(F.sort_array(F.collect_list(value)).alias("v"), F.count_if(F.col(value).isNull()).alias("undefined"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    one = real.select(F.col(value).alias("value")).join(F.broadcast(v))
    draw = null.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(one))
    pick = lambda i: F.element_at("v", (F.pmod(F.xxhash64("draw", i, F.lit(seed)), F.size("v")) + 1).cast("int"))
    drawn = draw.select("draw", "value", F.transform(F.sequence(F.lit(1), F.size("v")), pick).alias("w")).select("draw", "value", F.explode("w").alias("w"))
    z = drawn.groupBy("draw").agg(((F.first("value") - F.avg("w")) / F.nullif(F.stddev_samp("w"), F.lit(0.0))).alias("z"))
    q = z.agg(F.percentile("z", [0.025, 0.975]).alias("q"))
    sure = lambda c: F.when(F.col("undefined") == 0, c)
    return one.join(F.broadcast(q)).select("value", "mean", "std", sure((F.col("value") - F.col("mean")) / F.nullif("std", F.lit(0.0))).alias("z"), sure(F.col("q")[0]).alias("low"), sure(F.col("q")[1]).alias("high"), "undefined")
