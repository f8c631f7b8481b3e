"""Comparison of many partitions of the same nodes: rows (run, id, label)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio
from meshwork.operators.panel import best_assignment
from meshwork.operators.stats import spearman


def contingencies(runs: DataFrame) -> DataFrame:
    """(a, b, i, j, n) of all pairs of runs a < b, in one pass: a node's labels of all runs are one array, whose pairs are counted before they move.

    Nodes that lack a run don't count for its pairs. What is shuffled is labels squared for each pair of runs, not nodes.
    """
    listed = runs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("run", "label"))).alias("all"))
    first = listed.select("all", F.posexplode("all").alias("at", "p"))
    both = first.select("p", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("q"))
    return both.groupBy(F.col("p.run").alias("a"), F.col("q.run").alias("b"), F.col("p.label").alias("i"), F.col("q.label").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def ari_of(m: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, ari) of contingencies (keys, i, j, n): adjusted Rand indices, null where they aren't defined."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    side = lambda c, name: m.groupBy(*keys, c).agg(F.sum("n").alias("_k")).groupBy(*keys).agg(F.sum(two("_k")).alias(name))
    whole = m.groupBy(*keys).agg(F.sum(two("n")).alias("same"), F.sum("n").alias("n"))
    s = whole.join(side("i", "rows"), keys).join(side("j", "columns"), keys)
    expected = F.col("rows") * F.col("columns") / F.nullif(two("n"), F.lit(0.0))
    return s.select(*keys, "n", ratio(F.col("same") - expected, (F.col("rows") + F.col("columns")) / 2 - expected).alias("ari"))


def pairwise_ari(runs: DataFrame) -> DataFrame:
    """(a, b, n, ari) of all pairs of runs a < b: the adjusted Rand index over the nodes that both have."""
    return ari_of(contingencies(runs), ["a", "b"])


def both_ends(pairs: DataFrame) -> DataFrame:
    """(run, other, ari) from either end."""
    return pairs.select(F.col("a").alias("run"), F.col("b").alias("other"), "ari").unionByName(pairs.select(F.col("b").alias("run"), F.col("a").alias("other"), "ari"))


def near_best(costs: DataFrame, gap: float) -> DataFrame:
    """The runs (run, cost) whose cost is within ``gap`` of the least."""
    return costs.join(F.broadcast(costs.agg(F.min("cost").alias("_least")))).where(F.col("cost") <= F.col("_least") + gap).drop("_least")


def alike(costs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(run, first): runs by cost (to six digits), then name; each belongs to the first of the leading runs before it with an index of ``least`` or more, or leads.

    The fold is over the runs, of which there are few, not over nodes.
    """
    near = both_ends(pairs).where(F.col("ari") >= least).groupBy("run").agg(F.collect_set("other").alias("near"))
    known = costs.join(near, "run", "left").select(F.round("cost", 6).alias("cost"), "run", F.coalesce("near", F.array().cast(dict(near.dtypes)["near"])).alias("near"))
    row = known.agg(F.sort_array(F.collect_list(F.struct("cost", "run", "near"))).alias("runs"))
    kind = dict(costs.dtypes)["run"]
    start = F.expr(f"cast(array() as array<struct<run: {kind}, first: {kind}>>)")

    def put(acc, r):
        leader = F.get(F.filter(acc, lambda x: (x["run"] == x["first"]) & F.array_contains(r["near"], x["run"])), F.lit(0))["first"]
        return F.array_append(acc, F.struct(r["run"].alias("run"), F.coalesce(leader, r["run"]).alias("first")))

    return row.select(F.explode(F.aggregate("runs", start, put)).alias("r")).select("r.run", "r.first")


def best_against_rest(scores: DataFrame, pairs: DataFrame, high: float = 0.8) -> DataFrame:
    """One row: the run of the greatest score (ties to the smallest), its indices with the others, the share of them that is ``high``, and rho of score and index."""
    best = scores.agg(F.max(F.struct(F.round("score", 12).alias("s"), (-F.col("run").cast("long")).alias("r"))).alias("m")).select((-F.col("m.r")).alias("best"))
    one = both_ends(pairs).join(F.broadcast(best), F.col("other").cast("long") == F.col("best")).select("best", "run", "ari").join(scores, "run")
    rho = spearman(one, "score", "ari").select("rho")
    a = one.agg(F.max("best").alias("best"), F.count("ari").alias("n"), F.min("ari").alias("least"), F.median("ari").alias("median"), F.avg((F.col("ari") >= high).cast("double")).alias("share_high"))
    return a.join(F.broadcast(rho))


def disjoint_pairs(runs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(a, b, ari) of ``n`` pairs of runs of which no two share a run, drawn by the order of the names' md5."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.md5(F.col("run").cast("string")), "run")  # over the runs, of which there are few
    drawn = runs.select("run").distinct().withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < 2 * n)
    met = drawn.groupBy(F.floor(F.col("k") / 2).alias("p")).agg(F.min("run").alias("a"), F.max("run").alias("b"), F.count(F.lit(1)).alias("m")).where("m = 2")
    return met.join(pairs, ["a", "b"]).select("a", "b", "ari")


def label_counts(runs: DataFrame) -> DataFrame:
    """(k, n_runs, is_mode): how many runs have how many labels, and the most frequent numbers."""
    k = runs.groupBy("run").agg(F.countDistinct("label").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_runs"))
    top = k.agg(F.max("n_runs").alias("top"))
    return k.join(F.broadcast(top)).select("k", "n_runs", (F.col("n_runs") == F.col("top")).alias("is_mode"))


def matched(runs: DataFrame, canonical: DataFrame) -> DataFrame:
    """``runs`` with labels renamed to those of ``canonical`` (id, label) so that most nodes agree, one label to one; labels that are too many have null.

    A run's table of labels by labels goes to one task; nodes don't.
    """
    kind = dict(runs.dtypes)
    cross = runs.join(canonical.select("id", F.col("label").alias("own")), "id").groupBy("run", "label", "own").agg(F.count(F.lit(1)).alias("n"))

    def names(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot_table(index="label", columns="own", values="n", fill_value=0, aggfunc="sum").sort_index().sort_index(axis=1)
        size = max(t.shape)
        cost = np.zeros((size, size))
        cost[: t.shape[0], : t.shape[1]] = -t.to_numpy()
        to = best_assignment(cost)
        return pd.DataFrame({"run": pdf.run.iloc[0], "label": t.index, "new": [t.columns[j] if j < t.shape[1] else None for j in to[: t.shape[0]]]})

    found = cross.groupBy("run").applyInPandas(names, f"run {kind['run']}, label {kind['label']}, new {kind['label']}")
    return runs.join(F.broadcast(found), ["run", "label"], "left").select("run", "id", F.col("new").alias("label"))


def mobile_share(runs: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row: the share of nodes that some run, after matching, puts elsewhere than ``canonical`` does."""
    moved = matched(runs, canonical).join(canonical.select("id", F.col("label").alias("own")), "id")
    each = moved.groupBy("id").agg(F.max((~F.col("label").eqNullSafe(F.col("own"))).cast("int")).alias("moved"))
    return each.agg(F.avg(F.col("moved").cast("double")).alias("share"), F.count(F.lit(1)).alias("n_nodes"))
