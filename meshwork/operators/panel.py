"""Labels of nodes over ordered periods: changes, stability, transitions, matching."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio


def dominant(fact: DataFrame, keys: list[str], category: str = "category", value: str = "value") -> DataFrame:
    """(keys, label): the category of the largest value, ties to the smallest name."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(category).alias("label")))
    return fact.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.label").alias("label"))


def steps(labels: DataFrame, id: str = "id", period: str = "period") -> DataFrame:
    """Adds step (from 1), previous and next label, and flags of a change and of a flicker A B A."""
    w = Window.partitionBy(id).orderBy(period)
    out = labels.withColumn("step", F.row_number().over(w)).withColumn("previous", F.lag("label").over(w)).withColumn("next", F.lead("label").over(w))
    changed = F.coalesce(F.col("label") != F.col("previous"), F.lit(False))
    return out.withColumn("changed", changed).withColumn("flicker", F.coalesce(changed & (F.col("next") == F.col("previous")), F.lit(False)))


def stable_changes(labels: DataFrame, length: int, id: str = "id", period: str = "period") -> DataFrame:
    """Changes with ``stable``: the new label holds for ``length`` periods; null where the panel ends before."""
    ahead = Window.partitionBy(id).orderBy(period).rowsBetween(0, length - 1)
    s = steps(labels, id, period)
    s = s.withColumn("_n", F.count(F.lit(1)).over(ahead)).withColumn("_same", F.min("label").over(ahead) == F.max("label").over(ahead))
    stable = F.when(~F.col("_same"), False).when(F.col("_n") == length, True)
    return s.where("changed").select(id, period, "previous", "label", stable.alias("stable"))


def first_visits(labels: DataFrame, id: str = "id", period: str = "period") -> DataFrame:
    """Changes to a label that the node never had before."""
    nth = F.row_number().over(Window.partitionBy(id, "label").orderBy(period))
    return steps(labels, id, period).withColumn("_nth", nth).where("changed and _nth = 1").select(id, period, "previous", "label")


def mode_label(labels: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent label, ties to the smallest."""
    n = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("_b")).select(*keys, F.col("_b.label").alias("label"), (-F.col("_b.m")).alias("n"))


def window_modes(labels: DataFrame, n: int, id: str = "id", period: str = "period") -> DataFrame:
    """(id, first, last, migrated): modes over the first and last n periods of a node."""
    up, down = Window.partitionBy(id).orderBy(period), Window.partitionBy(id).orderBy(F.desc(period))
    r = labels.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    a = mode_label(r.where(F.col("_u") <= n), [id]).select(id, F.col("label").alias("first"))
    b = mode_label(r.where(F.col("_d") <= n), [id]).select(id, F.col("label").alias("last"))
    return a.join(b, id).withColumn("migrated", F.col("first") != F.col("last"))


def transitions(labels: DataFrame, id: str = "id", period: str = "period") -> DataFrame:
    """(source, target, n, share) over changes."""
    t = steps(labels, id, period).where("changed").groupBy(F.col("previous").alias("source"), F.col("label").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def stability(labels: DataFrame, id: str = "id", period: str = "period") -> DataFrame:
    """Per node: number of changes and its band, share of the main label, number of labels, the trajectory as text."""
    s = steps(labels, id, period)
    g = s.groupBy(id).agg(F.count_if("changed").alias("n_changes"), F.count(F.lit(1)).alias("n_periods"), F.countDistinct("label").alias("n_labels"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(period, "label"))), lambda x: x["label"]), ">").alias("trajectory"))
    main = mode_label(labels, [id]).select(id, F.col("label").alias("main"), F.col("n").alias("n_main"))
    n = F.col("n_changes")
    band = F.when(n == 0, "never").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 9, "4-9").otherwise("10+")
    return g.join(main, id).withColumn("band", band).withColumn("main_share", F.col("n_main") / F.col("n_periods"))


def subtypes(labels: DataFrame, cut: float = 0.8, id: str = "id") -> DataFrame:
    """(id, top1, top2, subtype): one label, two that together hold the cut share, or scattered."""
    n = labels.groupBy(id, "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "label")))
    g = n.groupBy(id).agg(top.alias("t"), F.sum("n").alias("all"))
    two = -(F.col("t")[0]["m"] + F.coalesce(F.get("t", F.lit(1))["m"], F.lit(0))) / F.col("all")
    kind = F.when(F.size("t") == 1, "single").when(two >= cut, "swinging").otherwise("scattered")
    return g.select(id, F.col("t")[0]["label"].alias("top1"), F.get("t", F.lit(1))["label"].alias("top2"), kind.alias("subtype"))


def adjacent_jaccard(labels: DataFrame, id: str = "id", period: str = "period") -> DataFrame:
    """(period, label, jaccard) of a label's members with those it had one period before."""
    n = Window.partitionBy(id).orderBy(period)
    s = labels.withColumn("previous", F.lag("label").over(n)).withColumn("_before", F.lag(period).over(n))
    now = labels.groupBy(period, "label").agg(F.count(F.lit(1)).alias("now"))
    kept = s.where("label = previous").groupBy(period, "label", "_before").agg(F.count(F.lit(1)).alias("kept"))
    was = now.select(F.col(period).alias("_before"), "label", F.col("now").alias("was"))
    return kept.join(now, [period, "label"]).join(was, ["_before", "label"]).select(period, "label", ratio(F.col("kept").cast("double"), F.col("now") + F.col("was") - F.col("kept")).alias("jaccard"))


def best_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row with the least total cost: exact Hungarian method with potentials."""
    n, m = cost.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], np.inf, 0
            free = np.flatnonzero(~used[1:]) + 1
            cur = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = cur < low[free]
            low[free[better]], way[free[better]] = cur[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[p[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            p[j0], j0 = p[j1], j1
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


def match_by_permutation(pairs: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(by, a, b): the one-to-one matching of labels 0..k-1 with the least summed cost, ties to the first permutation.

    ``pairs`` has (by, a, b, cost). All k! permutations are a table of fixed size; k is at most 7.
    """
    if k > 7:
        raise ValueError("enumeration is for at most seven labels; use match_labels")
    by = by or []
    spark = pairs.sparkSession
    perms = spark.createDataFrame([(i, list(p)) for i, p in enumerate(permutations(range(k)))], "perm int, p array<int>")
    perms = perms.select("perm", F.posexplode("p").alias("a", "b"))
    total = pairs.join(F.broadcast(perms), ["a", "b"]).groupBy(*by, "perm").agg(F.round(F.sum("cost"), 9).alias("total"))
    best = total.groupBy(*by).agg(F.min(F.struct("total", "perm")).alias("_b")).select(*by, F.col("_b.perm").alias("perm"))
    return best.join(F.broadcast(perms), "perm").select(*by, "a", "b")


def match_margins(costs: DataFrame, matching: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds to each matched pair its cost, the margin competitor / cost, whether both ends are nearest, and a confidence."""
    by = by or []
    row, col = Window.partitionBy(*by, "a"), Window.partitionBy(*by, "b")
    other = lambda w, key: F.min(F.struct("cost", key)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    second = lambda w: F.array_sort(F.collect_list("cost").over(w))
    c = costs.withColumn("_r", second(row)).withColumn("_c", second(col)).withColumn("_nr", other(row, "b")).withColumn("_nc", other(col, "a"))
    m = c.join(matching, [*by, "a", "b"])
    rest = lambda arr: F.when(F.col(arr)[0] == F.col("cost"), F.get(arr, F.lit(1))).otherwise(F.col(arr)[0])
    margin = ratio(F.least(rest("_r"), rest("_c")), F.col("cost"))
    mutual = (F.col("_nr.cost") == F.col("cost")) & (F.col("_nc.cost") == F.col("cost"))
    level = F.when(~mutual | (margin < 1.2), "ambiguous").when(F.coalesce(margin, F.lit(1e9)) >= 1.5, "sure").otherwise("likely")
    return m.select(*by, "a", "b", "cost", margin.alias("margin"), mutual.alias("mutual"), level.alias("confidence"))


def last_complete(fact: DataFrame, categories: int, id: str = "territory_id", period: str = "period", category: str = "category") -> DataFrame:
    """(id, period): the last period in which a node has all categories."""
    n = fact.groupBy(id, period).agg(F.countDistinct(category).alias("n")).where(F.col("n") == categories)
    return n.groupBy(id).agg(F.max(period).alias(period))


def iqr_outliers(df: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """Adds whether a value is above Q3 + factor x IQR."""
    q = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    return df.join(F.broadcast(q)).withColumn("outlier", F.col(value) > F.col("_q")[1] + factor * (F.col("_q")[1] - F.col("_q")[0])).drop("_q")


def confident_mode(labels: DataFrame, confidence: Column, least: int, id: str = "id") -> DataFrame:
    """Mode over periods that pass, for nodes with at least ``least`` of them."""
    m = labels.where(confidence)
    n = m.groupBy(id).agg(F.count(F.lit(1)).alias("n_passed")).where(F.col("n_passed") >= least)
    return mode_label(m, [id]).join(n, id)
