"""Graph analytics over (nodes, edges) frames: edges have x < y and a weight."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import ratio
from meshwork.operators.pairs import both_ways
from meshwork.session import materialize


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node, isolates too."""
    d = both_ways(edges.select("x", "y")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges).agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.min("degree").alias("min_degree"),
        F.median("degree").alias("median_degree"),
        F.avg("degree").alias("mean_degree"),
        F.max("degree").alias("max_degree"),
        F.stddev_pop("degree").alias("std_degree"),
        F.count_if(F.col("degree") == 0).alias("n_isolated"),
        (F.sum("degree") / 2).cast("long").alias("n_edges"),
    )
    n = F.col("n_nodes")
    return d.withColumn("density", ratio(2.0 * F.col("n_edges"), n * (n - 1)))


def clustering_coefficient(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the mean over nodes of 2 T / (d (d - 1)), 0 below two neighbours.

    Triangles are found from each edge's lower-degree end (ties by id), so that a hub opens no
    quadratic list of its neighbours.
    """
    e, d = edges.select("x", "y"), degrees(nodes, edges)
    rank = lambda c: F.struct(F.col(f"d{c}"), F.col(c))
    e = e.join(d.select(F.col("id").alias("x"), F.col("degree").alias("dx")), "x").join(d.select(F.col("id").alias("y"), F.col("degree").alias("dy")), "y")
    low = rank("x") < rank("y")
    o = e.select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("s"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("t"))
    a, b, c = o.alias("a"), o.alias("b"), o.alias("c")
    fork = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.t") < F.col("b.t"))).select(F.col("a.s").alias("s"), F.col("a.t").alias("p"), F.col("b.t").alias("q"))
    close = c.select(F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"))
    tri = fork.join(close, ["p", "q"]).select(F.explode(F.array("s", "p", "q")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    local = d.join(tri, "id", "left").withColumn("c", F.coalesce(ratio(2.0 * F.coalesce("t", F.lit(0)), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)))
    return local.agg(F.avg("c").alias("clustering"), (F.coalesce(F.sum("t"), F.lit(0)) / 3).cast("long").alias("n_triangles"))


def assortativity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Newman's coefficient of a label over the mixing matrix of both edge directions."""
    m = both_ways(edges.select("x", "y")).join(labels.select(F.col("id").alias("src"), F.col("label").alias("i")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("j")), "dst")
    m = m.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    whole = m.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)).alias("same"))
    a = m.groupBy("i").agg(F.sum("n").alias("a"))
    # the matrix is symmetric, so its row and column sums agree
    squares = a.agg(F.sum(F.col("a").cast("double") * F.col("a")).alias("sq"))
    e = ratio(F.col("same").cast("double"), F.col("all"))
    q = ratio(F.col("sq"), F.col("all").cast("double") * F.col("all"))
    return whole.join(F.broadcast(squares)).select(ratio(e - q, 1 - q).alias("assortativity"), e.alias("within_share"))


def cluster_edges(edges: DataFrame, labels: DataFrame, weight: str = "score") -> DataFrame:
    """(k, l, w, n) with k <= l: weight and number of edges within and between clusters."""
    lab = lambda c, n: labels.select(F.col("id").alias(c), F.col("label").alias(n))
    m = edges.join(lab("x", "i"), "x").join(lab("y", "j"), "y")
    return m.groupBy(F.least("i", "j").alias("k"), F.greatest("i", "j").alias("l")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))


def cluster_sums(matrix: DataFrame) -> DataFrame:
    """(k, inner, outer) of each cluster from its edge matrix."""
    ends = matrix.select(F.col("k").alias("c"), "w", (F.col("k") == F.col("l")).alias("own")).unionByName(matrix.where("k <> l").select(F.col("l").alias("c"), "w", F.lit(False).alias("own")))
    return ends.groupBy(F.col("c").alias("k")).agg(F.coalesce(F.sum(F.when(F.col("own"), F.col("w"))), F.lit(0.0)).alias("inner"), F.coalesce(F.sum(F.when(~F.col("own"), F.col("w"))), F.lit(0.0)).alias("outer"))


def isolability(matrix: DataFrame) -> DataFrame:
    """(k, isolability) = 2 E / (2 E + B)."""
    return cluster_sums(matrix).select("k", ratio(2 * F.col("inner"), 2 * F.col("inner") + F.col("outer")).alias("isolability"))


def unifiability(matrix: DataFrame) -> DataFrame:
    """(k, l, unifiability) = E_kl / (B_k + B_l - E_kl), 0 where that is not positive."""
    s = cluster_sums(matrix)
    m = matrix.where("k <> l").join(s.select("k", F.col("outer").alias("bk")), "k").join(s.select(F.col("k").alias("l"), F.col("outer").alias("bl")), "l")
    base = F.col("bk") + F.col("bl") - F.col("w")
    return m.select("k", "l", F.when(base > 0, F.col("w") / base).otherwise(0.0).alias("unifiability"))


def partition_quality(matrix: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: modularity, mean isolability (avi) and summed unifiability over the number of clusters (avu)."""
    s = cluster_sums(matrix)
    m = s.agg(F.sum(F.col("inner") + F.col("outer") / 2).alias("m"), F.count(F.lit(1)).alias("n_clusters"))
    part = F.col("inner") / F.col("m") - gamma * F.pow((2 * F.col("inner") + F.col("outer")) / (2 * F.col("m")), 2)
    q = s.join(F.broadcast(m)).agg(F.sum(part).alias("modularity"), F.max("n_clusters").alias("n_clusters"))
    i = isolability(matrix).agg(F.avg("isolability").alias("avi"))
    u = unifiability(matrix).agg(F.coalesce(F.sum(2 * F.col("unifiability")), F.lit(0.0)).alias("u"))
    return q.join(F.broadcast(i)).join(F.broadcast(u)).select("modularity", "avi", (F.col("u") / F.col("n_clusters")).alias("avu"), "n_clusters")


def edges_within(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: number and share of edges whose ends have one label."""
    lab = lambda c, n: labels.select(F.col("id").alias(c), F.col("label").alias(n))
    m = edges.join(lab("x", "i"), "x").join(lab("y", "j"), "y")
    return m.agg(F.count_if(F.col("i") == F.col("j")).alias("n_within"), F.count(F.lit(1)).alias("n_edges"), F.avg((F.col("i") == F.col("j")).cast("double")).alias("share_within"))


def centrality(edges: DataFrame, weight: str = "score") -> DataFrame:
    """(id, centrality): mean weight of a node's edges."""
    return both_ways(edges.select("x", "y", weight)).groupBy(F.col("src").alias("id")).agg(F.avg(weight).alias("centrality"), F.count(F.lit(1)).alias("degree"))


def jaccard(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: sizes and Jaccard index of two key sets."""
    x, y = a.select(*on).distinct(), b.select(*on).distinct()
    n = x.agg(F.count(F.lit(1)).alias("n_a")).join(y.agg(F.count(F.lit(1)).alias("n_b"))).join(x.join(y, on, "left_semi").agg(F.count(F.lit(1)).alias("n_both")))
    return n.withColumn("jaccard", ratio(F.col("n_both").cast("double"), F.col("n_a") + F.col("n_b") - F.col("n_both")))


def digest(lines: DataFrame, separator: str) -> DataFrame:
    """One row (sha256, n): the digest of all lines (k, line), each k once, in the order of k and joined by the separator.

    SHA-256 takes bytes one after the other, so one task reads all lines; ranges of k are sorted and joined into pieces before, of which it holds a batch.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                text = separator.join(b.column(1).to_pylist()).encode()
                yield pa.RecordBatch.from_arrays([b.column(0)[:1], pa.array([text], pa.binary()), pa.array([b.num_rows])], ["first", "text", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = hashlib.sha256(), 0
        for b in batches:
            for text, many in zip(b.column(1), b.column(2)):
                h.update((separator.encode() if n else b"") + text.as_py())
                n += many.as_py()
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()]), pa.array([n])], ["sha256", "n"])

    part = lines.select("k", "line").repartitionByRange("k").sortWithinPartitions("k").mapInArrow(pieces, "first string, text binary, n long")
    found = part.repartition(1).sortWithinPartitions("first").mapInArrow(hashed, "sha256 string, n long")
    none = F.lit(hashlib.sha256().hexdigest())
    return found.agg(F.coalesce(F.max("sha256"), none).alias("sha256"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def louvain(n: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = 0, gamma: float = 1.0) -> np.ndarray:
    """Community of each of n nodes: local moves to the best neighbour community, then aggregation, until no gain."""
    rng = np.random.default_rng(seed)
    member = np.arange(n)
    total = w.sum()
    if total <= 0:
        return member
    while True:
        size = int(member.max()) + 1
        near: list[dict[int, float]] = [{} for _ in range(size)]
        loops = np.zeros(size)
        a, b = member[x], member[y]
        for i, j, v in zip(a.tolist(), b.tolist(), w.tolist()):
            if i == j:
                loops[i] += v
            else:
                near[i][j] = near[i].get(j, 0.0) + v
                near[j][i] = near[j].get(i, 0.0) + v
        degree = np.array([sum(d.values()) for d in near]) + 2 * loops
        com, mass, moved, gained = list(range(size)), degree.copy(), True, False
        while moved:
            moved = False
            for i in rng.permutation(size).tolist():
                own, to = com[i], {}
                for j, v in near[i].items():
                    to[com[j]] = to.get(com[j], 0.0) + v
                mass[own] -= degree[i]
                best, gain = own, to.get(own, 0.0) - gamma * degree[i] * mass[own] / (2 * total)
                for c in sorted(to):
                    g = to[c] - gamma * degree[i] * mass[c] / (2 * total)
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += degree[i]
                if best != own:
                    com[i], moved, gained = best, True, True
        if not gained:
            return member
        member = np.unique(np.array(com), return_inverse=True)[1][member]


def by_size(member: np.ndarray) -> np.ndarray:
    """Labels renumbered by size, largest first, ties by the smallest position."""
    _, first, inverse, count = np.unique(member, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((first, -count))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[inverse]


def louvain_runs(edges: DataFrame, runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, seed, gamma, id, label) for each graph and each run (seed, gamma).

    One graph's edges fit a task (tens of thousands); the fan-out over runs and
    graphs is what is distributed.
    """
    by = by or []
    fan = edges.select(*by, "x", "y", "score").join(F.broadcast(runs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf.x, pdf.y]))
        pdf = pdf.sort_values(["x", "y"], kind="stable")
        member = louvain(len(ids), np.searchsorted(ids, pdf.x), np.searchsorted(ids, pdf.y), pdf.score.to_numpy(), int(pdf.seed.iloc[0]), float(pdf.gamma.iloc[0]))
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "seed": pdf.seed.iloc[0], "gamma": pdf.gamma.iloc[0], "id": ids, "label": by_size(member)})

    kinds = dict(edges.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "seed long", "gamma double", "id long", "label long"])
    return fan.groupBy(*by, "seed", "gamma").applyInPandas(run, schema)


def cooccurrence(labels: DataFrame, runs: int) -> DataFrame:
    """(x, y, share): in what share of runs two nodes have one label."""
    a, b = labels.alias("a"), labels.alias("b")
    met = a.join(b, (F.col("a.seed") == F.col("b.seed")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.id") < F.col("b.id")))
    return met.groupBy(F.col("a.id").alias("x"), F.col("b.id").alias("y")).agg((F.count(F.lit(1)) / runs).alias("share"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document's body, as one column ``value`` for a text sink; ``graphml_ends`` has the rest."""
    node = nodes.select(F.format_string('<node id="n%d"/>', "id").alias("value"))
    edge = edges.select(F.format_string('<edge source="n%d" target="n%d"><data key="w">%.9f</data></edge>', "x", "y", "score").alias("value"))
    return node.unionByName(edge)


def graphml_ends() -> tuple[str, str]:
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
    return head, "</graph></graphml>"


def core_members(share: DataFrame, labels: DataFrame, core: float = 0.8) -> DataFrame:
    """(id, label, mean_in, max_out, is_core) from co-occurrence shares and a reference partition."""
    lab = lambda c, n: labels.select(F.col("id").alias(c), F.col("label").alias(n))
    s = both_ways(share).join(lab("src", "i"), "src").join(lab("dst", "j"), "dst")
    size = Window.partitionBy("label")
    base = labels.select("id", "label", F.count(F.lit(1)).over(size).alias("n"))
    g = s.groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("share"))).alias("in_sum"), F.max(F.when(F.col("i") != F.col("j"), F.col("share"))).alias("max_out"))
    out = base.join(g, "id", "left").withColumn("mean_in", ratio(F.coalesce("in_sum", F.lit(0.0)), F.col("n") - 1))
    return out.select("id", "label", "mean_in", F.coalesce("max_out", F.lit(0.0)).alias("max_out"), (F.coalesce("mean_in", F.lit(1.0)) >= core).alias("is_core"))




def label_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges within a label, their expected number and deviation when the labels are permuted over the nodes, and z.

    The moments are exact (join counts without replacement): two edges are the same, share a node, or are disjoint, and how many
    pairs are of which kind follows from the degrees. ``nodes`` is (id, label), edges are distinct pairs x < y.
    """
    c = nodes.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("c"))
    falling = lambda x, k: reduce(mul, [x - i for i in range(k)])
    counts = c.agg(F.sum("c").alias("n"), *[F.sum(falling(F.col("c"), k)).alias(f"f{k}") for k in (2, 3, 4)], F.sum(F.pow(falling(F.col("c"), 2), 2)).alias("square"))
    shared = degrees(nodes, edges).agg(F.sum(F.col("degree") * (F.col("degree") - 1)).cast("double").alias("shared"))
    within = edges_within(edges, nodes).select(F.col("n_within").cast("double").alias("n_within"), F.col("n_edges").cast("double").alias("m"))
    r = within.join(F.broadcast(counts)).join(F.broadcast(shared))
    n, m = F.col("n"), F.col("m")
    p2, p3 = F.col("f2") / falling(n, 2), F.col("f3") / falling(n, 3)
    p4 = (F.col("f4") + F.col("f2") * F.col("f2") - F.col("square")) / falling(n, 4)
    second = m * p2 + F.col("shared") * p3 + (m * m - m - F.col("shared")) * p4
    out = r.select(F.col("n_within").cast("long").alias("n_within"), (m * p2).alias("expected"), F.sqrt(F.greatest(F.lit(0.0), second - m * p2 * m * p2)).alias("deviation"))
    return out.withColumn("z", ratio(F.col("n_within") - F.col("expected"), F.col("deviation")))


def core_of_runs(found: DataFrame, runs: int, core: float = 0.8) -> DataFrame:
    """(id, label, mean_in, max_out, is_core): ``core_members`` of the co-occurrence of runs (seed, id, label) with the run of seed 0 as the reference, without a row for any pair.

    What a node shares with its own community are counts by (run, label, reference label). What it shares with the nearest
    stranger is the greatest number of runs whose labels it has in common with a node of another reference label: for each set of runs, nodes
    meet by their labels in it, and a meeting of two reference labels counts. Sets are 2 ** (runs - 1) for each distinct row of labels, so runs are few.
    """
    rows = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seed", "label"))).alias("s"))
    rows = materialize(rows.select("id", F.transform("s", lambda r: r["label"]).alias("all")).select("id", F.get("all", F.lit(0)).alias("label"), F.slice("all", 2, runs - 1).alias("rest")))
    each = rows.select("id", F.col("label").alias("own"), F.posexplode(F.concat(F.array("label"), "rest")).alias("run", "l"))
    together = each.groupBy("own", "run", "l").agg((F.count(F.lit(1)) - 1).alias("n"))
    inside = each.join(together, ["own", "run", "l"]).groupBy("id").agg((F.sum("n") / runs).alias("in_sum"))
    distinct = materialize(rows.groupBy("rest").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    sets = [[i for i in range(runs - 1) if m >> i & 1] for m in range(1, 2 ** (runs - 1))]
    key = F.array(*[F.struct(F.lit(at).alias("set"), F.lit(len(of)).alias("size"), F.array(*[F.get("rest", F.lit(i)) for i in of]).alias("key")) for at, of in enumerate(sets)]) if sets else F.array().cast("array<struct<set:int,size:int,key:array<long>>>")
    met = distinct.select("rest", "lo", "hi", F.explode(key).alias("e")).select("rest", "lo", "hi", "e.*")
    mixed = met.groupBy("set", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("set", "key")
    outside = met.join(mixed, ["set", "key"]).groupBy("rest").agg((F.max("size") / runs).alias("max_out"))
    size = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    out = rows.join(inside, "id").join(size, "label").join(outside, "rest", "left").withColumn("mean_in", ratio(F.col("in_sum"), F.col("n") - 1))
    return out.select("id", "label", "mean_in", F.coalesce("max_out", F.lit(0.0)).alias("max_out"), (F.coalesce("mean_in", F.lit(1.0)) >= core).alias("is_core"))
