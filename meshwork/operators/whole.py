"""Ward's agglomeration, spectral clustering and k-means of one table that is too large for a task, by blocks.

Nodes lie in packed blocks, one row of bytes each, that meet by a cross join of one block on the left and up to ``packed.GROUP`` on the right. What
goes to the driver are counts and matrices of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators import cluster, components, packed
from meshwork.session import materialize, release

#: Nodes up to which one task does the work, and rows of a product.
LOCAL = 4_096
ROWS = 256
#: Vectors up to which k-means has a run in one task: by blocks a round is a job, which takes longer on small tables.
FITTED = 1 << 17
#: Residual at which eigenvectors count as found, that down to which products are in single precision, and passes at most.
TOLERANCE, SINGLE, PASSES = 1e-8, 1e-5, 300


def blocks_for(n: int) -> int:
    return max(min(24, -(-n // 512)), -(-n // packed.SIZE), 1)


def pack(nodes: DataFrame, blocks: int) -> DataFrame:
    """(b, ids, x, n): ids, vectors and sizes of the nodes (id, x, n) of each block as bytes, by ascending id."""

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := [b for b in batches if b.num_rows]):
            return
        t = pa.Table.from_batches(batches)
        t = t.take(np.argsort(t.column("id").to_numpy(), kind="stable")).combine_chunks()
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("x").chunks]).astype(float)
        row = [t.column("id").to_numpy().astype(np.int64).tobytes(), x.tobytes(), t.column("n").to_numpy().astype(float).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *[pa.array([v], pa.binary()) for v in row]], ["b", "ids", "x", "n"])

    dealt = nodes.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("n").cast("double").alias("n")).repartition(blocks, "id")
    return materialize(dealt.mapInArrow(bytes_of, "b long, ids binary, x binary, n binary"))


def crossed(left: DataFrame, right: DataFrame, blocks: int, others: int) -> DataFrame:
    """Each of the blocks of the left, as l_<column>, with each of the others of the right."""
    groups = -(-others // packed.GROUP)
    at = lambda df, n: df.repartitionById(n, F.pmod("b", F.lit(n)).cast("int"))
    return at(left, blocks).select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).hint("shuffle_replicate_nl").join(at(right, groups))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, int | np.ndarray]]:
    """Rows of blocks: numbers, and bytes as arrays."""
    for batch in batches:
        for r in range(batch.num_rows):
            of = zip(batch.schema.names, (batch.column(i)[r] for i in range(batch.num_columns)))
            yield {c: np.frombuffer(v.as_buffer(), np.int64 if c.endswith("ids") else float) if pa.types.is_binary(v.type) else v.as_py() for c, v in of}


def pair_key(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A number of a pair of ids that does not depend on their order and orders equal costs, so that among many of them many pairs choose each other."""
    lo, hi = np.minimum(i, j).astype(np.uint64), np.maximum(i, j).astype(np.uint64)
    h = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


class Cheapest:
    """For each cluster of a block the one of all others that is cheapest to merge with by Ward's cost, ties by ``pair_key``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n: np.ndarray):
        self.ids, self.x, self.n = ids, x.reshape(len(ids), -1), n
        self.square = np.square(self.x).sum(axis=1)
        self.cost, self.key, self.to = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1, np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray, n: np.ndarray) -> None:
        x = x.reshape(len(ids), -1)
        square = np.square(x).sum(axis=1)
        for at in range(0, len(self.ids), ROWS):
            rows = slice(at, min(len(self.ids), at + ROWS))
            s = self.x[rows] @ x.T
            s *= -2
            s += self.square[rows, None]
            s += square
            weight = self.n[rows, None] * n / (self.n[rows, None] + n)
            s *= weight
            own = np.searchsorted(ids, self.ids[rows])
            there = np.flatnonzero((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == self.ids[rows]))
            s[there, own[there]] = np.inf
            # products say which can be cheapest; costs that are compared come from differences, the same from either side
            slack = 1e-13 * self.x.shape[1] * (self.square[rows].max() + square.max()) * np.minimum(self.n[rows], n.max())
            i, j = np.nonzero(s <= (np.minimum(s.min(axis=1), self.cost[rows]) + 2 * slack)[:, None])
            i, j = i[np.isfinite(s[i, j])], j[np.isfinite(s[i, j])]
            for part in range(0, len(i), 1 << 15):
                self.take(i[part : part + (1 << 15)] + at, j[part : part + (1 << 15)], ids, x, n)

    def take(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, x: np.ndarray, n: np.ndarray) -> None:
        cost = np.square(self.x[i] - x[j]).sum(axis=1) * (self.n[i] * n[j] / (self.n[i] + n[j]))
        key = pair_key(self.ids[i], ids[j])
        order = np.lexsort((key, cost, i))
        order = order[np.append(True, i[order][1:] != i[order][:-1])] if len(order) else order
        i, j, cost, key = i[order], j[order], cost[order], key[order]
        better = (cost < self.cost[i]) | ((cost == self.cost[i]) & (key < self.key[i]))
        i, j = i[better], j[better]
        self.cost[i], self.key[i], self.to[i] = cost[better], key[better], ids[j]


def cheapest(asked: DataFrame, nodes: DataFrame, count: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, to, cost) of the asked clusters (id, x, n): of all ``nodes`` the other one that is cheapest to merge with. Also what was written for it."""
    few, blocks = blocks_for(asked.count()), blocks_for(count)
    left, right = pack(asked, few), pack(nodes, blocks)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        result = lambda: pa.RecordBatch.from_arrays([pa.array(v) for v in (own.ids, own.to, own.cost, own.key)], ["id", "to", "cost", "key"])
        for r in rows_of(batches):
            if at != r["l_b"]:
                if own:
                    yield result()
                at, own = r["l_b"], Cheapest(r["l_ids"], r["l_x"], r["l_n"])
            own.meet(r["ids"], r["x"], r["n"])
        if own:
            yield result()

    part = crossed(left, right, few, blocks).mapInArrow(best, "id long, to long, cost double, key long").where("to >= 0")
    return part.groupBy("id").agg(F.min(F.struct("cost", "key", "to")).alias("m")).select("id", F.col("m.to").alias("to"), F.col("m.cost").alias("cost")), [left, right]


def ward(nodes: DataFrame, k: int, local: int = LOCAL) -> DataFrame:
    """(id, label): Ward's agglomeration of the nodes (id, x) cut at k clusters, numbered by their smallest id.

    Equal vectors are one cluster from the start. A round merges all pairs of clusters that are each other's cheapest, which gives the same tree as one merge after the
    other, since a merge never makes a third cluster cheaper for either (reducibility); equal costs may be taken in another order. The last ``local`` clusters are merged by a chain in one task.
    """
    base = materialize(nodes.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")))
    plus = base.select("id", F.transform("x", lambda v: v + F.lit(0.0)).alias("x"))
    alive = materialize(plus.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n")).select("id", "x", "n"))
    same = plus.join(alive.select("x", F.col("id").alias("a")), "x").where("id <> a").select(F.col("a"), F.col("id").alias("b"), F.lit(0.0).alias("height"))
    merges, count = [materialize(same)], alive.count()
    near, known = None, None
    while count > local:
        # whose cheapest is as it was keeps it, since a new cluster is no cheaper than its parts were; the others look again
        asked = materialize(alive if known is None else alive.join(known, "id", "left_anti"))
        found, written = cheapest(asked, alive, count)
        before, near = near, materialize(found if known is None else known.unionByName(found))
        release(asked, *written, *([before] if before is not None else []))
        pair = materialize(near.join(near.select(F.col("id").alias("to"), F.col("to").alias("id")), ["id", "to"]).where("id < to").select(F.col("id").alias("a"), F.col("to").alias("b"), F.col("cost").alias("height")))
        if pair.isEmpty():
            if known is None:
                raise ValueError("no two clusters are each other's cheapest; vectors must be finite")
            known = None  # equal costs kept from different rounds
            continue
        one = alive.select(F.col("id").alias("a"), F.col("x").alias("u"), F.col("n").alias("m"))
        two = alive.select(F.col("id").alias("b"), F.col("x").alias("v"), F.col("n").alias("o"))
        met = pair.join(one, "a").join(two, "b").select(F.col("a").alias("id"), F.zip_with("u", "v", lambda p, q: (p * F.col("m") + q * F.col("o")) / (F.col("m") + F.col("o"))).alias("x"), (F.col("m") + F.col("o")).alias("n"))
        gone = pair.select(F.explode(F.array("a", "b")).alias("id"))
        known = near.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("to")), "to", "left_anti").select("id", "to", "cost")
        old, alive = alive, materialize(alive.join(gone, "id", "left_anti").unionByName(met))
        release(old)
        merges.append(pair)
        count = alive.count()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        t = t.take(np.argsort(t.column("id").to_numpy(), kind="stable")).combine_chunks()
        ids = t.column("id").to_numpy()
        x = np.array(t.column("x").to_pylist(), float).reshape(len(ids), -1)
        found = cluster.ward_merges(x, t.column("n").to_numpy().astype(float))
        a, b = (np.array([m[c] for m in found], np.int64) for c in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(np.array([m[0] for m in found], float))], ["a", "b", "height"])

    merges.append(materialize(alive.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: pa.Table.from_batches(list(last(t.to_batches()))), "a long, b long, height double")))
    every = merges[0]
    for m in merges[1:]:
        every = every.unionByName(m)
    # the k - 1 highest merges are undone
    top = every.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(k - 1).select("a", "b")
    found = components.connected_components(materialize(every.join(F.broadcast(top), ["a", "b"], "left_anti").select("a", "b")), "a", "b")
    root = base.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("root"))
    return numbered(materialize(root))


def numbered(root: DataFrame) -> DataFrame:
    """(id, label) from (id, root) of a few roots, numbered in their order."""
    order = root.groupBy().agg(F.sort_array(F.collect_set("root")).alias("order"))
    return root.join(F.broadcast(order)).select("id", (F.array_position("order", F.col("root")) - 1).cast("long").alias("label"))


def spectral(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, label): k-means of the k leading eigenvectors of the normalised similarities max(cosine, 0) of the nodes (id, x).

    The matrix is never formed: a pass multiplies it, tile by tile, with a block of some more vectors than there are dimensions; the driver solves the small problem in their span.
    Passes go on until the residual of the k leading vectors is below ``TOLERANCE``. The k-means of n times k numbers is in one task.
    """
    count = nodes.count()
    blocks = blocks_for(count)
    p = pack(nodes.select("id", "x", F.lit(1.0).alias("n")), blocks)
    dims = nodes.select(F.max(F.size("x"))).first()[0]
    wide = min(count, max(2 * k, dims) + 16)

    def multiplied(y: DataFrame, kind: type) -> DataFrame:
        """(b, z) from (b, y): similarities times y."""

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, z, a = None, None, None
            result = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([z.tobytes()], pa.binary())], ["b", "z"])
            for r in rows_of(batches):
                if at != r["l_b"]:
                    if z is not None:
                        yield result()
                    at, a, z = r["l_b"], unit(r["l_ids"], r["l_x"]).astype(kind), None
                y, b = r["y"].reshape(len(r["ids"]), -1).astype(kind), unit(r["ids"], r["x"]).astype(kind)
                z = np.zeros((len(a), y.shape[1])) if z is None else z
                for of in range(0, len(a), ROWS):
                    s = a[of : of + ROWS] @ b.T
                    np.maximum(s, 0, out=s)
                    if r["b"] == at:
                        own = np.arange(len(s))
                        s[own, of + own] = 0
                    z[of : of + ROWS] += s @ y
            if z is not None:
                yield result()

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, z = None, None
            for r in rows_of(batches):
                at, z = r["b"], r["z"] + (0 if z is None else z)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([z.tobytes()], pa.binary())], ["b", "z"])

        part = crossed(p.select("b", "ids", "x"), p.select("b", "ids", "x").join(y, "b"), blocks, blocks).mapInArrow(product, "b long, z binary")
        return part.groupBy("b").applyInArrow(added, "b long, z binary")

    ones = mapped(p, lambda r: {"y": np.ones(len(r["ids"]))}, "b long, y binary")
    degree = multiplied(ones, float)
    root = materialize(mapped(degree, lambda r: {"r": np.divide(1.0, np.sqrt(r["z"]), out=np.zeros_like(r["z"]), where=r["z"] > 0)}, "b long, r binary"))
    q = materialize(mapped(p, lambda r: {"q": np.random.default_rng([seed, r["b"]]).normal(size=(len(r["ids"]), wide))}, "b long, q binary"))
    residual = np.inf
    for _ in range(PASSES):
        y = mapped(q.select("b", "q").join(root, "b"), lambda r: {"y": r["q"].reshape(len(r["r"]), -1) * r["r"][:, None]}, "b long, y binary")
        z = multiplied(y, np.float32 if residual > SINGLE else float).join(q.select("b", "q"), "b").join(root, "b")
        step = materialize(mapped(z, lambda r: {"q": r["q"], "z": r["z"].reshape(len(r["r"]), -1) * r["r"][:, None]}, "b long, q binary, z binary"))
        turn, value = ritz(*small(step, wide))
        lead = value[:k]

        def turned(r: dict, turn=turn, value=value, lead=lead) -> dict:
            z, q = (r[c].reshape(-1, wide) @ turn for c in ("z", "q"))
            off = np.square(z[:, :k] - q[:, :k] * lead).sum()
            return {"q": z / np.where(np.abs(value) > 1e-12, value, 1.0), "off": float(off)}

        done, q = q, materialize(mapped(step, turned, "b long, q binary, off double"))
        release(done, step)
        residual = float(np.sqrt(q.agg(F.sum("off")).first()[0]))
        if residual <= TOLERANCE:
            break
    else:
        raise ValueError(f"eigenvectors were not found within {PASSES} passes")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            y = (r["q"].reshape(-1, wide)[:, :k] * r["r"][:, None])[:, ::-1]
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"]), pa.array(list(y), pa.list_(pa.float64()))], ["id", "x"])

    low = materialize(p.select("b", "ids").join(q.select("b", "q"), "b").join(root, "b").mapInArrow(rows, "id long, x array<double>"))
    runs = nodes.sparkSession.createDataFrame([(seed, k)], "seed long, k int")
    return cluster.fits(low, runs).select("id", "label")


def unit(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x.reshape(len(ids), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def mapped(df: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """Rows of blocks turned by ``f``; a row keeps its b."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            out = {"b": r["b"]} | f(r)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v := out[c], np.ndarray) else v]) for c in names], names)

    return df.mapInArrow(each, schema)


def small(step: DataFrame, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of q with q and with z over all blocks, summed in a few tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros((wide, wide)), np.zeros((wide, wide))
        for r in rows_of(batches):
            q, z = r["q"].reshape(-1, wide), r["z"].reshape(-1, wide)
            g += q.T @ q
            h += q.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([h.tobytes()])], ["g", "h"])

    parts = step.coalesce(8).mapInArrow(add, "g binary, h binary").collect()  # eight rows at most, of the width of the span
    return tuple(sum(np.frombuffer(r[c], float) for r in parts).reshape(wide, wide) for c in ("g", "h"))


def ritz(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the Ritz vectors in the span of q, and their values, greatest first; directions that the span lacks have value zero."""
    size, axes = np.linalg.eigh(g)
    there = size > 1e-13 * size.max()
    base = axes[:, there] / np.sqrt(size[there])
    value, v = np.linalg.eigh(base.T @ ((h + h.T) / 2) @ base)
    turn, values = np.zeros_like(g), np.zeros(len(g))
    order = np.argsort(-value)
    turn[:, : len(order)], values[: len(order)] = base @ v[:, order], value[order]
    return turn, values


def gathered(stored: DataFrame, work: Callable[[int, np.ndarray], Iterator[tuple[int, np.ndarray, float, np.ndarray]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(total, row) by run of what ``work`` says of each packed block as (run, numbers to add, score, row): the sums, and the row of the highest score. A row for each run goes to the driver."""

    def merge(rows: Iterator[tuple[int, np.ndarray, float, np.ndarray]]) -> pa.RecordBatch:
        held: dict[int, list] = {}
        for run, add, score, row in rows:
            if run not in held:
                held[run] = [np.array(add, float), score, row]
                continue
            held[run][0] += add
            if score > held[run][1]:
                held[run][1:] = score, row
        columns = [list(held), *([v[i] for v in held.values()] for i in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64())))], ["run", "total", "score", "row"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield merge(row for b, x in vectors_of(batches) for row in work(b, x))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda column, r: column[r].values.to_numpy()
        yield merge((b.column(0)[r].as_py(), numbers(b.column(1), r), b.column(2)[r].as_py(), numbers(b.column(3), r)) for b in batches for r in range(b.num_rows))

    schema = "run int, total array<double>, score double, row array<double>"
    found = stored.select("b", "ids", "x", "wide").mapInArrow(part, schema).repartition(8, "run").mapInArrow(both, schema)
    return {r["run"]: (np.array(r["total"]), np.array(r["row"])) for r in found.collect()}


def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.column(0)[r].as_py(), packed.unpack(*(batch.column(i)[r] for i in (1, 2, 3)))[1]


class Box(NamedTuple):
    """The box around all vectors along their principal axes."""

    middle: np.ndarray
    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def draw(self, ref: int, b: int, shape: tuple[int, int]) -> np.ndarray:
        """A block's part of a reference, the same in each pass."""
        return np.random.default_rng([ref, b]).uniform(self.low, self.high, shape) @ self.axes + self.middle


def box_of(stored: DataFrame) -> Box:
    none = np.zeros(0)
    total = gathered(stored, lambda b, x: iter([(0, np.append(x.sum(axis=0), len(x)), 0.0, none)]))[0][0]
    m, p = total[:-1] / total[-1], len(total) - 1
    around = gathered(stored, lambda b, x: iter([(0, ((x - m).T @ (x - m)).ravel(), 0.0, none)]))[0][0]
    axes = np.linalg.eigh(around.reshape(p, p))[1].T[::-1]

    def ends(b: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, float, np.ndarray]]:
        v = (x - m) @ axes.T
        for i in range(p):
            for run, side in ((i, v[:, i]), (p + i, -v[:, i])):
                yield run, none, float(side.max()), side.max(keepdims=True)

    most = gathered(stored, ends)
    return Box(m, axes, np.array([-most[p + i][1][0] for i in range(p)]), np.array([most[i][1][0] for i in range(p)]))


def nearest_centre(x: np.ndarray, c: np.ndarray, measured: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The nearest centre of each row, by products around the centres' mean, and, if ``measured``, its squared distance, by differences."""
    b = c - c.mean(axis=0)
    lab = (np.square(b).sum(axis=1) / 2 - (x - c.mean(axis=0)) @ b.T).argmin(axis=1)
    return lab, np.square(x - c[lab]).sum(axis=1) if measured else None


def kmeans(stored: DataFrame, runs: list[tuple[int, int, int]], inits: int, rounds: int = 100, box: Box | None = None) -> list[tuple[np.ndarray, float]]:
    """(centres, inertia) of the best of some k-means++ starts for each run (k, seed, ref), ref -1 for the vectors and else a reference in ``box``.

    All starts of all runs take one pass over the packed blocks for each further centre and each round. A centre is drawn by the greatest of log squared distance plus Gumbel noise, which is
    proportional to the squared distance; a label without members goes to the row that is farthest from its centre.
    """
    starts = [(*run, init) for run in runs for init in range(inits)]
    centres: dict[int, np.ndarray] = {}

    def over(active: list[int], one: Callable[[int, int, np.ndarray], tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        def work(b: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, float, np.ndarray]]:
            for ref in sorted({starts[i][2] for i in active}):
                v = x if ref < 0 else box.draw(ref, b, x.shape)
                for i in active:
                    if starts[i][2] == ref:
                        yield (i, *one(i, b, v))

        return gathered(stored, work)

    def drawn(i: int, b: int, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        k, seed, _, init = starts[i]
        at = len(centres[i]) if i in centres else 0
        noise = np.random.default_rng([seed, init, at, b]).gumbel(size=len(x))
        if at:
            with np.errstate(divide="ignore"):
                noise += np.log(nearest_centre(x, centres[i])[1])
        best = int(noise.argmax())
        return np.zeros(0), float(noise[best]), x[best]

    def moved(i: int, b: int, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        lab = nearest_centre(x, centres[i], False)[0]
        one = np.eye(starts[i][0])[lab]
        n, far, at = one.sum(axis=0), -np.inf, 0
        if not n.all():  # a label that has no members has none in any block, so that all look for the farthest row
            d = np.square(x - centres[i][lab]).sum(axis=1)
            far, at = float(d.max()), int(d.argmax())
        return np.append((one.T @ x).ravel(), n), far, x[at]

    for at in range(max(k for k, *_ in starts)):
        found = over([i for i, run in enumerate(starts) if run[0] > at], drawn)
        centres = {i: np.vstack([centres[i], found[i][1]]) if i in centres else found[i][1][None] for i in range(len(starts)) if i in found} | {i: c for i, c in centres.items() if i not in found}
    active = list(range(len(starts)))
    for _ in range(rounds):
        found, still = over(active, moved), []
        for i in active:
            k, (total, far) = starts[i][0], found[i]
            n, s = total[-k:], total[:-k].reshape(k, -1)
            new = np.array([s[j] / n[j] if n[j] else far for j in range(k)])
            if np.abs(new - centres[i]).max() >= 1e-9:
                still.append(i)
                centres[i] = new
        active = still
        if not active:
            break
    measured = over(list(range(len(starts))), lambda i, b, x: (np.array([nearest_centre(x, centres[i])[1].sum()]), 0.0, np.zeros(0)))
    score = {i: round(float(measured[i][0][0]), 6) for i in measured}
    best = [min(range(r * inits, (r + 1) * inits), key=lambda i: (score[i], i)) for r in range(len(runs))]
    return [(centres[i], score[i]) for i in best]


def kmeans_runs(nodes: DataFrame, seeds: int, k: int, inits: int = 4) -> DataFrame:
    """(seed, k, id, label, score): ``cluster.fits`` for one table and some seeds, by blocks."""
    stored = packed.pack(nodes, blocks_for(nodes.count()))
    found = kmeans(stored, [(k, seed, -1) for seed in range(seeds)], inits)

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, x = packed.unpack(*(batch.column(i)[r] for i in (1, 2, 3)))
                for seed, (c, score) in enumerate(found):
                    columns = np.full(len(ids), seed), np.full(len(ids), k), ids, nearest_centre(x, c)[0].astype(np.int64), np.full(len(ids), score)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["seed", "k", "id", "label", "score"])

    return stored.select("b", "ids", "x", "wide").mapInArrow(labels, "seed long, k long, id long, label long, score double")


def gap_curve(nodes: DataFrame, ks: list[int], refs: int, inits: int = 2) -> DataFrame:
    """``cluster.gap_curve`` by blocks."""
    stored = packed.pack(nodes, blocks_for(nodes.count()))
    runs = [(k, 0, ref) for k in ks for ref in range(-1, refs)]
    found = kmeans(stored, runs, inits, box=box_of(stored))
    w = [(k, ref, float(np.log(max(inertia, 1e-12)))) for (k, _, ref), (_, inertia) in zip(runs, found)]
    return cluster.gaps(nodes.sparkSession.createDataFrame(w, "k int, ref int, w double"), refs)
