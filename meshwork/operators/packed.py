"""Nearest neighbours of vectors that lie in packed blocks, each block against all others.

A block of vectors is one row of bytes, written once. Blocks meet by a cross join whose tasks have one block on the left and up to
``GROUP`` on the right, so that a node is moved three times however many blocks there are, and what a task returns is the k best of
its own block over all it met. Products in single precision only say which pairs can be among the k best; those are scored in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.session import materialize

#: Vectors of a block as a rule, blocks on the right of a task, rows and columns of a product, and candidates that are ranked at once.
SIZE = 8_192
GROUP = 16
ROWS, COLUMNS = 256, 2048
MOST = 1 << 16
UNIT = 2.0**-24


def pack(nodes: DataFrame, blocks: int, copies: int = 0, extra: list[str] | None = None) -> DataFrame:
    """(b, ids, x, wide, few): the vectors (id, x) of each block as bytes, doubles only where floats would not hold them; ``few`` numbers those without ``copies`` equal ones before them.

    Columns ``extra`` follow as arrays.
    """
    extra = extra or []

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if t is None or not len(t):
            return
        t = t.take(np.argsort(t.column("id").to_numpy(), kind="stable")).combine_chunks()
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("x").chunks])
        with np.errstate(over="ignore", invalid="ignore"):
            wide = x.dtype != np.float32 and not np.array_equal(x.astype(np.float32).astype(x.dtype), x, equal_nan=True)
        x = x.astype(np.float64 if wide else np.float32)
        few = first_copies(x.reshape(len(t), -1), copies) if copies else np.arange(0)
        row = [[TaskContext.get().partitionId()], [t.column("id").to_numpy().astype(np.int64).tobytes()], [x.tobytes()], [wide], [few.astype(np.int64).tobytes()]]
        kinds = pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()
        more = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.concat_arrays(t.column(c).chunks)) for c in extra]
        yield pa.RecordBatch.from_arrays([*(pa.array(v, kind) for v, kind in zip(row, kinds)), *more], ["b", "ids", "x", "wide", "few", *extra])

    kinds = dict(nodes.dtypes)
    dealt = nodes.where("id is not null and x is not null").select(F.col("id").cast("long").alias("id"), "x", *extra).repartition(blocks, "id")
    return materialize(dealt.mapInArrow(bytes_of, ", ".join(["b long, ids binary, x binary, wide boolean, few binary", *(f"{c} array<{kinds[c]}>" for c in extra)])))


def crossed(packed: DataFrame, left: int, right: int) -> DataFrame:
    """Each block, as l_<column>, with each block: ``left`` times ``right`` tasks, the blocks of a side dealt in turn."""
    at = lambda n: packed.repartitionById(n, F.pmod("b", F.lit(n)).cast("int"))
    return at(left).select(*[F.col(c).alias(f"l_{c}") for c in packed.columns]).hint("shuffle_replicate_nl").join(at(right))


def once(l: int, b: int, blocks: int) -> bool:
    """Whether two blocks that meet as (l, b) and as (b, l) are to be worked on as (l, b); each block has as many of them."""
    ahead = (b - l) % blocks
    return 2 * ahead < blocks or (2 * ahead == blocks and l < b)


def unpack(ids: pa.Scalar, x: pa.Scalar, wide: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids.as_buffer(), np.int64)
    m = np.frombuffer(x.as_buffer(), np.float64 if wide.as_py() else np.float32)
    return ids, m.astype(float).reshape(len(ids), -1)


def first_copies(m: np.ndarray, most: int) -> np.ndarray:
    """Row numbers without the rows that have ``most`` equal ones before them."""
    view = np.ascontiguousarray(m + 0.0).view(np.dtype((np.void, m.shape[1] * m.itemsize))).ravel()
    order = np.argsort(view, kind="stable")
    new = np.append(True, view[order][1:] != view[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    return np.sort(order[np.arange(len(m)) - start < most])


class Best:
    """The k best partners of each row of a block so far: by ``cosine`` the greatest, by ``euclid`` the smallest; scores count as rounded, ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, metric: str, k: int, digits: int):
        self.metric, self.k, self.digits = metric, k, digits
        self.ids, self.m = self.usable(ids, m)
        self.centre = self.m.mean(axis=0) if metric == "euclid" and len(self.m) else np.zeros(m.shape[1])
        self.near = self.m - self.centre
        self.square = np.square(self.near).sum(axis=1)
        n = len(self.ids)
        #: Of the rows ranked so far, k places each: what is small is better; no partner has an infinite place.
        self.worth, self.to, self.score = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.nan)

    def usable(self, ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without vectors that have no score with any: not finite, or by cosine of norm zero. Cosines are products of unit vectors."""
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.linalg.norm(m, axis=1)
        own = np.flatnonzero(np.isfinite(size) & ((size > 0) | (self.metric != "cosine")))
        ids, m = ids[own], m[own]
        return ids, m / size[own][:, None] if self.metric == "cosine" else m

    def exact(self, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for at in range(0, len(i), 1 << 14):
            u, v = self.m[i[at : at + (1 << 14)]], m[j[at : at + (1 << 14)]]
            out[at : at + (1 << 14)] = (u * v).sum(axis=1) if self.metric == "cosine" else np.sqrt(np.square(u - v).sum(axis=1))
        return out

    def rank(self, i: np.ndarray, to: np.ndarray, score: np.ndarray) -> None:
        """Takes scored candidates of some rows into their k best."""
        rows, inside = np.unique(i, return_inverse=True)
        worth = np.round(score, self.digits) * (-1 if self.metric == "cosine" else 1)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), inside])
        worth = np.concatenate([self.worth[rows].ravel(), worth])
        to, score = np.concatenate([self.to[rows].ravel(), to]), np.concatenate([self.score[rows].ravel(), score])
        order = np.lexsort((to, worth, at))
        first = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < self.k]
        self.worth[rows], self.to[rows], self.score[rows] = (v[first].reshape(len(rows), self.k) for v in (worth, to, score))

    def bound(self, rows: slice, slack: np.ndarray) -> np.ndarray:
        """What the product of a row must reach for a partner that can be among its k best."""
        last = self.worth[rows, -1]
        step = 2 * 10.0**-self.digits
        if self.metric == "cosine":
            return -last - step - slack
        return (self.square[rows] - np.square(last + step)) / 2 - slack

    def meet(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Takes a block of others; of equal ones, k + 1 of the smallest ids are enough, since one may be the row itself."""
        ids, m = self.usable(ids, m)
        if not len(ids) or not len(self.ids):
            return
        there = m - self.centre
        half = np.square(there).sum(axis=1) / 2
        a, b = self.near, there
        if self.metric == "euclid":
            a, b = np.column_stack([a, np.ones(len(a))]), np.column_stack([b, -half])
        small = max(np.abs(a).max(), np.abs(b).max()) < 1e15 and self.square.max() + half.max() < 1e30
        kind, unit = (np.float32, UNIT) if small else (np.float64, UNIT * UNIT)
        far = np.sqrt(2 * half.max())
        slack = 1.1 * (m.shape[1] + 8) * unit * (np.sqrt(self.square) * far + (half.max() if self.metric == "euclid" else 0.0)) + 1e-14 * (self.square + 2 * half.max())
        a, b = a.astype(kind), b.astype(kind)
        for at in range(0, len(a), ROWS):
            rows = slice(at, min(len(a), at + ROWS))
            least, waiting = self.bound(rows, slack[rows]), []
            for of in range(0, len(b), COLUMNS):
                s = a[rows] @ b[of : of + COLUMNS].T
                if not np.isfinite(least).all():
                    # rows without k partners: the (k + 1)-th greatest of this product, since one may be the row itself
                    where = s.shape[1] - self.k - 1
                    first = np.partition(s, where, axis=1)[:, where] if where > 0 else np.full(len(s), -np.inf)
                    least = np.where(np.isfinite(least), least, first - 2 * slack[rows] - 4 * 10.0**-self.digits * (1 if self.metric == "cosine" else np.sqrt(self.square[rows]) + far))
                reach = np.nextafter(least.astype(kind), kind(-np.inf))
                some = np.flatnonzero(s.max(axis=1) >= reach)  # most rows have no candidate in a product
                found = np.flatnonzero(s[some] >= reach[some, None])
                for part in range(0, len(found), MOST):
                    i, j = np.divmod(found[part : part + MOST], s.shape[1])
                    i, j = some[i] + at, j + of
                    other = self.ids[i] != ids[j]
                    i, j = i[other], j[other]
                    waiting.append((i, j))
                    if of + COLUMNS >= len(b) or sum(len(w) for w, _ in waiting) >= MOST:
                        i, j = (np.concatenate(v) for v in zip(*waiting))
                        self.rank(i, ids[j], self.exact(i, m, j))
                        least, waiting = self.bound(rows, slack[rows]), []
            if waiting:
                i, j = (np.concatenate(v) for v in zip(*waiting))
                self.rank(i, ids[j], self.exact(i, m, j))

    def arrays(self) -> list[pa.Array]:
        i, j = np.nonzero(np.isfinite(self.worth))
        return [pa.array(self.ids[i]), pa.array(self.to[i, j]), pa.array(self.score[i, j])]


def nearest(nodes: DataFrame, k: int, blocks: int, metric: str, digits: int) -> DataFrame:
    """(src, dst, score): for each node (id, x) and each group of blocks its k best in that group."""
    blocks = max(blocks, -(-nodes.count() // SIZE))
    packed = pack(nodes, blocks, k + 1)
    groups = -(-blocks // GROUP)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                of = {c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}
                if at != of["l_b"].as_py():
                    if own:
                        yield pa.RecordBatch.from_arrays(own.arrays(), ["src", "dst", "score"])
                    at, own = of["l_b"].as_py(), Best(*unpack(of["l_ids"], of["l_x"], of["l_wide"]), metric, k, digits)
                ids, m = unpack(of["ids"], of["x"], of["wide"])
                few = np.frombuffer(of["few"].as_buffer(), np.int64)
                own.meet(ids[few], m[few])
        if own:
            yield pa.RecordBatch.from_arrays(own.arrays(), ["src", "dst", "score"])

    return crossed(packed, blocks, groups).mapInArrow(best, "src long, dst long, score double")
