"""Packing by cutting-stock column generation.

Documents become token ids with a closing id. Whole sequences are cut off
a document's start, and what remains has a length below the sequence length; the
histogram of these lengths is all that the plan needs, and it has as many entries as
a sequence has tokens however many documents there are. On the histogram the
driver solves the cutting-stock linear program over ``CLASSES`` classes of like lengths by column generation: a
revised simplex over patterns (multisets of classes that fit one sequence), with new columns priced by an
unbounded-knapsack dynamic program, until the cost is within ``GAP`` of a lower bound (the tokens that there are, or
Farley's bound), or after ``PIVOTS`` steps; the plan's ``gap`` tells. Amounts are rounded down, and each copy of a pattern takes
lengths of its classes that fill a sequence but for ``MAX_WASTE`` tokens. What is left is filled greedily by
whole patterns of one to four lengths, and what no such pattern fills goes to a stream that is cut
at each sequence boundary, which leaves one padded sequence in all.

Each document is ranked within its length. A rank gives its pattern, copy
and offset by arithmetic on the plan, so that assignment is one pass and no
group is gathered. Ranks come from row numbers within (length, range of the order
column), which splits a length that a third of all documents share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.llm.tokens import Encoder
from meshwork.session import materialize, table

CAPACITY = 1024
#: Ranges of the order column within which rows of one length are numbered.
RANGES = 32
#: Tokens that a used pattern may leave free.
MAX_WASTE = 2
#: How far the linear program's cost may be from its lower bound, and the most steps of the simplex.
GAP = 1e-3
PIVOTS = 20_000
#: Lengths of a pattern that are chosen by their sum; of what a longer one has before, the most frequent of each class.
FREE = 12
#: Classes of lengths of the linear program.
CLASSES = 128
#: Ranges of rows that share a place with many others, or have none.
SALTS = 16

TOKENISED = "doc_id long, place long, doc_tokens long, full_crcs array<long>, rest int, rest_crc long, rest_ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(path: str, closing: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        narrow = "<u2" if encoder.slow.get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            out = {k: [] for k in ("doc_tokens", "full_crcs", "rest", "rest_crc", "rest_ids")}
            for t in b.column(2):
                ids = np.append(encoder.encode(t.as_py() or ""), np.uint32(closing))
                whole = len(ids) // capacity * capacity
                rest = ids[whole:]
                out["doc_tokens"].append(len(ids))
                out["full_crcs"].append([crc(ids[i : i + capacity]) for i in range(0, whole, capacity)])
                out["rest"].append(len(rest))
                out["rest_crc"].append(crc(rest))
                out["rest_ids"].append(rest.astype(narrow).tobytes())
            columns = [b.column(0), b.column(1), pa.array(out["doc_tokens"], pa.int64()), pa.array(out["full_crcs"], pa.list_(pa.int64())), pa.array(out["rest"], pa.int32()), pa.array(out["rest_crc"], pa.int64()), pa.array(out["rest_ids"], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", *out])

    return run


def price(lengths: np.ndarray, worth: np.ndarray, capacity: int, most: int = 12) -> list[np.ndarray]:
    """Patterns of great worth, the greatest first, by dynamic programming over the capacity.

    Besides the best multiset of lengths that fits, these are the best ones among
    those that hold a certain length.
    """
    use = worth > 1e-12
    own, value = lengths[use], worth[use]
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(own, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := ends[c]:
            tried = best[c - own[:k]] + value[:k]
            if tried[j := tried.argmax()] > best[c] + 1e-15:
                best[c], took[c] = tried[j], j
    found = []
    for first in np.argsort(-(value + best[capacity - own]), kind="stable")[: 3 * most]:
        counts, c = np.zeros(len(own), np.int64), capacity - own[first]
        counts[first] = 1
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                counts[took[c]] += 1
                c -= own[took[c]]
        pattern = np.zeros(len(lengths), np.int64)
        pattern[use] = counts
        if not any((pattern == x).all() for x in found):
            found.append(pattern)
            if len(found) == most:
                break
    return found


def filled(left: np.ndarray, room: int) -> list[int] | None:
    """Up to three lengths that fill ``room`` exactly, of those the ones with most left; None if there are none."""
    if room == 0:
        return []
    a = np.arange(1, room // 2 + 1)
    both = np.minimum(left[a], left[room - a])
    if room % 2 == 0:
        both[-1] = left[room // 2] // 2
    best = int(both.max()) if len(both) else 0
    if left[room] > 0 and left[room] >= best:
        return [room]
    if best:
        k = int(both.argmax()) + 1
        return [k, room - k]
    for first in np.argsort(-left[1:room], kind="stable")[:8] + 1:
        if left[first] > 0:
            rest = left.copy()
            rest[first] -= 1
            a = np.arange(1, (room - first) // 2 + 1)
            both = np.minimum(rest[a], rest[room - first - a])
            if (room - first) % 2 == 0 and len(both):
                both[-1] = rest[(room - first) // 2] // 2
            if len(both) and both.max() > 0:
                k = int(both.argmax()) + 1
                return [int(first), k, int(room - first - k)]
    return None


def greedy(left: np.ndarray, capacity: int, waste: int) -> Iterator[dict[int, int]]:
    """Patterns of the largest length left and what fills its sequence, but for up to ``waste`` tokens; the caller takes them out of ``left``."""
    for size in range(len(left) - 1, 0, -1):
        while left[size] > 0:
            own = np.pad(left, (0, max(0, capacity + 1 - len(left))))
            own[size] -= 1
            rest = next((r for free in range(min(waste, capacity - size) + 1) if (r := filled(own, capacity - size - free)) is not None), None)
            if rest is None:
                break
            yield dict(zip(*(x.tolist() for x in np.unique([size, *rest], return_counts=True))))


def realised(left: np.ndarray, classes: list[int], unit: int, capacity: int, waste: int) -> dict[int, int] | None:
    """A pattern of lengths, one of each class, that fills a sequence but for ``waste`` tokens; by dynamic programming over the sums."""
    first: list[int] = []
    for c in classes[:-FREE]:
        own = [x for x in members(c, unit, len(left)) if left[x] > first.count(x)]
        if not own:
            return None
        first.append(max(own, key=lambda x: left[x]))
    reach: dict[int, tuple[int, ...]] = {sum(first): tuple(first)} if sum(first) <= capacity else {}
    for c in classes[-FREE:]:
        own = [x for x in members(c, unit, len(left)) if left[x] > 0]
        new: dict[int, tuple[int, ...]] = {}
        for total, taken in reach.items():
            for x in own:
                if total + x <= capacity and left[x] > taken.count(x):
                    old = new.get(total + x)
                    if old is None or left[x] * (1 + len(taken)) > left[old[-1]] * (1 + taken.count(x)):
                        new[total + x] = (*taken, x)
        reach = new
    best = max(reach, default=0)
    if best < capacity - waste:
        return None
    return dict(zip(*(x.tolist() for x in np.unique(reach[best], return_counts=True))))


def class_of(lengths: np.ndarray, unit: int) -> np.ndarray:
    """The nearest multiple of ``unit``, one at least."""
    return np.maximum(1, (lengths + unit // 2) // unit)


def members(c: int, unit: int, most: int) -> range:
    return range(1 if c == 1 else c * unit - unit // 2, min(most, c * unit + unit - unit // 2))


def column_generation(demand: np.ndarray, capacity: int, gap: float = GAP, max_pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, patterns, amounts) of a solution of the linear program, within ``gap`` of the optimum unless ``max_pivots`` came first.

    ``demand[l]`` is how many items of length l there are. patterns[:, j] counts the items of
    each length in pattern j, and amounts[j] says how often it is used. The simplex runs on slightly larger
    demands, different for each length, so that it doesn't stall at ties.
    """
    lengths = np.flatnonzero(demand)
    exact = demand[lengths].astype(float)
    draws = np.random.default_rng(0)
    need = exact * (1 + 1e-4 * draws.random(len(lengths))) + 1e-3 * draws.random(len(lengths))
    columns = np.diag(capacity // lengths).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // lengths))
    amounts = inverse @ need
    tokens = float(lengths @ need) / capacity
    pivots = 0
    while pivots < max_pivots and amounts.sum() > tokens * (1 + gap):
        patterns = price(lengths, inverse.sum(axis=0), capacity)  # every pattern costs one sequence
        if inverse.sum(axis=0) @ patterns[0] <= 1 + gap:  # Farley: the optimum is at least the cost / this value
            break
        for pattern in patterns:
            if inverse.sum(axis=0) @ pattern <= 1 + min(gap, 1e-6):
                continue
            step = inverse @ pattern
            up = step > 1e-9
            ratio = np.full(len(step), np.inf)
            ratio[up] = amounts[up] / step[up]
            out = int(ratio.argmin())
            amounts -= ratio[out] * step
            amounts[out] = ratio[out]
            np.maximum(amounts, 0, out=amounts)
            row = inverse[out] / step[out]
            some = np.flatnonzero(np.abs(row) > 1e-14)
            inverse[:, some] -= np.outer(step, row[some])
            inverse[out] = row
            columns[:, out] = pattern
            pivots += 1
    return lengths, columns, np.maximum(inverse @ exact, 0)


class Plan:
    """Where the items of each length go, by rank.

    Ranks of a length that start at ``start`` belong to a pattern that takes
    ``per`` of them in each of its copies, side by side from ``offset``; its copies
    are the sequences from ``first``. Ranks from ``streamed`` on lie one after
    another in the stream.
    """

    def __init__(self, demand: np.ndarray, capacity: int = CAPACITY, max_waste: int = MAX_WASTE):
        self.capacity = capacity
        left = demand.astype(np.int64).copy()
        segments, sequences, self.gap = [], 0, 0.0

        def use(pattern: dict[int, int], most: int) -> int:
            nonlocal sequences
            n = min([most, *(int(left[x]) // per for x, per in pattern.items())])
            offset = 0
            for size, per in sorted(pattern.items()):
                segments.append((size, int(demand[size] - left[size]), per, offset, sequences))
                left[size] -= per * n
                offset += per * size
            sequences += n
            return n

        if left.sum():
            unit = max(1, capacity // CLASSES)
            x = np.flatnonzero(demand)
            grouped = np.bincount(class_of(x, unit), weights=demand[x], minlength=2).astype(np.int64)
            classes, patterns, amounts = column_generation(grouped, capacity // unit)
            #: cost of the linear program against the tokens of the classes
            self.gap = float(amounts.sum()) * (capacity // unit) / float(classes @ grouped[classes]) - 1
            for j in np.argsort(-amounts, kind="stable"):
                copies, wanted = int(amounts[j] + 1e-6), np.repeat(classes, patterns[:, j]).tolist()
                while copies > 0 and (pattern := realised(left, wanted, unit, capacity, max_waste)):
                    copies -= use(pattern, copies)
            for pattern in greedy(left, capacity, max_waste):
                use(pattern, 1 << 62)
        self.streamed = demand - left
        self.stream_at = np.concatenate([[0], np.cumsum(np.arange(len(demand)) * left)])[:-1]
        total = int((np.arange(len(demand)) * left).sum())
        self.stream_first = sequences
        self.n_sequences = sequences + -(-total // capacity)
        segments.sort()
        self.table = np.array(segments, np.int64).reshape(-1, 5)

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, stream position or -1) of items with these lengths and ranks."""
        stream = rank >= self.streamed[size]
        at = np.where(stream, self.stream_at[size] + (rank - self.streamed[size]) * size, -1)
        sequence, offset = self.stream_first + at // self.capacity, at % self.capacity
        if len(self.table):
            wide = np.int64(1) << 48
            row = np.searchsorted(self.table[:, 0] * wide + self.table[:, 1], size * wide + rank, side="right") - 1
            _, start, per, base, first = self.table[np.maximum(row, 0)].T
            sequence = np.where(stream, sequence, first + (rank - start) // per)
            offset = np.where(stream, offset, base + (rank - start) % per * size)
        return sequence, offset, at


def _pieces(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cap = plan.capacity
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            ids, tokens = col["doc_id"].to_numpy(zero_copy_only=False), col["doc_tokens"].to_numpy()
            size, rank, before = col["rest"].to_numpy().astype(np.int64), col["rank"].to_numpy(), col["before"].to_numpy()
            has_id = np.array(col["doc_id"].is_valid())
            sequence, offset, stream = plan.place(size, rank)
            out = [[] for _ in range(7)]
            nested = col["full_crcs"]
            n_full = (tokens - size) // cap
            # whole sequences
            row = np.repeat(np.arange(len(size)), n_full)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
            parts = [(row, nth * cap, np.full(len(row), cap), nested.flatten().to_numpy(zero_copy_only=False).astype(np.int64), plan.n_sequences + before[row] + nth, np.zeros(len(row), np.int64))]
            # remainders, and those of the stream that cross a boundary in two
            crosses = (stream >= 0) & (offset + size > cap) & (size > 0)
            whole = np.flatnonzero((size > 0) & ~crosses)
            parts.append((whole, tokens[whole] - size[whole], size[whole], col["rest_crc"].to_numpy()[whole], sequence[whole], offset[whole]))
            cut = np.flatnonzero(crosses)
            if len(cut):
                first = cap - offset[cut]
                raw = [col["rest_ids"][int(i)].as_py() for i in cut]
                raw = [np.frombuffer(r, f"<u{len(r) // size[i]}") for r, i in zip(raw, cut)]
                start = tokens[cut] - size[cut]
                parts.append((cut, start, first, np.array([crc(r[:f]) for r, f in zip(raw, first)]), sequence[cut], offset[cut]))
                parts.append((cut, start + first, size[cut] - first, np.array([crc(r[f:]) for r, f in zip(raw, first)]), sequence[cut] + 1, np.zeros(len(cut), np.int64)))
            row, start, length, sums, seq, off = (np.concatenate([p[k] for p in parts]) for k in range(6))
            row = row.astype(np.int64)
            out = [pa.array(ids[row].astype(np.int64) if has_id.all() else [int(ids[i]) if has_id[i] else None for i in row], pa.int64())]
            out += [pa.array(x.astype(np.int64)) for x in (start, length, sums, tokens[row], seq, off)]
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", order: str | None = None, capacity: int = CAPACITY, closing: int = 0, ranges: int = RANGES) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a ``tokenizers`` file that every machine has.
    ``order`` names an integer column: within a length, earlier documents go to
    earlier sequences (default: the id; nulls first). A null text counts as
    empty and has the closing id alone. Repeated rows are packed as often as they occur.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(order or doc_id).cast("long").alias("place"), F.col(text).alias("text"))
    rows = materialize(rows.mapInArrow(_tokenised(tokenizer, closing, capacity), TOKENISED).withColumn("uid", F.monotonically_increasing_id()))
    splits = rows.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    hot = sorted({x for x, y in zip(splits, splits[1:]) if x == y})  # at most ``ranges`` places that many rows share
    splits = sorted(set(splits))
    n_full = F.size("full_crcs").cast("long")
    part = F.size(F.filter(F.array(*map(F.lit, splits)), lambda x: x < F.col("place"))) if splits else F.lit(0)
    salt = F.when(F.col("place").isNull() | F.col("place").isin(hot), F.pmod(F.xxhash64("uid"), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    ranked = rows.withColumn("part", (F.coalesce(part, F.lit(-1)) * (SALTS + 1) + salt).cast("int"))
    # at most capacity x (ranges + 1) x (salts + 1) rows, whatever the input
    groups = ranked.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(n_full).alias("full")).collect()
    demand, offsets, full = np.zeros(capacity, np.int64), {}, 0
    for g in sorted(groups, key=lambda g: (g["rest"], g["part"])):
        offsets[g["rest"], g["part"]] = (int(demand[g["rest"]]), full)
        demand[g["rest"]] += g["n"]
        full += g["full"]
    demand[0] = 0
    plan = Plan(demand, capacity)
    by = Window.partitionBy("rest", "part").orderBy("place", "uid")
    ranked = ranked.withColumn("rank", F.row_number().over(by).cast("long") - 1)
    ranked = ranked.withColumn("before", F.coalesce(F.sum(n_full).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            keys = list(zip(b.column(names.index("rest")).to_pylist(), b.column(names.index("part")).to_pylist()))
            add = np.array([offsets[k] for k in keys], np.int64).reshape(-1, 2)
            columns = [b.column(i) for i in range(len(names))]
            for i, name in enumerate(("rank", "before")):
                columns[names.index(name)] = pa.array(columns[names.index(name)].to_numpy() + add[:, i])
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranked.mapInArrow(lambda it: _pieces(plan)(shifted(it)), PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
