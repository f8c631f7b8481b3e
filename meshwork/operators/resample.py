"""Permutation nulls and bootstraps whose shuffles don't grow with rows times draws.

Rows are dealt once into blocks that fit a task, and a block works out its part of all draws.

* A permutation of labels within a stratum is drawn in two steps. How many rows of each group a block gets is drawn from the multivariate hypergeometric
  distribution, block after block, for a batch of permutations at a time; then each block deals its own ranks under these
  counts. This is exactly a uniform permutation, and what meets is rank sums by (permutation, group). A block holds distinct ranks and how many rows have them:
  for a rank with many rows only how many go to each group is drawn.
* A bootstrap weighs rows by Poisson(1) numbers that follow from the row's id and the draw alone. Blocks are ranges of values; the
  blocks' weights tell in which block each draw's median lies, and only that block looks for it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.operators.rank import with_ranks, with_within_ranks
from meshwork.session import materialize, small_side

#: Rows of a block, and permutations that are drawn at a time.
BLOCK = 1 << 16
BATCH = 250
#: Rows of one rank from which on their groups are counted instead of dealt row by row, and rows from which on they are dealt by random bytes.
MANY = 64
BYTES = 2_048
#: Ranges of values, and parts of a range that holds one frequent value alone.
RANGES = 64
SALTS = 16
#: A prime, and the numbers that mix id and draw; fifth powers are a bijection modulo this prime.
PRIME = (1 << 31) - 1
MIX = (1_103_515_245, 69_069, 12_345, 1_664_525, 1_013_904_223)
#: Below which mixed numbers a Poisson(1) weight is at most 0, 1, 2 ...
POISSON = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def eta(sums: DataFrame, sizes: DataFrame, ties: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """(keys, h, n, k, eta2) of rank sums (keys, g, s); group sizes (by, g, c) and tie terms (by, ties) are the same in all draws."""
    met = sums.join(small_side(sizes), [*by, "g"])
    a = met.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("q"), F.sum("c").cast("double").alias("n"), F.count(F.lit(1)).alias("k"))
    a = a.join(small_side(ties), by) if by else a.join(F.broadcast(ties))  # without keys one row
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    out = a.withColumn("h", h)
    return out.select(*keys, "h", n.cast("long").alias("n"), "k", F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (n - F.col("k"))).alias("eta2"))


class Ranked:
    """The ranks of a Kruskal-Wallis test for each key of ``by``: over all its rows, or within ``region`` and then over all.

    Rows without a value or group are left out. ``id`` names rows; it deals them into blocks.
    """

    def __init__(self, df: DataFrame, id: str, y: str, group: str, by: list[str] | None = None, region: str | None = None):
        self.by = by or []
        rows = df.where(F.col(y).isNotNull() & F.col(group).isNotNull())
        if region:
            rows = with_within_ranks(rows, y, "_within", [*self.by, region]).withColumn("_within", F.round("_within", 12))
        ranked = with_ranks(rows, "_within" if region else y, "rank", self.by)
        self.strata = [*self.by, *([region] if region else [])]
        self.rows = materialize(ranked.select(*self.strata, F.col(id).alias("_id"), F.col(group).alias("g"), "rank"))
        self.sizes = self.rows.groupBy(*self.by, "g").agg(F.count(F.lit(1)).alias("c"))
        t = self.rows.groupBy(*self.by, "rank").agg(F.count(F.lit(1)).cast("double").alias("t"))
        self.ties = t.groupBy(*self.by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))

    def observed(self) -> DataFrame:
        """(by, h, n, k, eta2) of the labels as they are."""
        sums = self.rows.groupBy(*self.by, "g").agg(F.sum("rank").alias("s"))
        return eta(sums, self.sizes, self.ties, self.by, self.by)

    def null(self, n: int = 5000, seed: int = 0, block: int = BLOCK) -> DataFrame:
        """(by, perm, h, n, k, eta2) of ``n`` permutations of the labels within each stratum."""
        strata = [F.col(c) for c in self.strata]
        each = self.rows.groupBy(*strata, "rank").agg(F.count(F.lit(1)).alias("_times"))
        size = each.groupBy(*strata).agg(F.sum(F.least("_times", F.lit(MANY))).alias("_n"))
        parts = F.ceil(F.col("_n") / block).cast("int")
        dealt = each.join(small_side(size), self.strata) if strata else each.join(F.broadcast(size))
        dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("rank"), parts).cast("int"))
        blocks = materialize(dealt.groupBy(*strata, "_b").agg(F.sort_array(F.collect_list(F.struct("rank", "_times"))).alias("ranks"), F.sum("_times").alias("_m")))
        shares = blocks.groupBy(*strata).agg(F.sort_array(F.collect_list(F.struct("_b", "_m"))).alias("blocks"))
        groups = self.rows.groupBy(*strata, "g").agg(F.count(F.lit(1)).alias("c")).groupBy(*strata).agg(F.sort_array(F.collect_list(F.struct("g", "c"))).alias("groups"))
        plan = shares.join(groups, self.strata) if strata else shares.join(F.broadcast(groups))
        batches = F.explode(F.sequence(F.lit(0), F.lit(-(-n // BATCH) - 1))).alias("batch")
        name = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in self.strata], F.lit(str(seed)))
        plan = plan.select(*strata, name.alias("name"), "blocks", "groups", batches).repartition(*strata, "batch")
        kinds = dict(self.rows.dtypes)
        own = ", ".join(f"`{c}` {kinds[c]}" for c in self.strata)
        counts = plan.mapInPandas(_block_counts(self.strata, n), ", ".join([*([own] if own else []), "name string", "_b int", "batch int", f"groups array<{kinds['g']}>", "counts array<int>"]))
        # a block is little data and much work, so small partitions must not be put together
        key, tasks = [*self.strata, "_b"], min(1024, 2 * blocks.count())
        there = blocks.select(*strata, "_b", F.col("ranks.rank").alias("ranks"), F.col("ranks._times").alias("_times"))
        met = counts.repartition(tasks, *key).hint("merge").join(there.repartition(tasks, *key), key)
        out = ", ".join([*(f"`{c}` {kinds[c]}" for c in self.by), "perm int", f"g {kinds['g']}", "s double"])
        sums = met.mapInPandas(_block_sums(self.by), out).groupBy(*self.by, "perm", "g").agg(F.sum("s").alias("s"))
        return eta(sums, self.sizes, self.ties, self.by, [*self.by, "perm"])


def _rng(name: str, *numbers: int) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(name.encode()), *numbers])


def _sums(rng: np.random.Generator, ranks: np.ndarray, times: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rank sums by group, a row for each permutation, when as many rows as ``counts`` says get each group."""
    left, sums = counts.copy(), np.zeros(counts.shape)
    for rank, n in zip(ranks[times >= MANY], times[times >= MANY]):
        taken = _drawn(rng, left, n)
        left -= taken
        sums += rank * taken
    rows = np.repeat(ranks[times < MANY], times[times < MANY])
    if len(rows) >= BYTES:
        share = np.diff(np.rint(np.append(0, np.cumsum(left[0])) * (256 / len(rows))).astype(int))
        of = np.repeat(np.arange(counts.shape[1]), share)
        return sums + np.stack([_dealt_sums(rng, rows, of, c) for c in left])
    if len(rows):
        step = max(1, (1 << 22) // len(rows))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            run = np.cumsum(rng.permuted(np.broadcast_to(rows, (len(part), len(rows))), axis=1), axis=1)
            upto = np.take_along_axis(np.concatenate([np.zeros((len(part), 1)), run], axis=1), np.cumsum(part, axis=1), axis=1)
            sums[at : at + step] += np.diff(upto, axis=1, prepend=0.0)
    return sums


def _drawn(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows get each group, a row for each permutation, if ``left`` are still to be given out."""
    want, rest, taken = np.full(len(left), n, np.int64), left.sum(axis=1), np.zeros_like(left)
    for k in range(left.shape[1]):
        rest = rest - left[:, k]
        taken[:, k] = rng.hypergeometric(left[:, k], rest, want)
        want = want - taken[:, k]
    return taken


def _dealt_sums(rng: np.random.Generator, rows: np.ndarray, of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rank sums by group of one uniform permutation: a random byte gives each row a group (``of`` the byte), then random rows of groups with too many go to random places of the others.

    No step depends on where a row lies, so all arrangements with these counts are equally likely.
    """
    b = rng.bit_generator.random_raw(-(-len(rows) // 8)).view(np.uint8)[: len(rows)]
    to = b.astype(np.intp)
    k = len(counts)
    sums = np.bincount(of, np.bincount(to, rows, 256), k)
    over = np.bincount(of, np.bincount(to, minlength=256), k).astype(np.int64) - counts
    many = np.flatnonzero(over > 0)
    if not len(many):
        return sums
    tries = int(1.3 * (over[many] * len(rows) / (counts + over)[many]).max()) + 64
    for tries in (tries, len(rows)):
        if tries * 2 >= len(rows):
            at = rng.permutation(len(rows))
        else:
            at = rng.integers(0, len(rows), tries)
            at = at[np.sort(np.unique(at, return_index=True)[1])]
        own = of[b[at]]
        moved = [at[own == g][: over[g]] for g in many]
        if all(len(m) == over[g] for m, g in zip(moved, many)):
            break
    for m, g in zip(moved, many):
        sums[g] -= rows[m].sum()
    few = np.flatnonzero(over < 0)
    return sums + np.bincount(np.repeat(few, -over[few]), rows[rng.permutation(np.concatenate(moved))], k)


def _block_counts(strata: list[str], n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.to_dict("records"):
                perms = min(BATCH, n - r["batch"] * BATCH)
                left = np.tile(np.array([g["c"] for g in r["groups"]], np.int64), (perms, 1))
                rng, rows = _rng(r["name"], r["batch"]), []
                for b in r["blocks"]:
                    taken = _drawn(rng, left, b["_m"])
                    left -= taken
                    rows.append({**{c: r[c] for c in strata}, "name": r["name"], "_b": b["_b"], "batch": r["batch"], "groups": [g["g"] for g in r["groups"]], "counts": taken.ravel().tolist()})
                yield pd.DataFrame(rows)

    return run


def _block_sums(by: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.to_dict("records"):
                counts = np.asarray(r["counts"], np.int64).reshape(-1, len(r["groups"]))
                sums = _sums(_rng(r["name"], r["batch"], r["_b"] + 1), np.asarray(r["ranks"], float), np.asarray(r["_times"], np.int64), counts)
                k = counts.shape[1]
                perm = r["batch"] * BATCH + np.arange(len(counts))
                yield pd.DataFrame({**{c: [r[c]] * counts.size for c in by}, "perm": np.repeat(perm, k).astype(np.int32), "g": list(r["groups"]) * len(counts), "s": sums.ravel()})

    return run


def permutation_test(df: DataFrame, id: str, y: str, group: str, n: int = 5000, by: list[str] | None = None, region: str | None = None, seed: int = 0) -> DataFrame:
    """(by, observed, p, p95, p99, n_perm): eta squared of each key, p = (1 + #{null >= observed}) / (1 + n), and the null's percentiles."""
    test = Ranked(df, id, y, group, by, region)
    observed = test.observed().select(*test.by, F.col("eta2").alias("observed"))
    null = test.null(n, seed).select(*test.by, "eta2")
    met = null.join(small_side(observed), test.by) if test.by else null.join(F.broadcast(observed))
    above = F.count_if(F.round("eta2", 12) >= F.round("observed", 12))
    return met.groupBy(*test.by).agg(
        F.max("observed").alias("observed"), ((1 + above) / (1 + F.count(F.lit(1)))).alias("p"),
        F.percentile("eta2", 0.95).alias("p95"), F.percentile("eta2", 0.99).alias("p99"), F.count(F.lit(1)).alias("n_perm"),
    )


def verdict(tests: DataFrame, period: str, decisive: Column, alpha: float, need: int) -> DataFrame:
    """One row: p of the decisive period, periods whose observed value is above p95, and whether p < alpha and there are ``need`` of them."""
    a = tests.agg(F.max(F.when(F.col(period) == decisive, F.col("p"))).alias("p_decisive"), F.count_if(F.col("observed") > F.col("p95")).alias("n_above"), F.count(F.lit(1)).alias("n_periods"))
    return a.withColumn("holds", F.coalesce((F.col("p_decisive") < alpha) & (F.col("n_above") >= need), F.lit(False)))


def poisson_weights(ids: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Poisson(1) weights, a row for each id and a column for each draw."""
    a, b, c, d, e = MIX
    h = ((ids % PRIME)[:, None] * a + draws[None, :] * b + c) % PRIME
    h = (_fifth(h) + draws[None, :] * d + e) % PRIME
    return np.searchsorted(np.array(POISSON), _fifth(h), "right").astype(np.int32)


def _fifth(h: np.ndarray) -> np.ndarray:
    square = h * h % PRIME
    return square * square % PRIME * h % PRIME


def poisson_sql(id: str, draw: str) -> str:
    """The same weight in SQL."""
    a, b, c, d, e = MIX
    fifth = lambda h: f"(({h} * {h} % {PRIME}) * ({h} * {h} % {PRIME}) % {PRIME} * {h} % {PRIME})"
    return f"list_sum(list_transform({POISSON}, lambda t: CASE WHEN {fifth('h2')} >= t THEN 1 ELSE 0 END)) FROM (SELECT *, ({fifth('h1')} + {draw} * {d} + {e}) % {PRIME} AS h2 FROM (SELECT *, ({id} % {PRIME} * {a} + {draw} * {b} + {c}) % {PRIME} AS h1"


def _weights_of_blocks(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("rows")
            total = [_total(np.array([r["id"] for r in rows.as_py()], np.int64), n).astype("<i8").tobytes() for rows in b.column(at)]
            keep = [i for i in range(len(b.schema.names)) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(total, pa.binary())], [*(b.schema.names[i] for i in keep), "total"])

    return run


def _total(ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for at in range(0, len(ids), 512):
        out += poisson_weights(ids[at : at + 512], np.arange(n)).sum(axis=0)
    return out


def _requests(pdf: pd.DataFrame) -> pd.DataFrame:
    """In which block the two middle rows of each draw lie, and how many weights of that block come before them."""
    pdf = pdf.sort_values(["bin", "salt"], kind="stable").reset_index(drop=True)
    run = np.cumsum(np.stack([np.frombuffer(t, "<i8") for t in pdf.total]), axis=0)
    n, out = run[-1], []
    for target in ((n + 1) // 2, n // 2 + 1):
        at = (run < target[None, :]).sum(axis=0)
        for i in np.unique(at[n > 0]):
            draws = np.flatnonzero((at == i) & (n > 0))
            before = run[i - 1][draws] if i else np.zeros(len(draws), np.int64)
            out.append((pdf.g[0], int(pdf.bin[i]), int(pdf.salt[i]), draws.tolist(), (target[draws] - before).tolist()))
    return pd.DataFrame(out, columns=["g", "bin", "salt", "draws", "places"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids, x = np.array([v["id"] for v in r["rows"]], np.int64), np.array([v["x"] for v in r["rows"]])
            draws, places, values = np.array(r["draws"], np.int64), np.array(r["places"], np.int64), []
            step = max(1, (1 << 21) // len(ids))
            for at in range(0, len(draws), step):
                run = np.cumsum(poisson_weights(ids, draws[at : at + step]), axis=0)
                values.append(x[(run < places[at : at + step][None, :]).sum(axis=0)])
            yield pa.RecordBatch.from_pydict({"g": pa.array([r["g"]] * len(draws), b.schema.field("g").type), "draw": draws, "x": np.concatenate(values)})


def bootstrap_medians(df: DataFrame, id: str, x: str, group: str, n: int = 5000, ranges: int = RANGES) -> DataFrame:
    """(g, draw, median): medians of each group under Poisson weights of its rows; a draw of weight zero has none.

    A row is (id, x, group) with a whole number as id; rows without a value are left out. A frequent value has ranges of its own, dealt by id.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(group).alias("g"))
    splits = rows.groupBy("g").agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10_000).alias("s"))
    cut = rows.join(small_side(splits), "g")
    hot = F.size(F.filter("s", lambda e: e == F.col("x"))) > 1
    place = F.size(F.filter("s", lambda e: e < F.col("x"))) * 2 + hot.cast("int")
    cut = cut.withColumn("bin", place.cast("int")).withColumn("salt", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    blocks = materialize(cut.groupBy("g", "bin", "salt").agg(F.sort_array(F.collect_list(F.struct("x", "id"))).alias("rows")))
    kind = dict(rows.dtypes)["g"]
    totals = blocks.mapInArrow(_weights_of_blocks(n), f"g {kind}, bin int, salt int, total binary")
    asked = totals.groupBy("g").applyInPandas(_requests, f"g {kind}, bin int, salt int, draws array<long>, places array<long>")
    found = blocks.join(asked, ["g", "bin", "salt"]).mapInArrow(_found, f"g {kind}, draw long, x double")
    return found.groupBy("g", "draw").agg(F.avg("x").alias("median"))


def bootstrap_gaps(df: DataFrame, id: str, x: str, group: str, pairs: list[tuple], n: int = 5000) -> DataFrame:
    """(a, b, diff, low, high, n, differs): the gap of two groups' medians, b less a, with its 2.5 and 97.5 percent points over the draws."""
    m = materialize(bootstrap_medians(df, id, x, group, n))
    of = df.where(F.col(x).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.median(x).alias("m"))
    wanted = df.sparkSession.createDataFrame(pairs, f"a {dict(m.dtypes)['g']}, b {dict(m.dtypes)['g']}")
    side = lambda t, s, v: t.select(F.col("g").alias(s), *[c for c in t.columns if c == "draw"], F.col(v).alias(f"_{s}"))
    drawn = F.broadcast(wanted).join(side(m, "a", "median"), "a").join(side(m, "b", "median"), ["b", "draw"])
    q = drawn.groupBy("a", "b").agg(F.percentile(F.col("_b") - F.col("_a"), [0.025, 0.975]).alias("q"), F.count(F.lit(1)).alias("n"))
    out = q.join(side(of, "a", "m"), "a").join(side(of, "b", "m"), "b")
    low, high = F.col("q")[0], F.col("q")[1]
    return out.select("a", "b", (F.col("_b") - F.col("_a")).alias("diff"), low.alias("low"), high.alias("high"), "n", ((low > 0) | (high < 0)).alias("differs"))
