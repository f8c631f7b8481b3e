"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With weight w the i-th block of a source
(from 0) is released at slot floor(i / w) and due by slot ceil((i + 1) / w); in each slot the
released block with the earliest deadline goes next. As the weights sum to one, every
block meets its deadline, so that after any number of slots each source is less than
one block away from its target.

Weights are exact ratios of whole numbers, so the schedule repeats after as many slots as their
sum, and all that has to be worked out is a fold over the slots of one period, or over those that the
table fills if they are fewer. Up to ``WIDE`` sources are scheduled at once. More of them are dealt into bundles,
which are scheduled like sources, and then each bundle's slots among its own sources, each in a row of its own; there a source is
less than one block and its part of the bundle away from its target. A document's slot follows
from its rank in its source by arithmetic. Ranks are row numbers within (source, range of ids), which splits a source
that holds a third of all rows.

When a source runs out, its slots stay empty and the others keep their own. A source of weight zero
follows after all others; nothing is dropped or repeated.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.llm.columns import fresh
from meshwork.session import materialize, small_side, table

#: Slots of a period without given weights, and documents of a block.
SLOTS = 1024
BLOCK = 16
#: Ranges of ids within which the rows of a source are numbered.
RANGES = 64
#: Sources, or bundles of them, in one schedule.
WIDE = 256
#: Slots that a fold may have.
LONGEST = 1 << 14
#: Starts of partitions, by source, that are sent to every task.
MANY = 100_000
#: The id that stands for a null, before all others.
FIRST = -(1 << 63)


def whole(weights: dict[str, float | int | Fraction]) -> dict[str, int]:
    """Whole numbers in the ratio of the weights; a float counts as the simplest ratio within its digits."""
    exact = {k: w if isinstance(w, (int, Fraction)) else Fraction(str(w)).limit_denominator(10**6) for k, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("a weight is negative")
    scale = lcm(*[Fraction(w).denominator for w in exact.values()], 1)
    out = {k: int(w * scale) for k, w in exact.items()}
    by = gcd(*out.values()) or 1
    if sum(out.values()) // by > 1 << 40:
        raise ValueError("the weights have no small common denominator; give whole numbers or fractions")
    return {k: w // by for k, w in out.items()}


def tickets(counts: DataFrame, weights: dict[str, float | int | Fraction] | None = None, slots: int = SLOTS) -> DataFrame:
    """(source, n, tickets, slots) from rows (source, n): a source's target weight is tickets / slots.

    Given weights are exact; sources that they lack have none, and sources that the table lacks don't count. Without ``weights``
    the targets are the square roots of the counts as parts of ``slots``, or of twice the number of sources if that is more:
    one part each, the rest by largest remainder (ties to the smaller name). The windows below are over the
    rows of sources alone.
    """
    every = Window.partitionBy()
    if weights is not None:
        own = whole(weights)
        known = F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*[F.lit(w).cast("long") for w in own.values()])) if own else None
        t = counts.withColumn("tickets", F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0).cast("long")) if own else F.lit(0).cast("long"))
        return t.select("source", "n", "tickets", F.sum("tickets").over(every).alias("slots"))
    t = counts.withColumn("slots", F.greatest(F.lit(slots), 2 * F.count(F.lit(1)).over(every)).cast("long"))
    t = t.withColumn("free", F.col("slots") - F.count(F.lit(1)).over(every))
    t = t.withColumn("quota", F.sqrt("n") * F.col("free") / F.sum(F.sqrt("n")).over(every))
    t = t.withColumn("floor", F.floor("quota"))
    t = t.withColumn("left", F.col("free") - F.sum("floor").over(every))
    order = Window.orderBy(F.col("floor") - F.col("quota"), "source")
    return t.select("source", "n", (1 + F.col("floor") + (F.row_number().over(order) <= F.col("left")).cast("int")).cast("long").alias("tickets"), "slots")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _earliest(row: DataFrame) -> DataFrame:
    """Adds ``plan`` to rows with ``s``, an array of (name, tickets), their sum ``slots`` and ``fold``: the name's place in s that each of so many slots goes to."""

    def choice(acc: Column, slot: Column) -> Column:
        slots = F.col("slots")
        due = lambda x, k: _div((acc["done"][k] + 1) * slots + x["tickets"] - 1, x["tickets"])
        options = F.transform("s", lambda x, k: F.struct(due(x, k).alias("due"), k.alias("k"), _div(acc["done"][k] * slots, x["tickets"]).alias("out")))
        return F.array_min(F.filter(options, lambda c: c["out"] <= slot))["k"]

    def put(acc: Column, slot: Column) -> Column:
        # the inner fold binds the choice, so that it is worked out once
        return F.aggregate(
            F.array(choice(acc, slot)),
            acc,
            lambda a, k: F.struct(F.transform(a["done"], lambda n, i: n + F.when(i == k, 1).otherwise(0).cast("long")).alias("done"), F.array_append(a["plan"], k).alias("plan")),
        )

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.expr("cast(array() as array<int>)").alias("plan"))
    return row.withColumn("plan", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("fold") - 1), start, put)["plan"])


def _places(row: DataFrame, *keys: str) -> DataFrame:
    """(keys, name, tickets, slots, places): each name's slots of the plan."""
    out = row.select(*keys, F.posexplode("s").alias("k", "x"), "slots", "plan")
    mine = F.filter(F.transform("plan", lambda p, i: F.when(p == F.col("k"), i)), lambda i: i.isNotNull())
    return out.select(*keys, "x.name", "x.tickets", "slots", mine.alias("places"))


def period(shares: DataFrame, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(source, tickets, slots, places): the slots that each source of any weight gets in one period, by earliest deadline first.

    If the period is longer than what the table fills, only that many slots are worked out.
    """
    live = materialize(shares.where("tickets > 0"))
    needed = (_div(F.col("n") + block - 1, F.lit(block)).cast("double") * F.col("slots") / F.col("tickets")).cast("long") + 2
    fold, k = live.agg(F.max(F.least("slots", needed)), F.count(F.lit(1))).first()
    if (fold or 0) > LONGEST and k <= wide:
        raise ValueError(f"the weights need a schedule of {fold} slots, more than {LONGEST}: give ratios of smaller whole numbers, or a larger block")
    listed = lambda df, *by: df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("name", "tickets"))).alias("s"), F.max("slots").alias("slots"), F.max("fold").alias("fold"))
    if k <= wide:
        row = listed(live.select(F.col("source").alias("name"), "tickets", "slots", F.lit(fold).cast("long").alias("fold")))
        return _places(_earliest(row.where("fold > 0"))).withColumnRenamed("name", "source")
    dealt = live.withColumn("bundle", (F.row_number().over(Window.orderBy(F.desc("tickets"), "source")) - 1) % wide)
    sums = materialize(dealt.groupBy("bundle").agg(F.sum("tickets").alias("tickets"), F.max("slots").alias("slots")))
    outer = _places(_earliest(listed(sums.select(F.col("bundle").alias("name"), "tickets", "slots", F.col("slots").alias("fold")))))
    inner = dealt.drop("slots").join(sums.select("bundle", F.col("tickets").alias("slots")), "bundle")
    inner = _places(_earliest(listed(inner.select("bundle", F.col("source").alias("name"), "tickets", "slots", F.col("slots").alias("fold")), "bundle")), "bundle")
    both = inner.drop("slots").join(outer.select(F.col("name").alias("bundle"), "slots", F.col("places").alias("outer")), "bundle")
    return both.select(F.col("name").alias("source"), "tickets", "slots", F.transform("places", lambda i: F.get("outer", i)).alias("places"))


def _ranked(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows (source, key, tie, ...) with rank, from 0 by key and tie in their source, and ``same``, the rank of the first of equal rows."""
    splits = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    # rows of these ids are the last of their range; they are numbered by ranges of the tie
    hot = sorted({FIRST, *(x for x, y in zip(splits, splits[1:]) if x == y)})
    splits = sorted({FIRST, *splits})
    within = F.size(F.filter(F.array(*map(F.lit, splits)), lambda x: x < F.col("key")))
    salt = F.when(F.col("key").isin(hot), F.shiftright("tie", 58)).otherwise(F.lit(-64).cast("long"))
    rows = rows.withColumn("part", F.struct(within.alias("range"), salt.alias("salt")))
    counts = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(counts.select("source", "part", before.alias("before")))
    by = Window.partitionBy("source", "part").orderBy("key", "tie")
    out = rows.withColumns({"rank": F.row_number().over(by).cast("long") - 1, "same": F.rank().over(by).cast("long") - 1}).join(small_side(parts), ["source", "part"])
    return out.withColumns({"rank": F.col("before") + F.col("rank"), "same": F.col("before") + F.col("same")}).drop("part", "before")


def schedule(counts: DataFrame, weights: dict | None = None, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """(source, tickets, slots, places, tail) from rows (source, n); ``tail`` is the first slot of a source of weight zero."""
    shares = materialize(tickets(counts, weights, slots))
    plan = period(shares, block)
    blocks = _div(F.col("n") + block - 1, F.lit(block))
    last = shares.where("tickets > 0").agg(F.max((blocks.cast("double") * F.col("slots") / F.col("tickets")).cast("long") + 2)).first()[0] or 0
    idle = shares.where("tickets = 0").withColumn("tail", last + F.coalesce(F.sum(blocks).over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return materialize(shares.select("source").join(plan, "source", "left").join(idle.select("source", "tail"), "source", "left"))


def _slots(rows: DataFrame, plan: DataFrame, block: int, source: str, names: tuple[str, str, str] = ("block", "slot", "place"), rank: str = "rank") -> DataFrame:
    """Adds block, slot and place to rows with a rank in their source."""
    own = [f"plan_{c}" for c in plan.columns]
    out = rows.join(small_side(plan.toDF(*own), 20_000), F.col(source) == F.col("plan_source")).withColumn(names[0], _div(F.col(rank), F.lit(block)))
    slot = _div(F.col(names[0]), F.col("plan_tickets")) * F.col("plan_slots") + F.get("plan_places", (F.col(names[0]) % F.col("plan_tickets")).cast("int"))
    out = out.withColumns({names[1]: F.coalesce(F.col("plan_tail") + F.col(names[0]), slot).cast("long"), names[2]: (F.col(rank) % block).cast("long")})
    return out.drop(*own)


def _source(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def mix(docs: DataFrame, weights: dict[str, float | int | Fraction] | None = None, doc_id: str = "doc_id", source: str = "source", slots: int = SLOTS, block: int = BLOCK, ranges: int = RANGES) -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, block, slot, place); in mixed order by slot and place.

    Within a source documents go by id, nulls first; rows that repeat
    an id follow each other. A null source is the source of the empty name. Sources that ``weights`` lacks, or
    gives zero, follow after all others, by name. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(_source(source).alias("source"), F.col(doc_id).cast("long").alias("doc_id"))
    rows = materialize(rows.withColumns({"key": F.coalesce("doc_id", F.lit(FIRST)), "tie": F.xxhash64(F.monotonically_increasing_id())}))
    plan = schedule(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), weights, slots, block)
    return _slots(_ranked(rows, ranges), plan, block, "source").select("doc_id", "source", "block", "slot", "place")


def in_mixed_order(docs: DataFrame, weights: dict[str, float | int | Fraction] | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their columns, laid out over ordered partitions in mixed order.

    The schedule is made from ids and sources alone. It tells with which document of each source a partition begins, so a
    row's partition follows from its own columns, and rows are moved once; their ranks in a partition then give their slots.
    Documents go by id, nulls first, and those without an id by a hash of their text. Rows of one source that repeat an id are in one partition.
    """
    src, key, tie, starts, piece, rank, block, slot, place = fresh(docs, "src", "key", "tie", "starts", "piece", "rank", "block", "slot", "place")
    known = docs.withColumns({src: _source(source), key: F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST))})
    unnamed = docs.where(F.col(doc_id).cast("long").isNull()).limit(1).count() > 0
    known = known.withColumn(tie, F.when(F.col(key) == FIRST, F.xxhash64(text)).otherwise(F.lit(0).cast("long")) if unnamed else F.lit(0).cast("long"))
    rows = materialize(known.select(F.col(src).alias("source"), F.col(key).alias("key"), F.col(tie).alias("tie")))
    plan = schedule(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), weights)
    order = materialize(_slots(_ranked(rows, RANGES), plan, BLOCK, "source"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = sorted(set(order.agg(F.percentile_approx("slot", [i / n for i in range(1, n)], 10_000)).first()[0] or []))
    nth = F.size(F.filter(F.array(*map(F.lit, splits)), lambda x: x <= F.col("slot"))) if splits else F.lit(0)
    first = order.groupBy("source", nth.alias("piece")).agg(F.min(F.struct("key", "tie", "same")).alias("k"))
    first = materialize(first.select("source", F.struct("k.key", "k.tie", "piece", "k.same").alias("start")))
    if first.limit(MANY + 1).count() <= MANY:
        listed = first.groupBy(F.col("source").alias("start_source")).agg(F.sort_array(F.collect_list("start")).alias(starts))
        moved = known.join(F.broadcast(listed), F.col(src) == F.col("start_source")).drop("start_source")
        mine = F.array_max(F.filter(starts, lambda s: (s["key"] < F.col(key)) | ((s["key"] == F.col(key)) & (s["tie"] <= F.col(tie)))))
        moved = moved.withColumn(starts, mine).withColumns({piece: F.col(starts)["piece"], rank: F.col(starts)["same"]}).drop(starts)
        moved = moved.repartitionById(n, F.col(piece))
        own = Window.partitionBy(piece, src).orderBy(key, tie)
        moved = _slots(moved.withColumn(rank, F.col(rank) + F.row_number().over(own) - 1), plan, BLOCK, src, (block, slot, place), rank)
    else:  # so many sources that their starts are no table to send around: the rows are joined with their slots
        at = order.groupBy(F.col("source").alias("start_source"), F.col("key").alias("start_key"), F.col("tie").alias("start_tie")).agg(F.min(F.struct("slot", "place", nth.alias("piece"))).alias(starts))
        moved = known.join(at, (F.col(src) == F.col("start_source")) & (F.col(key) == F.col("start_key")) & (F.col(tie) == F.col("start_tie")))
        moved = moved.withColumns({slot: F.col(starts)["slot"], place: F.col(starts)["place"], piece: F.col(starts)["piece"]}).repartitionById(n, F.col(piece))
    return moved.sortWithinPartitions(slot, place).select(*docs.columns)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_OP9 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source FROM documents
), c AS (
  SELECT source, count(*) AS n, count(*) OVER () AS k FROM d GROUP BY 1
), w AS (
  SELECT source, greatest({SLOTS}, 2 * k) AS slots, greatest({SLOTS}, 2 * k) - k AS free,
         sqrt(n) * (greatest({SLOTS}, 2 * k) - k) / sum(sqrt(n)) OVER () AS quota FROM c
), f AS (
  SELECT source, slots, quota, floor(quota) AS lower, free - sum(floor(quota)) OVER () AS spare FROM w
), t AS (
  SELECT source, slots, CAST(1 + lower + CASE WHEN row_number() OVER (ORDER BY lower - quota, source) <= spare THEN 1 ELSE 0 END AS BIGINT) AS tickets FROM f
), a AS (
  SELECT list(source ORDER BY source) AS names, list(tickets ORDER BY source) AS tickets, max(slots) AS slots FROM t
), s(slot, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform((SELECT tickets FROM a), lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT)
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda n, i: n + CASE WHEN i = chosen THEN 1 ELSE 0 END), chosen
  FROM (
    SELECT slot, done, slots, CAST(list_min(list_filter(list_transform(tickets, lambda x, i:
             {{'due': ((done[i] + 1) * slots + x - 1) // x, 'k': i, 'out': (done[i] * slots) // x}}), lambda o: o.out <= slot + 1)).k AS BIGINT) AS chosen
    FROM s, a WHERE slot + 1 < slots
  )
), p AS (
  SELECT names[pick] AS source, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS nth FROM s, a WHERE slot >= 0
), r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM d
)
SELECT doc_id, r.source, rank // {BLOCK} AS block,
       CAST((rank // {BLOCK}) // tickets * slots + p.slot AS BIGINT) AS slot, CAST(rank % {BLOCK} AS BIGINT) AS place
FROM r JOIN t USING (source) JOIN p ON p.source = r.source AND p.nth = (rank // {BLOCK}) % tickets
"""
