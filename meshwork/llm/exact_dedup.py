"""Exact dedup: a log-structured merge index over normalised digests.

Rows are dealt into memtables, which are flushed one after the other. A flush
combines the copies within its memtable and writes a *run*: parquet files
sorted by digest, with a Bloom filter beside them. Before a run joins the index, its
digests probe the filters of the runs that are there; what passes a filter is looked up
in that run. Digests found so, and those that a memtable holds twice, are *hits*.
When a level has FANOUT runs, they are compacted into one run of the next level,
which keeps, for each digest, the row to stay and the number of rows. At the end
the runs left are compacted into one, in which the hits are looked up. Digests that are no hit
belong to one row and are not looked up at all.

The bytes behind the hits are compared before any row is called a copy: distinct
texts of a digest are counted, salted and combined before the shuffle, so
a group that holds a third of all rows is spread over many tasks. No pairs are made.
Texts that differ under one digest are grouped by their bytes.

A filter is a table too: digests are dealt to shards of about KEYS digests, and a shard's
row holds its bits, PROBES for each digest. It is broadcast only if it is small.
What is shuffled is digests with two numbers, and once the texts of the hits.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.llm.columns import fresh
from meshwork.session import materialize, release, small_side, table

#: What normalisation deletes: space and the characters 9 to 13.
WHITE = " \t\n\x0b\f\r"
SALTS = 16
#: Runs of a level that are compacted into one of the next.
FANOUT = 2
#: Bits of a filter's shard (what ``bitmap_construct_agg`` gives), digests of a shard and bits of a digest: about 1 % pass by chance.
BITS, KEYS, PROBES = 8 * 4096, 3000, 4


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _beats(*, points: str = "points", key: str = "doc_id") -> Column:
    """An order in which the row that stays is the largest: most code points, then smallest id.

    The complement turns the order of ids round and, unlike the negative, exists for each of them.
    """
    return F.struct(F.col(points).alias("points"), F.bitwise_not(F.col(key)).alias("not_id"))  # a null is the least


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(-1)), F.lit(shards))


def _places() -> list[Column]:
    return [F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(BITS)) for k in range(PROBES)]


def _is_set(bits: Column, place: Column) -> Column:
    """Whether the bit at ``place`` of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), F.pmod(place, F.lit(8)).cast("int") + 1)) != 0


class Filter(NamedTuple):
    """A Bloom filter as rows (shard, bits)."""

    bits: DataFrame
    shards: int

    @classmethod
    def of(cls, digests: DataFrame) -> Filter:
        """The filter of a written table's digests."""
        shards = digests.count() // KEYS + 1
        places = digests.select(_shard(shards).alias("shard"), F.explode(F.array(*_places())).alias("place"))
        return cls(materialize(places.groupBy("shard").agg(F.bitmap_construct_agg("place").alias("bits"))), shards)

    def passing(self, rows: DataFrame) -> DataFrame:
        """The rows whose digest may be in the filter, which is broadcast up to 2,000 shards of 4 KB."""
        out = rows.withColumn("shard", _shard(self.shards)).join(small_side(self.bits, max_rows=2000), "shard")
        for place in _places():
            out = out.where(_is_set(F.col("bits"), place))
        return out.drop("shard", "bits")


class Run(NamedTuple):
    """Sorted rows (digest, n, best) and the filter of their digests."""

    rows: DataFrame
    filter: Filter


class MergeIndex:
    """Levels of runs in the shared folder, the newest first, and the hits that flushes found."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark = spark
        self.fanout = fanout
        self.levels: list[list[Run]] = []
        self.found: list[DataFrame] = []

    def flush(self, memtable: DataFrame) -> None:
        """Flush rows (digest, points, doc_id) as a sorted run, after its digests have probed the runs before."""
        run = self._write(memtable.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(_beats()).alias("best")))
        found = run.rows.where("n > 1").select("digest")
        for old in (r for level in self.levels for r in level):
            found = found.unionByName(self._lookup(run.rows.select("digest"), old))
        self.found.append(materialize(found.distinct()))
        self._add(run, 0)

    def hits(self) -> DataFrame:
        """Digests of more than one row, each once."""
        out = self.found[0]
        for more in self.found[1:]:
            out = out.unionByName(more)
        return out.distinct()

    def compact(self) -> DataFrame:
        """Merge the runs that are left: (digest, n, keep_points, keep_id), one row for each digest."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            self.levels = [[self._merge(runs)]]
            runs = self.levels[0]
        return runs[0].rows.select("digest", "n", F.col("best.points").alias("keep_points"), F.bitwise_not(F.col("best.not_id")).alias("keep_id"))

    def _lookup(self, digests: DataFrame, old: Run) -> DataFrame:
        """Those of ``digests`` that ``old`` has: few pass the filter beside them, and only these meet the run."""
        return old.filter.passing(digests).join(old.rows.select("digest"), "digest")

    def _add(self, run: Run, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._add(self._merge(runs), level + 1)

    def _merge(self, runs: list[Run]) -> Run:
        rows = runs[0].rows
        for r in runs[1:]:
            rows = rows.unionByName(r.rows)
        out = self._write(rows.groupBy("digest").agg(F.sum("n").alias("n"), F.max("best").alias("best")))
        for r in runs:
            release(r.rows, r.filter.bits)
        return out

    def _write(self, rows: DataFrame) -> Run:
        rows = materialize(rows, sort_by=["digest"])
        return Run(rows, Filter.of(rows.select("digest")))


def _verify(docs: DataFrame, hits: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests of ``hits`` behind which stand several different byte strings (none, unless the digest collides).

    Only texts that pass the filter of the hits move; those that pass by chance have no second text
    and change nothing. Salted by row, so that the texts of one digest meet in many tasks; each of
    these passes on one copy.
    """
    texts = docs.select(normalised(F.col(text)).alias("norm"), F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int").alias("salt"))
    met = Filter.of(hits).passing(texts.withColumn("digest", digest(F.col("norm"))))
    # combined before each shuffle: at most one text for each digest, salt and task
    distinct = met.select("digest", "salt", "norm").distinct().select("digest", "norm").distinct()
    return distinct.groupBy("digest").count().where("count > 1").select("digest")


def _copies(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, digest, points, times, n, keep_points, keep_id) as the result's; n is null where no other row has the digest."""
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")) & (F.col("copy") == 1)
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.coalesce(stays, F.lit(False))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _by_bytes(docs: DataFrame, bad: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The result's rows for the digests ``bad``, grouped by the texts themselves."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("norm"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("points"))
    rows = rows.withColumn("digest", digest(F.col("norm"))).join(bad, "digest", "left_semi")
    rows = rows.groupBy("digest", "norm", "doc_id", "points").agg(F.count(F.lit(1)).cast("int").alias("times"))
    groups = rows.groupBy("digest", "norm").agg(F.sum("times").alias("n"), F.max(_beats()).alias("best"))
    groups = groups.select("digest", "norm", "n", F.col("best.points").alias("keep_points"), F.bitwise_not(F.col("best.not_id")).alias("keep_id"))
    return _copies(rows.join(groups, ["digest", "norm"]))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memtables: int = 4, verify: bool = True, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical after every character of
    ``[\\x20\\x09-\\x0D]`` is deleted. Of equal texts the row with the most code
    points in its original text stays, then the one with the smallest id.
    Which of the ``memtables`` takes a row depends on its id alone.

    A null text counts as empty, and all empty texts are equal. Rows that
    repeat an id and a text are copies of each other like any others: each has
    its row in the result, and ``kept`` is true for one of them. A null id comes after
    all others. An empty
    table gives an empty result. Other columns are not read. ``digest`` gives the bytes by which
    texts meet and that the last column shows; texts that differ under one digest
    are grouped by their bytes instead.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        digest(normalised(F.col(text))).alias("digest"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(memtables)).cast("int").alias("memtable"),
    )
    keyed = materialize(keyed, sort_by=["memtable"])  # so that a memtable's rows lie together
    index = MergeIndex(spark)
    for k in range(memtables):
        index.flush(keyed.where(F.col("memtable") == k))
    hits = materialize(index.hits())
    release(*index.found)
    groups = materialize(index.compact().join(hits, "digest"))
    # rows that repeat (id, text) are told apart by a number, so that one of them stays
    rows = keyed.groupBy("digest", "doc_id", "points").agg(F.count(F.lit(1)).cast("int").alias("times"))
    out = _copies(rows.join(groups, "digest", "left"))
    if verify:
        bad = materialize(_verify(docs, hits, text, doc_id, digest))
        if bad.limit(1).count():
            kept = rows.join(bad, "digest", "left_anti").join(groups, "digest", "left")
            return _copies(kept).unionByName(_by_bytes(docs, bad, text, doc_id, digest))
        release(bad)
    return out


def keep_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their columns, whatever these are named.

    Of rows that repeat id and text, one stays.
    """
    decided = materialize(exact_dedup(docs, doc_id, text))
    dropped = decided.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay")).where("stay < n")
    digest, gone_id, gone, nth = fresh(docs, "digest", "gone_id", "gone", "nth")
    dropped = materialize(dropped.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone), "stay"))
    out = docs.withColumn(digest, F.sha2(normalised(F.col(text)), 256))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone))
    kept = out.join(small_side(dropped.drop("stay")), same, "left_anti").select(*docs.columns)
    again = dropped.where("stay > 0").drop("stay")
    if again.limit(1).count():  # rows that repeat an id as well; the one with the longest text of them stays
        first = Window.partitionBy(F.col(doc_id).cast("long"), digest).orderBy(F.char_length(F.col(text)).desc(), F.col(text))
        ones = out.join(small_side(again), same, "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
        kept = kept.unionByName(ones.select(*docs.columns))
    return kept


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_OP7 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
