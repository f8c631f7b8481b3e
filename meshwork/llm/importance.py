"""Quality by importance resampling.

Two generative models of hashed n-grams (bags of byte n-grams in BUCKETS
buckets, with additive smoothing) are counted: one of the target texts, one of all raw
texts. A document's log weight is the sum over its n-grams of the log ratio of the two;
sums over more than UNIT n-grams are scaled down to UNIT, so that length alone decides nothing. With
Gumbel noise added, the k largest are a sample without replacement in proportion to
the weights.

The raw model counts every byte of every document. The target model may be
fitted on a bounded sample of the labelled rows (``max_targets``). What goes to the driver is one count per
bucket. The k-th largest key is found exactly by histograms that narrow down, so no global
sort and no list of keys is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.session import materialize, table

BUCKETS = 1 << 14
#: Lengths of the byte n-grams.
GRAMS = (2, 4)
UNIT = 256
SMOOTHING = 1.0
#: The most labelled documents that the target model is fitted on; those with the smallest hashes of their ids.
MAX_TARGETS = 20_000
SEED = 20
#: Bytes of texts that are turned to n-grams at a time.
BLOCK = 1 << 22
#: Rows among which the k-th key is looked up on the driver.
NARROW = 4096


def grams_of(data: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram of some bytes, overlapping, shortest n first."""
    out = []
    for n in GRAMS:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, np.uint32)
            for j in range(n):
                h *= np.uint32(0x01000193)
                h ^= data[j : len(data) - n + 1 + j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append((h >> np.uint32(18)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _blocks(text: str | None) -> Iterator[np.ndarray]:
    """The n-grams of a text in blocks; a block starts before the last one's end, so that none is lost."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if len(data) <= BLOCK:
        yield grams_of(data)
        return
    for n in GRAMS:
        for at in range(0, len(data) - n + 1, BLOCK):
            part = data[at : at + BLOCK + n - 1]
            found = grams_of(part)
            skip = sum(max(len(part) - m + 1, 0) for m in GRAMS if m < n)
            yield found[skip : skip + len(part) - n + 1]


def _counts(targets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                hit = False
                if doc_id is not None and len(targets):
                    at = np.searchsorted(targets, doc_id)
                    hit = at < len(targets) and targets[at] == doc_id
                for g in _blocks(t.as_py()):
                    c = np.bincount(g, minlength=BUCKETS) if len(g) > BUCKETS // 8 else None
                    for into in (raw, target) if hit else (raw,):
                        if c is None:
                            np.add.at(into, g, 1)
                        else:
                            into += c
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return run


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket; zero if there is no target."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def noise(doc_id: int | None) -> float:
    """Standard Gumbel noise that depends on the id alone."""
    import xxhash

    u = (xxhash.xxh64_intdigest(str(doc_id), SEED) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def _scores(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = []
            for t in b.column(1):
                total, n = 0.0, 0
                for g in _blocks(t.as_py()):
                    total, n = total + float(ratio[g].sum()), n + len(g)
                weights.append(total * UNIT / max(n, UNIT))
            keys = [w + noise(d) for w, d in zip(weights, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights, pa.float64()), pa.array(keys, pa.float64())], ["doc_id", "log_weight", "key"])

    return run


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of the column ``key``, exactly; None if there are fewer than k rows."""
    row = keys.agg(F.count("key"), F.min("key"), F.max("key")).first()
    n, low, high = row
    if k <= 0 or n < k:
        return None
    above = 0  # rows over ``high``
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        if low == high:
            return low
        if n <= NARROW:
            return sorted((r[0] for r in inside.select("key").collect()), reverse=True)[k - above - 1]
        width = (high - low) / 1024
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).alias("at") if width > 0 else F.lit(0).alias("at")
        found = inside.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("at")).collect()
        for f in found:
            if above + f["n"] >= k:
                n, low, high = f["n"], f["low"], f["high"]
                break
            above += f["n"]
        if len(found) == 1 and n > NARROW:  # as narrow as floating point gets
            below = inside.groupBy("key").count().orderBy(F.desc("key"))
            for r in below.toLocalIterator():
                above += r["count"]
                if above >= k:
                    return r["key"]


def resample(docs: DataFrame, good: DataFrame, share: float, doc_id: str = "doc_id", text: str = "text", max_targets: int = MAX_TARGETS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, log_weight, key, kept).

    ``good`` has the ids (doc_id) of target documents; at most ``max_targets`` of them are used. ``share`` is
    the part of the rows to keep: k = round(share x rows). Rows whose key equals the
    k-th largest are all kept, so that repeated rows, which get equal keys, stay or
    go together. A null or empty text has weight zero in logarithm. Rows without an id share one noise. Without a target all
    weights are equal. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # a bounded number of ids, and as many numbers on each machine
    ids = good.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_targets).collect()
    targets = np.sort(np.array([r[0] for r in ids], np.int64))
    counts = rows.mapInArrow(_counts(targets), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # one row per bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    scored = materialize(rows.mapInArrow(_scores(log_ratio(raw, target)), "doc_id long, log_weight double, key double"))
    limit = kth_largest(scored, round(share * scored.count()))
    return scored.withColumn("kept", F.lit(False) if limit is None else F.col("key") >= limit)


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, log_weight, key, kept). The target are the labelled documents of quality 1 that aren't toxic; the part of all documents that is kept is that of quality 1 among the labelled."""
    labels = table(spark, sf_dir, "labels")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return resample(table(spark, sf_dir, "documents"), labels.where(good), 0.5 if share is None else share)
