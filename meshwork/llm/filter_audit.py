"""How filters interact: what each removes, repeats or alone finds, in every order in which they can be applied.

A document's failures are a mask of five bits. Four depend on its text alone and are found in one scan, with the XXH64 fingerprint of the
text. For the fifth, copies of texts with smaller ids, only rows whose fingerprint several ids have need their texts: they are routed by
fingerprint as an RDD. Within a buffer, then within a partition, chains of the texts under one
fingerprint hold each text in full with its smallest id, and the rows with other ids are emitted as copies. What a buffer has already found
to be a copy goes on without its text, so that a text that fills a third of the table meets its partition only once a buffer.
A partition is sorted by fingerprint and id, by a sort that spills, so only the texts of one fingerprint are held at once.

The masks are then counted by part of the corpus and label: ``combineByKey`` merges vectors of counts, and all
figures of all orders are sums over such a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from meshwork.session import materialize, small_side, table

FILTERS = "ABCDE"
COPY = 16
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
#: Bytes of texts whose chains a task holds before it routes them.
BUFFER = 32 << 20
#: Spreads the ids of rows that need no comparison over the partitions.
ODD = 0x9E3779B97F4A7C15
LABELS = 4
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(raw: bytes, n_chars: int) -> int:
    """Failures of A (few words), B (few distinct words), C (capitals) and D (symbols) as bits 1, 2, 4 and 8."""
    words = raw.split()  # bytes: only the six ASCII spaces separate
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, UPPER))
    return (n < 50) + 2 * (100 * len(set(words)) < 65 * n) + 4 * (100 * capitals > 5 * n_chars) + 8 * (len(raw.translate(None, SYMBOLS)) < len(raw))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(3).to_pylist()
        found = pa.array([text_mask(t.encode(), len(t)) for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], found], ["doc_id", "part", "fingerprint", "mask"])


def _route(rows: Iterator[Row]) -> Iterator[tuple]:
    """((fingerprint, whether to compare, id), (id, part, mask, text)): copies of a row of the same buffer go without text."""
    chains: dict[int, list[list]] = {}
    held = 0

    def decided(doc_id: int, part: str, mask: int) -> tuple:
        return (doc_id * ODD % (1 << 64), 0, 0), (doc_id, part, mask | COPY, None)

    def flush() -> Iterator[tuple]:
        for fingerprint, chain in chains.items():
            for text, smallest, mask, parts in chain:
                for part in parts:
                    yield (fingerprint, 1, smallest), (smallest, part, mask, text)
        chains.clear()

    for doc_id, part, fingerprint, text in rows:
        chain = chains.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            raw = text.encode()
            chain.append([text, doc_id, text_mask(raw, len(text)), [part]])
            held += len(raw) + 200
        elif doc_id > entry[1]:
            yield decided(doc_id, part, entry[2])
        elif doc_id == entry[1]:
            entry[3].append(part)
        else:
            for other in entry[3]:
                yield decided(entry[1], other, entry[2])
            entry[1], entry[3] = doc_id, [part]
        if held > BUFFER:
            yield from flush()
            held = 0
    yield from flush()


def _decide(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, part, mask) of rows in the order of fingerprints and ids."""
    at, chain = None, []
    for (fingerprint, compare, doc_id), (own, part, mask, text) in rows:
        if compare:
            if fingerprint != at:
                at, chain = fingerprint, []
            smallest = next((i for t, i in chain if t == text), None)
            if smallest is None:
                chain.append((text, doc_id))
            elif doc_id > smallest:
                mask |= COPY
        yield own, part, mask


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row; bit 16 marks a text that a row with a smaller id has, too.

    A null text or part counts as empty. Rows with the same id and text are no copies of each other, but all are if a smaller id has
    that text. A row without an id is no copy, and none is a copy of it. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.xxhash64("text").alias("fingerprint"), "text")
    scanned = materialize(rows.mapInArrow(_masks, "doc_id long, part string, fingerprint long, mask int"))
    ids = scanned.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = small_side(materialize(ids.where("low < high").select("fingerprint")), 1_000_000)
    alone = scanned.join(shared, "fingerprint", "left_anti").unionByName(scanned.where("doc_id is null").join(shared, "fingerprint", "left_semi")).select("doc_id", "part", "mask")
    compared = rows.where("doc_id is not null").join(shared, "fingerprint", "left_semi").select("doc_id", "part", "fingerprint", "text").rdd
    parts = max(compared.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = compared.mapPartitions(_route).repartitionAndSortWithinPartitions(parts, lambda key: key[0])
    return alone.unionByName(spark.createDataFrame(routed.mapPartitions(_decide), "doc_id long, part string, mask int", verifySchema=False))


def mask_counts(masked: DataFrame, labels: DataFrame) -> RDD:
    """(part, vector): rows by mask and label, at place 4 x mask + 2 x good + toxic.

    A document is good (toxic) if a row of ``labels`` with its id says quality = 1 (toxic = 1).
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 2).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    place = F.col("mask") * LABELS + F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))
    placed = masked.join(said, "doc_id", "left").select("part", place.alias("place")).rdd.map(tuple)

    def add(vector: np.ndarray, place: int) -> np.ndarray:
        vector[place] += 1
        return vector

    return placed.combineByKey(lambda place: add(np.zeros(LABELS << len(FILTERS), np.int64), place), add, lambda a, b: a + b)


@cache
def orders() -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
    """(order, step) pairs; which masks are kept, removed, redundant and unique there (4 x steps x masks); the filter of each step."""
    steps, which, letters = [], [[], [], [], []], []
    every = range(1 << len(FILTERS))
    for order in permutations(range(len(FILTERS))):
        earlier = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            steps.append(("".join(FILTERS[i] for i in order), step))
            letters.append(f)
            which[0].append([not m & (earlier | bit) for m in every])
            which[1].append([bool(m & bit) and not m & earlier for m in every])
            which[2].append([bool(m & bit) and bool(m & earlier) for m in every])
            which[3].append([m == bit for m in every])
            earlier |= bit
    return steps, np.array(which, np.int64), np.array(letters)


def _figures(counted: tuple[str, np.ndarray]) -> Iterator[tuple]:
    part, vector = counted
    steps, which, letters = orders()
    by = vector.reshape(-1, 2, 2)
    kept, removed, redundant, unique = which @ by.sum(axis=(1, 2))
    good, toxic = which[1] @ by[:, 1, :].sum(axis=1), which[1] @ by[:, :, 1].sum(axis=1)
    shapley = np.bincount(letters, weights=removed, minlength=len(FILTERS)).astype(np.int64) if len(removed) else removed
    for i, (order, step) in enumerate(steps):
        yield part, order, step, *(int(x[i]) for x in (kept, removed, redundant, unique, good, toxic)), int(shapley[letters[i]])


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents of the part.

    Nulls, ties, repeated rows and other columns are as in ``masks``; an empty table gives an empty result, and empty
    labels say nothing of any document.
    """
    found = mask_counts(masks(docs, doc_id, text, part), labels).flatMap(_figures)
    return docs.sparkSession.createDataFrame(found, AUDIT, verifySchema=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over every document, in all 120 orders, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
m AS (SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a JOIN f b ON b.letter <> a.letter JOIN f c ON c.letter NOT IN (a.letter, b.letter) JOIN f d ON d.letter NOT IN (a.letter, b.letter, c.letter)
    JOIN f e ON e.letter NOT IN (a.letter, b.letter, c.letter, d.letter)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, range(1, 6) AS r(step)),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
