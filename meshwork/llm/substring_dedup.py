"""Substring dedup by seed and extend.

Seeds: each document's runs of SEED words are hashed and winnowed, so that
every window of ``length`` words holds at least one anchor, chosen by the window's
content alone. Documents are joined on their anchors: only an anchor
that stands at two places can lie in a repeat. Extension: around each such
anchor, the windows that chose it, up to ``length`` - SEED words to either side, are compared
with the other places of the anchor; those that are not the earliest of
their kind are repeats, and runs of them are the maximal repeats.

Pairs of documents are never made. "The earliest of its kind" is a minimum per
window content, combined before the shuffle and joined back, so that a passage that a third of all documents
share costs one row per place. Documents that are wholly equal to an earlier
one are set aside first, by digest; their every window starts earlier there.

Texts are shuffled three times, narrow rows otherwise; each step is written to
the shared folder and the shuffle files before it are freed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.session import free_shuffles, materialize, release, table

LENGTH = 20
#: Words of a seed.
SEED = 8
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than the six ASCII spaces."""
    return (text or "").encode().split()


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def tag_of(digest: bytes) -> int:
    """Tells apart the texts of rows that share an id."""
    return int.from_bytes(digest[:2], "little")


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """A mixed polynomial hash of each run of ``length`` words."""
    n = len(hashes) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(length):
            out *= np.uint64(base)
            out += hashes[j : j + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def anchors(hashes: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(seed hashes, for each window the position of the seed it chooses)."""
    seeds = run_hashes(hashes, seed, BASES[0])
    if len(hashes) < length:
        return seeds, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(seeds, length - seed + 1)
    return seeds, np.arange(len(view)) + view.argmin(axis=1)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, counts = [], []
        for t in b.column(1):
            words = words_of(t.as_py())
            digests.append(digest_of(words))
            counts.append(len(words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["doc_id", "digest", "n_words"])


def _seeds(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values, places = b.column(0).to_pylist(), [], []
            for t in b.column(1):
                seeds, chosen = anchors(word_hashes(words_of(t.as_py())), length, seed)
                at = np.unique(chosen)
                values.append(seeds[at])
                places.append(at)
            n = [len(p) for p in places]
            doc = np.repeat(np.array(ids, np.int64), n) if ids else np.zeros(0, np.int64)
            columns = [pa.array(np.concatenate(values or [np.zeros(0, np.uint64)]).view(np.int64)), pa.array(doc), pa.array(np.concatenate(places or [np.zeros(0, np.int64)]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "place"])

    return run


def _windows(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, first, docs, packed = b.column(0).to_pylist(), [], [], []
            for i, t in enumerate(b.column(1)):
                words = words_of(t.as_py())
                hashes = word_hashes(words)
                _, chosen = anchors(hashes, length, seed)
                starts = np.flatnonzero(np.isin(chosen, b.column(2)[i].values.to_numpy()))
                if len(starts):
                    first.append(run_hashes(hashes, length, BASES[0])[starts])
                    check = (run_hashes(hashes, length, BASES[1])[starts] >> np.uint64(48)).astype(np.int64)
                    docs.append(np.full(len(starts), ids[i], np.int64))
                    packed.append(starts.astype(np.int64) << 32 | check << 16 | tag_of(digest_of(words)))
            if docs:
                columns = [np.concatenate(first).view(np.int64), np.concatenate(docs), np.concatenate(packed)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "doc_id", "packed"])

    return run


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n words lie in a window with one of these starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0


def _spans(batches: Iterator[pa.RecordBatch], length: int, emit):
    for b in batches:
        rows = []
        for doc_id, text, found in zip(b.column(0), b.column(1), b.column(2)):
            words = words_of(text.as_py())
            hit = np.zeros(len(words), bool)
            if found.is_valid:
                tag = tag_of(digest_of(words))
                for f in found.as_py():
                    if f["tag"] == tag:
                        starts = np.array(f["starts"], np.int64)
                        starts = starts[starts + length <= len(words)]
                        hit |= True if f["copy"] else covered(starts, len(words), length)
            rows.extend(emit(doc_id.as_py(), words, hit))
        yield rows


def _removed(length: int):
    def emit(doc_id, words, hit):
        keep = b" ".join(w for w, h in zip(words, hit) if not h) if hit.any() else b" ".join(words)
        return [(doc_id, len(words), int(hit.sum()), hashlib.sha256(keep).hexdigest(), keep.decode())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _spans(batches, length, emit):
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, found): for each document with repeats, structs (tag, copy, starts).

    ``starts`` are the windows of ``length`` words whose words also start earlier; runs of
    them are the maximal repeats. ``copy`` marks a text that is
    whole the text of a smaller id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    summary = materialize(rows.mapInArrow(_summaries, "doc_id long, digest binary, n_words long").where(F.col("n_words") >= length))
    first = summary.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marked = summary.distinct().join(first, "digest").select("doc_id", "digest", (F.col("doc_id") > F.col("first_id")).alias("copy"))
    marked = materialize(marked)
    # a document that is the first of its text is read for seeds
    own = rows.join(marked.where("not copy").select("doc_id").distinct(), "doc_id", "left_semi")
    places = own.mapInArrow(_seeds(length, seed), "anchor long, doc_id long, place int")
    places = materialize(places)
    free_shuffles(spark)
    # what a join meets is written first: AQE splits a hot key only where both sides come straight from a shuffle
    common = materialize(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    free_shuffles(spark)
    seeds = places.join(common, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    seeds = materialize(seeds)
    release(places, common)
    free_shuffles(spark)
    windows = rows.join(seeds, "doc_id").select("doc_id", "text", "places").mapInArrow(_windows(length, seed), "hash long, doc_id long, packed long")
    stored = windows = materialize(windows)
    release(seeds)
    free_shuffles(spark)
    # start, 16 more bits of the content's hash and the text's tag in one number keep the rows narrow
    windows = windows.withColumn("check", F.shiftright("packed", 16).bitwiseAND(F.lit(0xFFFF)).cast("int"))
    start = F.shiftright("packed", 32)
    earliest = windows.groupBy("hash", "check").agg(F.min(F.struct("doc_id", start.alias("start"))).alias("earliest"), F.count(F.lit(1)).alias("n"))
    earliest = materialize(earliest.where("n > 1").drop("n"))
    free_shuffles(spark)
    later = windows.join(earliest, ["hash", "check"]).where(F.struct("doc_id", start.alias("start")) > F.col("earliest"))
    tag = F.col("packed").bitwiseAND(F.lit(0xFFFF)).cast("int")
    found = later.groupBy("doc_id", tag.alias("tag")).agg(F.collect_list(start).alias("starts")).withColumn("copy", F.lit(False))
    low = F.conv(F.hex(F.substring("digest", 2, 1)), 16, 10).cast("int") * 256 + F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int")
    copies = marked.where("copy").select("doc_id", low.alias("tag"), F.expr("cast(array() as array<bigint>)").alias("starts"), F.lit(True).alias("copy"))
    found = found.unionByName(copies).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "copy", "starts")).alias("found"))
    found = materialize(found)
    release(stored, earliest, marked, summary)
    free_shuffles(spark)
    return found


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_removed, kept_sha256, kept_text).

    Each word is removed that lies in a window of ``length`` words whose words also
    start earlier: in a smaller id, or earlier in the same document. Windows are
    judged on the input. A null text has no words. Rows that repeat an id and a
    text are one document and get the same result; rows that share an id but
    not a text are documents at the same place in the order. Rows without an id have no
    place in the order: they stay whole and remove nothing. An empty table gives an empty result. Other columns are not read.
    """
    found = repeats(docs, doc_id, text, length, seed)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.join(found, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(_removed(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")
