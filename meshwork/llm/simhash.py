"""SimHash near-dedup with Golay-code fuzzy keys.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles. Equal fingerprints are one node. To find all pairs that
differ in at most two bits, the 64 bits are cut into three segments, each padded
to the 23 bits of the perfect binary Golay code. A segment's keys are the indices of
the codewords within distance 4: one if a codeword lies within 2, else six. Two
segments that differ in up to two bits have a word within distance 1 of both, and
the codeword nearest to that word is a key of both. Two errors leave at least one of three
segments without error (pigeonhole), and the segment after it has at most two; so the
exact bits of one segment with a Golay index of the next make a key of about 34 bits that every
link shares. Candidates that share a key are verified.

Buckets up to CAP fingerprints are compared within a task, which returns not the pairs but a
star per connected group. For larger buckets there is an exact way: each of their
fingerprints goes to the 65 words within distance 1. Two fingerprints that meet at a word differ
by at most two bits, and at most 65 can meet, so that groups stay small whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.columns import fresh
from meshwork.operators.components import connected_components
from meshwork.session import free_shuffles, materialize, release, small_side, table

SEED = 42
#: Bits of the three segments.
SEGMENTS = (22, 21, 21)
#: The largest bucket whose pairs are compared.
CAP = 1024
#: Hashes turned to bits at a time.
BLOCK = 1 << 15
#: Words of a shingle and Jaccard similarity of near copies.
NEAR_WIDTH = 5
SIMILARITY = 0.8
#: An odd multiplier for the words of a shingle, and shifts and odd factors that mix a hash.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53))
#: Hash buckets whose shingles are counted, and most bits of a parity bitmap.
COUNTED = 1 << 20
PARITIES = 1 << 17
#: Members of a bucket that are compared with each other or with another such block in one task.
NEAR_BLOCK = 512
#: Pairs of a row that a list of rows yields at first.
MOST = 2


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint; without words zero, with fewer than ``width`` words that of the whole sequence."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only the six ASCII spaces separate
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    hashes = np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))), np.uint64, len(words) - width + 1)
    return majority(hashes) & ((1 << 64) - 1)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long of the same bits."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: six error words (23 bits), how many of them count, and the syndrome of each high byte pattern.

    The code is the cyclic one of x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 in systematic
    form, so that a codeword's index is its upper 12 bits.
    """
    poly = 0b101011100011
    syndromes = np.arange(1 << 23, dtype=np.int32)
    for bit in range(22, 10, -1):
        syndromes ^= ((syndromes >> bit) & 1) * (poly << (bit - 11))
    errors = np.zeros((2048, 6), np.int32)
    counts = np.zeros(2048, np.int32)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = syndromes[e]
            if weight < 4 or (errors[s, 0] and bin(errors[s, 0]).count("1") == 3):
                errors[s, counts[s]] = e
                counts[s] += 1
    return errors, counts, syndromes.astype(np.int16)


def golay_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices within distance 4 of each 23-bit word, as (positions in ``word``, indices)."""
    errors, counts, syndromes = golay()
    s = syndromes[word]
    at = np.repeat(np.arange(len(word)), counts[s])
    first = np.cumsum(counts[s]) - counts[s]
    which = np.arange(len(at)) - first[at]
    return at, (word[at] ^ errors[s[at], which]) >> 11


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in fp, keys): the keys that any two fingerprints with at most two different bits share."""
    u, segments, at = fp.view(np.uint64), [], 0
    for bits in SEGMENTS:
        segments.append(((u >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    rows, keys = [], []
    for i in range(3):
        pos, index = golay_keys(segments[(i + 1) % 3])
        rows.append(pos)
        keys.append((i << 36) | (segments[i][pos] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        rows, keys = bucket_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])


def star_links(fps: np.ndarray, distance: int = 2) -> list[tuple[int, int]]:
    """Links from each fingerprint to the first of its connected group, over pairs with at most so many different bits."""
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= distance
    group = np.full(len(fps), -1)
    for i in range(len(fps)):
        if group[i] < 0:
            reach = np.zeros(len(fps), bool)
            reach[i], edge = True, np.array([i])
            while len(edge):
                edge = np.flatnonzero(near[edge].any(axis=0) & ~reach)
                reach[edge] = True
            group[reach] = i
    return [(int(fps[i]), int(fps[g])) for i, g in enumerate(group) if g != i]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        links = [x for m in b.column(0) for x in star_links(np.array(m.as_py(), np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """(u, v): edges between distinct fingerprints whose components are those of all pairs within two bits."""
    keyed = fps.mapInArrow(_keyed, "key long, fp long")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts)
    near = keyed.join(counts.where(F.col("n") <= cap).select("key"), "key", "left_semi")
    buckets = near.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    # the same few fingerprints mostly meet under several keys
    found = buckets.select("fps").distinct().mapInArrow(_verify, "u long, v long")
    hot_keys = counts.where(F.col("n") > cap).select("key")
    if hot_keys.limit(1).count():
        hot = keyed.join(small_side(hot_keys), "key", "left_semi").select("fp").distinct()
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        met = hot.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("word"))
        stars = met.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        stars = stars.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v")
        found = found.unionByName(stars.select("u", "v"))
    return found.distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fingerprint, component_id).

    Rows whose fingerprints differ in at most two bits are linked, and
    component_id is the smallest doc_id reachable. Texts that are null or without words have
    fingerprint zero and are linked like any others. Repeated rows have a row each.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, doc_id, text, width))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = connected_components(links(nodes.select("fp"), cap))
    nodes = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    nodes = materialize(nodes)
    roots = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(roots, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = NEAR_WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one shingle, none the hash of the empty text.

    Each word is hashed once; a shingle's hash is a polynomial in its words' hashes, mixed.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(own) - width + 1)
    h = np.full(n, len(own) if len(own) < width else width, np.uint64)
    for k in range(min(width, len(own))):
        h = h * MULTIPLIER + own[k : k + n]
    for shift, factor in MIX:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(h ^ (h >> np.uint64(32)))


def majority(hashes: np.ndarray) -> int:
    """The bits, as a signed long, that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(total, (shingle_set(t.as_py(), width) % np.uint64(COUNTED)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles by rarity, of which two sets of this similarity share one at least.

    With n shingles a partner has at least ``similarity`` * n of them. Were none of the first
    n - ceil(similarity * n) + 1 of each set shared, too few would be left in one of them. This holds for
    any order that is the same for all sets.
    """
    order = np.lexsort((hashes, counts[(hashes % np.uint64(COUNTED)).astype(np.int64)]))
    return hashes[order[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]]


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes falls on each bit: two sets have as many unshared hashes as differing bits, or more.

    There are one to two bits for each hash, 64 at least and ``PARITIES`` at most.
    """
    bits = min(PARITIES, max(64, 1 << (len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def halved(bits: np.ndarray) -> np.ndarray:
    """The bitmaps of half as many bits."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def narrowed(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[-1] > width:
        bits = halved(bits)
    return bits


def _sketches(width: int, counts: np.ndarray, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                sets = [shingle_set(t.as_py(), width) for t in b.column(2)]
                first = [prefix(s, counts, similarity).view(np.int64) for s in sets]
                longs = pa.list_(pa.int64())
                columns = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, longs), pa.array([parity(s).tobytes() for s in sets], pa.binary()), pa.array([majority(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "size", "first", "bits", "fp"])

    return run


def _sets(width: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), width) for t in b.column(2)]
            packed = pa.array([x.tobytes() for x in found], pa.binary()) if kind == "binary" else pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["id", "digest", "s"])

    return run


def _unshared(similarity: float) -> float:
    """The largest share of the two sizes' sum that can be unshared at this similarity; rounding only lets more pairs through."""
    return (1 - similarity) / (1 + similarity) + 1e-9


def _candidates(rows: list[dict], share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a list, the rows after it (or on the other side) of other parts that may be links by sizes and bitmaps, and how far apart."""
    side, ids, part, n = (np.array([r[k] for r in rows], np.int64) for k in ("side", "nid", "part", "size"))
    bits = [np.frombuffer(r["bits"], np.uint64) for r in rows]
    wide = np.array([len(x) for x in bits])
    for w in np.unique(wide):
        # bitmaps of this width meet each other and, narrowed, the wider ones
        level = np.flatnonzero(wide >= w)
        level = level[n[level] * (1 - share) <= n[wide == w].max() * (1 + share) + 1]
        matrix = np.stack([narrowed(bits[i], w) for i in level])
        for row, i in enumerate(level):
            later = side[level] > side[i] if side.any() else ids[level] > ids[i]
            here = (wide[level] == w) | (wide[i] == w)
            at = np.flatnonzero(later & here & (part[level] != part[i]) & (np.abs(n[level] - n[i]) <= share * (n[level] + n[i])))
            apart = np.bitwise_count(matrix[at] ^ matrix[row]).sum(axis=1) / (n[level[at]] + n[i])
            if (apart <= share).any():
                yield int(i), level[at][apart <= share], apart[apart <= share]


def _cross(share: float, most: int):
    """Of each row of a list the ``most`` likeliest pairs, and whether there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, members in zip(batch.column(0), batch.column(1)):
                rows = members.as_py()
                for i, others, apart in _candidates(rows, share):
                    for x in others[np.argsort(apart, kind="stable")[:most]]:
                        u, v = sorted((rows[i]["nid"], rows[x]["nid"]))
                        found.append((name.as_py(), u, v, len(others) > most))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[3] for f in found], pa.bool_())], ["list", "u", "v", "more"])

    return run


def _open(share: float):
    """The rows of each list that may have links to rows of other parts by sizes and bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, members in zip(batch.column(0), batch.column(1)):
                rows, at = members.as_py(), set()
                for i, others, _ in _candidates(rows, share):
                    at.add(i)
                    at.update(others.tolist())
                found += [(name.as_py(), *(rows[i][k] for k in ("side", "nid", "part", "size"))) for i in sorted(at)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(5)], ["list", "side", "nid", "part", "size"])

    return run


def _joined(share: float, similarity: float):
    """Links that join the parts of a list, found by comparing all its candidates: one less than the parts at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for members in batch.column(0):
                rows = members.as_py()
                sets = [np.frombuffer(r["s"], np.uint64) for r in rows]
                for r, x in zip(rows, sets):
                    r["bits"] = parity(x).tobytes()
                root = {r["part"]: r["part"] for r in rows}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for i, others, _ in _candidates(rows, share):
                    for x in others:
                        a, b = find(rows[i]["part"]), find(rows[x]["part"])
                        if a != b:
                            both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                            if both >= similarity * (len(sets[i]) + len(sets[x]) - both):
                                root[max(a, b)] = min(a, b)
                                found.append(sorted((rows[i]["nid"], rows[x]["nid"])))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["u", "v"])

    return run


def _sets_of(nodes: DataFrame, docs: DataFrame, names: DataFrame, width: int, kind: str = "array<long>") -> DataFrame:
    """(nid, s): the shingle sets of the nodes, of texts that are read again; as longs or as their bytes."""
    involved = materialize(nodes.select("nid").distinct().join(names, "nid"))
    texts = docs.join(small_side(involved.select("id", "digest").distinct()), ["id", "digest"], "left_semi")
    own = materialize(texts.select("id", "digest", "text").mapInArrow(_sets(width, kind), f"id long, digest binary, s {kind}"))
    out = materialize(own.dropDuplicates(["id", "digest"]).join(involved, ["id", "digest"]).select("nid", "s"))
    release(involved, own)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets have at least this Jaccard similarity; ``names`` tells a node's row."""
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("nid")), docs, names, width)
    first = materialize(pairs.join(sets.select(F.col("nid").alias("v"), F.col("s").alias("sv")), "v"))
    both = first.join(sets.select(F.col("nid").alias("u"), F.col("s").alias("su")), "u")
    shared = F.size(F.array_intersect("su", "sv"))
    kept = materialize(both.where(shared >= F.lit(similarity) * (F.size("su") + F.size("sv") - shared)).select("u", "v").distinct())
    release(sets, first)
    free_shuffles(docs.sparkSession)
    return kept


def _near_bits(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keep = b.column(2).to_numpy() + b.column(3).to_numpy(), []
            for x, y, both in zip(b.column(4), b.column(5), n):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                w = min(len(x), len(y))
                keep.append(int(np.bitwise_count(narrowed(x, w) ^ narrowed(y, w)).sum()) <= share * both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(pairs: DataFrame, sketches: DataFrame, share: float) -> DataFrame:
    """The pairs (u, v) whose sizes and parity bitmaps leave room for the similarity."""
    own = lambda c, k: sketches.select(F.col("nid").alias(c), F.col("size").alias(f"n{k}"), F.col("bits").alias(f"b{k}"))
    sized = pairs.join(own("v", 1).drop("b1"), "v").join(own("u", 2).drop("b2"), "u").where(F.abs(F.col("n1") - F.col("n2")) <= F.lit(share) * (F.col("n1") + F.col("n2")))
    joined = sized.join(own("v", 1).drop("n1"), "v").join(own("u", 2).drop("n2"), "u")
    return joined.select("u", "v", "n1", "n2", "b1", "b2").mapInArrow(_near_bits(share), "u long, v long")


def golay_pairs(sketches: DataFrame) -> DataFrame:
    """(u, v): candidate nodes whose SimHash fingerprints differ in at most two bits, as stars.

    Nodes of one fingerprint meet at its smallest node, and fingerprints by ``links``.
    """
    nodes = materialize(sketches.groupBy("fp").agg(F.min("nid").alias("first")))
    same = sketches.select("fp", "nid").join(nodes, "fp").where("nid <> first").select(F.col("first").alias("u"), F.col("nid").alias("v"))
    met = links(nodes.select("fp"))
    of = lambda c, x: nodes.select(F.col("fp").alias(c), F.col("first").alias(x))
    ends = met.join(of("u", "x"), "u").join(of("v", "y"), "v").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    return same.union(ends)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = NEAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, digest, component) of the rows that are linked to others; component is the smallest id reachable.

    A row is known by its id and the SHA-256 of its text, so texts that share an id are apart. Links are all
    pairs of shingle sets with a Jaccard similarity of ``similarity`` or more. Candidates are, first,
    ``golay_pairs``; and then, since links may differ in more bits than a code decodes, those that share a
    shingle of their prefixes (``prefix``), which no link can do without. Shingles are ordered by the count of
    their hash bucket, so that common ones come last and are keys of few documents. Candidates whose sizes or parity bitmaps
    show more unshared shingles than a link can have are dropped; the others are verified. No step is probabilistic
    but for collisions of 64-bit hashes.

    Members of a bucket are first held against its smallest node; then, since links within a component change nothing, only
    members of different components are compared, in blocks and once for buckets of the same members: of each member the likeliest
    pairs first, and where that leaves different components, all of them. Texts
    without words are alike; rows without an id are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), F.col(text).alias("text")).where("id IS NOT NULL")
    counts = np.zeros(COUNTED, np.int64)
    counted = rows.select("text").mapInArrow(_counted(width), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    sketched = rows.mapInArrow(_sketches(width, counts, similarity), "id long, digest binary, size long, first array<long>, bits binary, fp long")
    sketches = materialize(sketched.withColumn("nid", F.monotonically_increasing_id()))  # written once, so the numbers are fixed
    names = sketches.select("nid", "id", "digest")
    keyed = sketches.select("nid", F.explode("first").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("u"), F.max("nid").alias("v")).where("n > 1")
    buckets = materialize(buckets)
    larger = buckets.where("n > 2").select("key", "n", "u")
    members = materialize(keyed.join(small_side(larger, 1_000_000), "key"))
    free_shuffles(spark)
    stars = buckets.where("n = 2").select("u", "v").union(members.where("nid <> u").select("u", F.col("nid").alias("v")))
    bitmaps = sketches.select("nid", "size", "bits")
    share = _unshared(similarity)
    pairs = materialize(_likely(stars.union(golay_pairs(sketches)).distinct(), bitmaps, share))
    edges = _verified(pairs, rows, names, similarity, width)
    release(buckets, pairs)
    parts = materialize(connected_components(edges))

    def parted(df: DataFrame, parts: DataFrame) -> DataFrame:
        return df.join(parts.withColumnRenamed("node", "nid"), "nid", "left").withColumn("part", F.coalesce("component", "nid")).drop("component")

    # the members of buckets that are in different components, in blocks; the same few members mostly meet under several keys
    placed = materialize(parted(members, parts).select("key", "n", "nid", "part"))
    apart = materialize(placed.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("key"))
    blocks = F.ceil(F.col("n") / NEAR_BLOCK)
    left = placed.join(small_side(apart, 1_000_000), "key", "left_semi").withColumn("mine", F.pmod(F.xxhash64("nid"), blocks))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    member = F.struct(F.when(F.col("mine") > F.col("other"), 1).otherwise(0).cast("long").alias("side"), "nid")
    met = left.groupBy("key", low.alias("low"), high.alias("high")).agg(F.sort_array(F.collect_set(member)).alias("rows"))
    met = met.where(F.size("rows") > 1).select("rows").distinct()
    met = materialize(met.withColumn("list", F.monotonically_increasing_id()))
    listed = met.select("list", F.explode("rows").alias("m")).select("list", "m.side", "m.nid")
    release(placed, apart, members)
    free_shuffles(spark)
    whole = parted(listed, parts).join(bitmaps, "nid").groupBy("list").agg(F.collect_list(F.struct("side", "nid", "part", "size", "bits")).alias("rows"))
    found = materialize(whole.mapInArrow(_cross(share, MOST), "list long, u long, v long, more boolean"))
    if not found.isEmpty():
        edges = materialize(edges.union(_verified(found.select("u", "v").distinct(), rows, names, similarity, width)))
        parts = materialize(connected_components(edges))
        # lists with rows that had more candidates and are still in different components: all of those are compared where they meet
        again = parted(listed.join(small_side(found.where("more").select("list").distinct()), "list", "left_semi"), parts)
        again = materialize(again.join(again.groupBy("list").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("list"), "list", "left_semi"))
        # whole sets move only for rows whose bitmaps still leave room for a link
        whole = again.join(bitmaps, "nid").groupBy("list").agg(F.collect_list(F.struct("side", "nid", "part", "size", "bits")).alias("rows"))
        again = materialize(whole.mapInArrow(_open(share), "list long, side long, nid long, part long, size long"))
        if not again.isEmpty():
            sets = _sets_of(again, rows, names, width, "binary")
            whole = again.join(sets, "nid").groupBy("list").agg(F.collect_list(F.struct("side", "nid", "part", "size", "s")).alias("rows")).select("rows")
            more = materialize(whole.mapInArrow(_joined(share, similarity), "u long, v long"))
            parts = materialize(connected_components(edges.union(more)))
    placed = parts.withColumnRenamed("node", "nid").join(names, "nid")
    least = placed.groupBy("component").agg(F.min("id").alias("least"))
    return placed.join(least, "component").select("id", "digest", F.col("least").alias("component"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = NEAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component): the ids of ``near_groups`` and the smallest id reachable from the row."""
    return near_groups(docs, doc_id, text, width, similarity).select(F.col("id").alias("node"), "component").distinct()


def keep_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each of ``near_groups`` the rows with the smallest id, with their columns.

    Rows without an id stay, and so do near copies that share the smallest id. Another text with the id of a row
    that goes is judged on its own. Any other columns may be there, whatever their names.
    """
    found = materialize(near_groups(docs, doc_id, text).where("id <> component").select("id", "digest").distinct())
    gone_id, gone_digest, digest = fresh(docs, "gone_id", "gone_digest", "digest")
    found = small_side(found.select(F.col("id").alias(gone_id), F.col("digest").alias(gone_digest)))
    known = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    return known.join(found, (F.col(doc_id).cast("long") == F.col(gone_id)) & (F.col(digest) == F.col(gone_digest)), "left_anti").select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
