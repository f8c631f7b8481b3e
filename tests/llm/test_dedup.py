import hashlib
import re
from collections import Counter, defaultdict

import pytest
from tests_llm_shared import brute_components, brute_fingerprint, brute_shingles, jaccard

from meshwork.llm import exact_dedup, simhash, substring_dedup


def test_exact_dedup_against_brute_force(frame, sample, odd):
    rows = sample + odd
    got = exact_dedup.exact_dedup(frame(rows)).collect()
    groups = defaultdict(list)
    for d, t, _ in rows:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        groups[hashlib.sha256(key.encode()).hexdigest()].append((-len(t or ""), d is None, d))
    want = Counter()
    for digest, members in groups.items():
        best = min(members)
        for i, m in enumerate(sorted(members)):
            want[m[2], best[2], len(members), i == 0, digest] += 1
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_runs_merge(spark):
    index = exact_dedup.MergeIndex(spark)
    one = spark.createDataFrame([(b"a", 3, 5), (b"a", 3, 4), (b"b", 1, 9)], "digest binary, points int, doc_id long")
    two = spark.createDataFrame([(b"a", 7, 50), (b"c", 1, 1)], "digest binary, points int, doc_id long")
    index.flush(one)
    index.flush(two)
    got = {bytes(r.digest): (r.n, r.keep_points, r.keep_id) for r in index.compact().collect()}
    assert got == {b"a": (3, 7, 50), b"b": (1, 1, 9), b"c": (1, 1, 1)}


def test_exact_dedup_levels_filters_and_hits(spark):
    """Five flushes of overlapping keys: levels as of a binary counter, hits as counted, no key lost by a filter."""
    index = exact_dedup.MergeIndex(spark)
    seen, shapes = Counter(), []
    for k in range(5):
        keys = list(range(k * 700, k * 700 + 1000)) + [k]
        seen.update(keys)
        rows = [(hashlib.sha256(str(x).encode()).digest(), 1, x) for x in keys]
        index.flush(spark.createDataFrame(rows, "digest binary, points int, doc_id long"))
        shapes.append([len(level) for level in index.levels])
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    name = {hashlib.sha256(str(x).encode()).digest(): x for x in seen}
    hits = [name[bytes(r.digest)] for r in index.hits().collect()]
    assert sorted(hits) == sorted(x for x, n in seen.items() if n > 1)
    run = index.levels[2][0]
    probes = spark.createDataFrame([(hashlib.sha256(str(x).encode()).digest(),) for x in range(10_000, 14_000)], "digest binary")
    assert run.filter.passing(probes).count() < 80  # 1 % by chance
    assert {name[bytes(r.digest)]: r.n for r in index.compact().collect()} == seen


@pytest.mark.parametrize("keep", [0, 1])
def test_exact_dedup_groups_by_bytes_where_digests_collide(frame, sample, odd, keep):
    from pyspark.sql import functions as F

    rows = sample[:60] + odd + [(-(2**63), "least", "a"), (5, "least", "b"), (-(2**63), "one more", "a")]
    weak = lambda norm: F.substring(exact_dedup.sha256(norm), 1, keep)  # noqa: E731  at most 256 digests
    columns = ("doc_id", "keep_id", "group_size", "kept")
    got = exact_dedup.exact_dedup(frame(rows), digest=weak).select(*columns).collect()
    assert Counter(got) == Counter(exact_dedup.exact_dedup(frame(rows)).select(*columns).collect())
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d is None, d))
    want = Counter((m[2], min(g)[2], len(g), i == 0) for g in groups.values() for i, m in enumerate(sorted(g)))
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("cap", [1024, 2])
def test_simhash_against_brute_force(frame, sample, odd, cap):
    near = [(2000 + i, " ".join(f"t{j}" for j in range(400)) + f" z{i}" * (i % 5), "a") for i in range(12)]
    rows = sample + odd + near
    got = simhash.simhash_components(frame(rows), cap=cap).collect()
    prints = [(d, brute_fingerprint(t)) for d, t, _ in rows]
    groups = brute_components(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 2)
    first = defaultdict(list)
    for d, p in prints:
        if d is not None:
            first[groups[p]].append(d)
    want = Counter((d, f"{p:016x}", min(first[groups[p]], default=None)) for d, p in prints)
    assert Counter(tuple(r) for r in got) == want
    assert len({c for _, _, c in want}) < len({p for _, p in prints})


def test_large_buckets_lose_no_link(spark):
    """A dense cloud of fingerprints, with the cap below and above the bucket size."""
    import numpy as np

    rng = np.random.default_rng(7)
    base = rng.integers(-(2**63), 2**63 - 1, 6)
    cloud = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= np.int64(-(2**63)) if bit == 63 else np.int64(1) << bit
            cloud.add(int(x))
    nodes = sorted(cloud)
    want = brute_components(nodes, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    from meshwork.operators.components import connected_components

    for cap in (3, 1024):
        fps = spark.createDataFrame([(x,) for x in nodes], "fp long")
        got = {r.node: r.component for r in connected_components(simhash.links(fps, cap)).collect()}
        assert {x: got.get(x, x) for x in nodes} == want


def test_golay_code_is_perfect_and_keys_meet():
    import numpy as np

    errors, counts, _ = simhash.golay()
    assert Counter(counts.tolist()) == {6: 1771, 1: 277}
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000).astype(np.int64)
    y = x ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    kx, ky = defaultdict(set), defaultdict(set)
    for keys, word in ((kx, x), (ky, y)):
        for at, k in zip(*simhash.golay_keys(word)):
            keys[at].add(k)
    assert all(kx[i] & ky[i] for i in range(3000))


def edited(rng, text, share):
    """The words of a text with about this share replaced."""
    return " ".join(f"e{rng.integers(1 << 40)}" if rng.random() < share else x for x in text.split())


@pytest.mark.parametrize("block", [3, 512])
def test_near_components_against_brute_force(frame, sample, odd, block, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "NEAR_BLOCK", block)
    rng = np.random.default_rng(5)
    rows = sample[:100] + odd
    for i, (_, t, s) in enumerate(sample[:100]):
        rows += [(2000 + 10 * i + k, edited(rng, t, share), s) for k, share in enumerate((0.005, 0.012, 0.018, 0.025, 0.04))]
    chain = sample[5][1]
    for i in range(40):
        chain = edited(rng, chain, 0.015)
        rows.append((4000 + i, chain, "s"))
    got = {r.node: r.component for r in simhash.near_components(frame(rows)).collect()}
    sets = [(d, brute_shingles(t)) for d, t, _ in rows if d is not None]
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and jaccard(x, y) >= 0.8]
    pairs = {frozenset(x) for x in linked}
    want = brute_components(sorted({d for d, _ in sets}), lambda a, b: frozenset((a, b)) in pairs)
    found = sum(got.get(a, a) == got.get(b, b) for a, b in linked)
    assert found >= 0.95 * len(linked) > 200
    # nothing is linked that brute force doesn't link
    assert all(want[a] == want[b] for a, b in got.items())


def test_near_components_find_every_link(frame):
    """Pairs of their own around the threshold, so that no other path joins them."""
    import numpy as np

    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        words = [f"d{i}w{k}" for k in range(60 + i % 90)]
        rows.append((2 * i, " ".join(words), "s"))
        for _ in range(1 + len(words) // 65):
            words[rng.integers(len(words))] = f"x{rng.integers(1 << 40)}"
        rows.append((2 * i + 1, " ".join(words), "s"))
    sets = [brute_shingles(t) for _, t, _ in rows]
    linked = {2 * i for i in range(600) if jaccard(sets[2 * i], sets[2 * i + 1]) >= 0.8}
    got = simhash.near_components(frame(rows)).collect()
    assert {r.node for r in got if r.node != r.component} == {i + 1 for i in linked}
    assert len(linked) > 200


def test_near_copies_keep_the_smallest_id_and_other_rows(frame):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text, "a"), (2, text.upper(), "a"), (9, text + " end", "b"), (4, "else " * 3, "a"), (5, "", "a"), (6, None, "a"), (None, text, "a"), (2, text, "a")]
    kept = simhash.keep_documents(frame(rows))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 2, 4, 5, None])
    assert kept.columns == frame([]).columns
    assert simhash.keep_documents(frame([])).count() == 0


def brute_substring(rows, length=20):
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
    first = {}
    for d, t, _ in rows:
        w = split(t)
        for i in range(len(w) - length + 1):
            if d is not None:
                k = tuple(w[i : i + length])
                first[k] = min(first.get(k, (d, i)), (d, i))
    for d, t, _ in rows:
        w = split(t)
        hit = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < (d, i):
                hit[i : i + length] = [True] * length
        kept = " ".join(x for x, h in zip(w, hit) if not h)
        yield d, len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest(), kept


def test_substring_dedup_against_brute_force(frame, sample, odd):
    rows = sample + odd
    got = substring_dedup.substring_dedup(frame(rows)).collect()
    want = Counter(brute_substring(rows))
    assert Counter(tuple(r) for r in got) == want
    assert sum(n for _, _, n, _, _ in want) > 1000


def test_substring_dedup_of_periodic_text(frame):
    rows = [(1, "a b " * 300, "s"), (2, "b a " * 15, "s"), (3, "a " * 19, "s"), (4, "a " * 40, "s"), (5, "a " * 25, "s")]
    got = substring_dedup.substring_dedup(frame(rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_substring(rows))


def test_empty_tables(frame):
    none = frame([])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
