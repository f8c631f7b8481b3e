from collections import Counter, defaultdict
from itertools import permutations

import pytest
from tests_llm_shared import words

from meshwork.llm import filter_audit


def brute(rows, labels):
    """Every order applied step by step to the documents of a part."""
    ids = defaultdict(list)
    for d, t, _ in rows:
        if d is not None:
            ids[t or ""].append(d)
    docs = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = words(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and any(i < d for i in ids[t]),
        }
        own = [x for x in labels if d is not None and x[0] == d]
        docs[s or ""].append((fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part, own in docs.items():
        removed_by, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                removed_by[f] += len(gone)
                redundant = sum(x[0][f] for x in own) - len(gone)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                steps.append((part, "".join(order), k, len(left), len(gone), redundant, alone, sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*s, removed_by[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


@pytest.fixture(scope="module")
def labels():
    return [(d, d % 3 // 2 if d % 5 else None, int(d % 7 == 0)) for d in range(0, 950, 2)] + [(900, 1, None), (900, 0, 1), (None, 1, 1)]


def test_audit_against_brute_force(spark, frame, sample, odd, labels):
    rows = sample[:60] + odd + [(1000 + i, sample[3][1], "b") for i in range(5)]
    got = filter_audit.audit(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_buffers_and_colliding_fingerprints(monkeypatch):
    """All texts under one fingerprint, buffers of a few rows, many copies of one text."""
    rows = [(i, "the hot text" if i % 3 else f"text {i % 10}", "a" if i % 2 else "") for i in range(300)]
    monkeypatch.setattr(filter_audit, "BUFFER", 1500)
    routed = [x for at in range(0, 300, 60) for x in filter_audit._route((d, s, 7, t) for d, t, s in rows[at : at + 60])]
    assert sum(v[3] is not None for _, v in routed) < 120
    masked = list(filter_audit._decide(iter(sorted(routed, key=lambda x: x[0]))))
    first = {}
    for d, t, _ in rows:
        first.setdefault(t, d)
    assert len(masked) == 300 and {d for d, _, m in masked if m & 16} == {d for d, t, _ in rows if d > first[t]}


def test_no_copies_and_only_copies(spark, frame, labels):
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for rows in ([(i, f"text {i}", "a") for i in range(30)], [(i // 2, "one text", "a") for i in range(300)], [(None, "one text", "a")] * 3 + [(1, "one text", "b"), (2, "one text", "b")]):
        assert sorted(map(tuple, filter_audit.audit(frame(rows), said).collect())) == brute(rows, labels)


def test_empty_tables(spark, frame, sample):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame([]), none).count() == 0
    got = filter_audit.audit(frame(sample[:20]), none)
    assert {(r.good_lost, r.toxic_lost) for r in got.collect()} == {(0, 0)}
    assert got.count() == 600 * len({s or "" for _, _, s in sample[:20]})


def test_same_as_sql(spark):
    import compare

    ok, note = compare.compare(spark, compare.connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", "op12_filter_audit")
    assert ok, note
