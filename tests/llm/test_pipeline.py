"""The pipeline against plain Python."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from meshwork.llm import source_mixing
from meshwork.session import materialize
from tests_llm_shared import brute_components, brute_rules, brute_shingles, check_pieces, jaccard

NAMES = [n for n, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def stages(spark, frame, sample, odd):
    rows = sample + odd + [(5000 + i, sample[i][1], "copy") for i in range(20)] + [(6000, sample[3][1] + " ", "copy"), (6001, sample[4][1], sample[4][2])]
    docs = materialize(frame(rows))
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], None)))
    return found


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_each_stage_against_brute_force(stages):
    docs, quality, exact, near, mixed, packed = stages
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    own = {}
    for _, t, s in rows:
        own.setdefault(s or "", []).append(brute_rules(t)[-1])
    assert all(sum(v) / len(v) < 0.45 for s, v in own.items() if len(v) > 30)
    passed = [(d, t, s) for d, t, s in rows if not brute_rules(t)[-1]]
    assert ids(quality) <= Counter(d for d, _, _ in passed)
    have = [(r.doc_id, r.text, r.source) for r in quality.collect()]
    best = {}
    for d, t, _ in have:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        best[key] = min(best.get(key, (0, 1, 0)), (-len(t or ""), d is None, d or 0))
    assert sorted(-1 if k is None else k for k in ids(exact).elements()) == sorted(-1 if n else d for _, n, d in best.values())
    prints = [(r.doc_id, brute_shingles(r.text)) for r in exact.collect()]
    different = list({x for d, x in prints if d is not None})
    groups = brute_components(range(len(different)), lambda a, b: jaccard(different[a], different[b]) >= 0.8)
    group = {x: groups[i] for i, x in enumerate(different)}
    first = {}
    for d, x in prints:
        if d is not None:
            first[group[x]] = min(first.get(group[x], d), d)
    assert ids(near) == Counter(d for d, x in prints if d is None or first[group[x]] == d)
    assert sum(ids(near).values()) < sum(ids(exact).values())
    assert ids(mixed) == ids(near)
    padding, n = check_pieces([(r.doc_id, r.text, r.source) for r in mixed.collect()], packed.collect())
    assert padding * n < 1.5


def test_mixed_order_is_in_the_files(spark, stages):
    mixed = stages[4].select("doc_id", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("f"), F.col("_metadata.row_index").alias("i"))
    have = [r.doc_id for r in mixed.orderBy("f", "i").collect()]
    want = [r.doc_id for r in source_mixing.mix(stages[3]).orderBy("slot", "place").collect()]
    assert have == want


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
