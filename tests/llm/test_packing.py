import numpy as np
from tests_llm_shared import PATH, check_pieces

from meshwork.llm import packing

def test_packing_round_trip(frame, sample, odd):
    rows = sample + odd
    padding, _ = check_pieces(rows, packing.pack(frame(rows), PATH).collect())
    assert padding < 0.01


def test_packing_of_many_equal_lengths(frame):
    rows = [(i, "one two three " * 140, "a") for i in range(60)] + [(100 + i, "short text " * 5, "b") for i in range(40)]
    padding, n = check_pieces(rows, packing.pack(frame(rows), PATH).collect())
    assert padding * n < 1.1


def test_packing_empty(frame):
    assert packing.pack(frame([]), PATH).count() == 0


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(3)
    demand = rng.integers(0, 40, 128)
    demand[0], demand[70] = 0, 900
    plan = packing.Plan(demand, 128)
    size = np.repeat(np.arange(128), demand)
    rank = np.concatenate([np.arange(n) for n in demand])
    seq, off, stream = plan.place(size, rank)
    taken = np.zeros((plan.n_sequences, 128), int)
    for s, o, n in zip(seq, off, size):
        for k in range(n):
            taken[s + (o + k) // 128, (o + k) % 128] += 1
    assert taken.max() == 1
    assert (taken.sum(axis=1) < 126).sum() <= 1
    assert (stream < 0).sum() > 0


def test_column_generation_reaches_the_bound():
    demand = np.zeros(101, int)
    demand[[45, 36, 31, 14]] = [97, 610, 395, 211]  # Gilmore and Gomory's example, optimum 452.25
    lengths, columns, amounts = packing.column_generation(demand, 100, gap=1e-9)
    assert abs(amounts.sum() - 452.25) < 1e-6
    assert np.allclose(columns @ amounts, demand[lengths])
    assert (lengths @ columns).max() <= 100


def test_column_generation_on_documents(spark):
    """Near the bound, and its patterns take nearly all of what whole sequences leave."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    n = docs.select(F.col("doc_id"), F.col("doc_id").alias("place"), "text").mapInArrow(packing._tokenised(PATH, 0, 1024), packing.TOKENISED)
    demand = np.zeros(1024, np.int64)
    for r in n.groupBy("rest").count().collect():
        demand[r["rest"]] = r["count"]
    demand[0] = 0
    plan = packing.Plan(demand)
    assert plan.gap <= 0.01
    assert plan.stream_first >= 0.9 * plan.n_sequences
    assert plan.n_sequences == -(-int(np.arange(1024) @ demand) // 1024) or plan.n_sequences <= 1.001 * (np.arange(1024) @ demand) / 1024 + 1


def test_patterns_of_many_short_lengths():
    demand = np.zeros(1024, np.int64)
    demand[1:12] = 5000
    demand[700] = 50
    plan = packing.Plan(demand)
    size = np.repeat(np.arange(1024), demand)
    seq, off, _ = plan.place(size, np.concatenate([np.arange(n) for n in demand]))
    assert len(set(zip(seq.tolist(), off.tolist()))) == len(size)
    assert plan.n_sequences <= (np.arange(1024) @ demand) / 1024 * 1.01 + 1


def test_a_million_spaces(frame):
    rows = [(1, " " * 1_000_000, "a"), (2, "x" + "\n" * 900_000 + "y", "a"), (None, "no id", "a"), (None, "no id", "a"), (4, "short", "a")]
    check_pieces(rows, packing.pack(frame(rows), PATH).collect())
