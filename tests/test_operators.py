import io
import math
import sqlite3
import zipfile
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwork.operators import checks, cluster, components, graph, pairs, panel, specs, stats, validity
from meshwork.sources import readers, writers
from meshwork.streaming import windows


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.lists(st.lists(st.integers(0, 50), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment_is_optimal(rows):
    c = np.array(rows, float)
    got = panel.best_assignment(c)
    assert sorted(got) == list(range(len(c)))
    best = min(sum(c[i, p[i]] for i in range(len(c))) for p in permutations(range(len(c))))
    assert c[np.arange(len(c)), got].sum() == best


def test_exact_tails():
    assert math.isclose(stats.binomial_sum_tail([3, 2], [0.5, 0.5], 5), 1 / 32)
    assert math.isclose(stats.binomial_sum_tail([4], [0.3], 0), 1.0)
    assert math.isclose(stats.wilcoxon_exact(5, 0), 2 / 32)


def test_expected_information_of_two_halves():
    assert math.isclose(validity.expected_information([2, 2], [2, 2]), math.log(2) / 3, rel_tol=1e-9)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(100, 101)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def cliques(weight, between):
    e = [(i * 10 + a, i * 10 + b, 1.0) for i in range(4) for a in range(10) for b in range(a + 1, 10)]
    return e + [(i * 10, j * 10, weight) for i, j in between]


def test_partition_quality_on_cliques(spark):
    links = [(0, 1), (1, 2), (2, 3)]
    lab = spark.createDataFrame([(i, i // 10) for i in range(40)], "id long, label long")
    found = []
    for w in (0.01, 1.0, 10.0):
        e = spark.createDataFrame(cliques(w, links), "x long, y long, score double")
        q = graph.partition_quality(graph.cluster_edges(e, lab)).first()
        assert 0 <= q.avi <= 1 and 0 <= q.avu
        found.append(q)
    assert found[0].avi > found[1].avi > found[2].avi
    e = spark.createDataFrame(cliques(0.01, links), "x long, y long, score double")
    runs = spark.createDataFrame([(0, 1.0), (1, 1.0)], "seed long, gamma double")
    for r in graph.louvain_runs(e, runs).collect():
        assert r.label == r.id // 10


def test_block_knn_is_the_plain_one(spark):
    rng = np.random.default_rng(0)
    n = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(90)], "id long, x array<double>")
    got = {(r.src, r.dst) for r in pairs.block_knn(n, 4, 3).collect()}
    m = np.array([r.x for r in n.orderBy("id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    np.fill_diagonal(s, -9)
    assert got == {(i, int(j)) for i in range(90) for j in np.argsort(-s[i], kind="stable")[:4]}


def test_mutual_edges_identity(spark):
    rng = np.random.default_rng(1)
    n = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(40)], "id long, x array<double>")
    e = pairs.knn_edges(pairs.all_pairs(n, pairs.cosine(F.col("a.x"), F.col("b.x"))), 6)
    r = e.agg(F.count(F.lit(1)).alias("n"), F.count_if("mutual").alias("m")).first()
    assert r.n + r.m == 6 * 40


def test_clusterings_find_clear_groups(spark):
    rng = np.random.default_rng(2)
    n = spark.createDataFrame([(i, (rng.normal(size=3) * 0.1 + 3 * np.eye(3)[i % 3]).tolist()) for i in range(60)], "id long, x array<double>")
    truth = n.select("id", (F.col("id") % 3).alias("label"))
    runs = spark.createDataFrame([(0, 3)], "seed long, k int")
    for method in ("kmeans", "gmm", "ward", "spectral"):
        got = cluster.fits(n, runs, method).select("id", "label")
        assert validity.adjusted_rand(validity.contingency(truth, got)).first().ari == pytest.approx(1.0), method
    assert cluster.prediction_strength(n, 3, 4).agg(F.min("strength")).first()[0] == pytest.approx(1.0)
    _, shares, loadings = cluster.pca(n)
    assert sum(shares) == pytest.approx(1.0) and loadings[0][0] > 0


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.25)], "id long, c string, v double")
    checks.unique(checks.only_values(df, "c", ["a", "b"]), ["id"])
    checks.row_count(checks.schema_is(checks.no_nulls(df, ["v"]), "id bigint, c string, v double"), 2)
    checks.same_values(df, df, ["id"], "v")
    for bad in (lambda: checks.only_values(df, "c", ["a"]), lambda: checks.unique(df.union(df), ["id"]), lambda: checks.row_count(df, 3), lambda: checks.schema_is(df, "id bigint"), lambda: checks.same_values(df, df.withColumn("v", F.col("v") + 1), ["id"], "v"), lambda: checks.control_table(spark, [("n", 1.0, 2.0, 0.5)]), lambda: checks.settings({"x": 1}, {"k": 6})):
        with pytest.raises(checks.CheckFailed):
            bad()
    assert [r.agrees for r in checks.printed_agrees(spark.createDataFrame([("0.25", 0.2549), ("0,3", 0.36)], "p string, v double"), "p", "v").collect()] == [True, False]
    assert checks.mask_anomalies(df.withColumn("pop", F.lit(0)), "pop", ["v"], ["v"]).where("v is null and anomaly").count() == 2


def test_specs(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 5.0)], "id long, share_A double, share_B double, pop double")
    s = specs.expand([specs.Variable("h", "share_*", "per", "pop"), specs.Variable("h", "pop", "log")], ["A", "B"])
    got = {r.variable: (r.y, r.seed) for r in specs.long_values(df, s, ["id"], 7).collect()}
    assert got == {"share_A": (2.0, 7), "share_B": (4.0, 8), "pop": (pytest.approx(math.log(5)), 9)}


def test_zip_xlsx_and_geopackage(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data.csv", "id;year;v\n1;2023;\n2;2024;x\n3;2024;y\n")
    got = readers.zip_csv(spark, str(tmp_path / "a.zip"), ["id", "year"], keep=lambda p: p.year == "2024").collect()
    assert [tuple(r) for r in got] == [("2", "2024"), ("3", "2024")]
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="B2"><v>4.5</v></c></row></sheetData></worksheet>'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    assert [tuple(r) for r in readers.xlsx(spark, str(tmp_path / "b.xlsx"), ["n", "name"]).collect()] == [("4.5", "")]
    db = sqlite3.connect(tmp_path / "c.gpkg")
    db.execute("create table f (id integer, geom blob)")
    db.execute("insert into f values (1, ?)", (b"GP\x00\x02" + bytes(4) + bytes(32) + b"WKB",))
    db.commit()
    db.close()
    r = readers.geopackage(spark, str(tmp_path / "c.gpkg"), "select id, geom from f", "id long, geom binary", "geom").first()
    assert (r.id, bytes(r.geom)) == (1, b"WKB")


def test_csv_geojson_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,\n"x, y",z\n')
    assert [tuple(r) for r in readers.csv_strings(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect()] == [("1", ""), ("x, y", "z")]
    poly = spark.createDataFrame([("p", [[[[0.001, 0.0], [0.0012, 0.0], [1.0, 1.0], [0.001, 0.0]]]])], "name string, coordinates array<array<array<array<double>>>>")
    writers.feature_lines(poly, ["name"], 2).write.text(str(tmp_path / "g"))
    back = readers.geojson(spark, str(tmp_path / "g")).first()
    assert back.properties["name"] == "p" and back.coordinates == [[[[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]
    months = spark.createDataFrame([(1, "2023-01"), (2, "2023-02")], "v long, month string")
    writers.by_month(months, str(tmp_path / "m"))
    writers.by_month(spark.createDataFrame([(9, "2023-02")], "v long, month string"), str(tmp_path / "m"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [1, 9]
    assert readers.first_existing(spark, [str(tmp_path / "no.parquet"), str(tmp_path / "t.csv")]).count() == 2
    nodes, edges = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 2, 0.5)], "x long, y long, score double")
    writers.write_graphml(nodes, edges, str(tmp_path / "x"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "x")).collect())
    assert text.startswith("<?xml") and text.endswith("</graphml>") and 'target="n2"' in text
    assert writers.packed_payload(months.withColumn("g", F.lit(1)), ["g"], "month", "v").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    types = ["click", "view"]
    stream = windows.tumbling_shares(windows.read_events(spark, "/root/testdata/sf0.001", "events.parquet"), types)
    windows.run_to_table(stream, "shares", str(tmp_path / "cp"), "update")
    batch = windows.tumbling_shares(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")), types)
    key = lambda r: (r.start, r.n, round(r.total, 6), round(r.click or 0, 9))
    assert {key(r) for r in spark.table("shares").collect()} == {key(r) for r in batch.collect()}
