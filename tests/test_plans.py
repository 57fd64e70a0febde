"""What the queries' tables cost and hold."""

import pytest

from codequarry.catalog import QUERIES
from codequarry.operators import lookup as L
from codequarry.operators import rank as K
from codequarry.operators import traverse as G
from codequarry.operators import versioning as V
from codequarry.plans import graph as A
from codequarry.sources import extract as P

SF = "/root/testdata/sf0.001"


def test_stored_edges_are_the_view(spark):
    cols = ["id", "kind", "from_id", "to_id", "valid_to"]
    got, want = A.edges(spark, SF), A.view(spark, SF, "edges_raw")
    for cs in (cols, ["id", "confidence"]):
        a, b = (x.withColumn("confidence", x["confidence"].cast("double")).select(*cs) for x in (got, want))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name", ["get_nodes_by_ids", "ambiguity_report", "search_blocks", "insert_and_update_nodes", "delete_nodes"])
def test_queries_of_nodes_and_blocks_write_no_edges(spark, monkeypatch, name):
    monkeypatch.setattr(A, "stored", lambda *a: pytest.fail("a table was stored"))
    assert QUERIES[name](spark, SF).columns


def exchanges(df):
    """Exchanges of a plan that aren't broadcasts, when it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hash") + plan.count("Exchange range")


def test_walks_move_neither_edges_nor_nodes(spark):
    n, e = A.nodes(spark, SF), A.edges(spark, SF)
    assert exchanges(G.find_superclasses(n, e, "P190", 5)) == 0
    assert exchanges(G.find_callees(n, e, "E10", 5)) == 0
    assert all(exchanges(x) == 0 for x in G.expand_neighbourhood(n, e, "S3", 2))


def test_short_lists_move_no_edges(spark):
    n, e = A.nodes(spark, SF), A.edges(spark, SF)
    some = n.filter("kind = 'Interface'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")  # less than the nodes' tables, more than the list
    try:
        assert exchanges(V.edges_without(e, some)) == 0 and exchanges(V.nodes_without(n, some)) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_then_callers_walks_a_written_graph(spark):
    """Each hop reads the graph's tables; it doesn't plan the whole extraction again."""
    assert "MapInArrow" not in QUERIES["index_then_callers"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_dealt_out_by_their_number(spark):
    keys = spark.range(0, 2500, 1, 1).toDF("k")
    assert P.spread(keys, "k", 1000).rdd.getNumPartitions() == 3 and P.spread(keys, "k").count() == 2500


@pytest.mark.parametrize("name", ["extract_nodes", "extract_blocks"])
def test_extraction_is_dealt_out(spark, monkeypatch, name):
    monkeypatch.setattr(P.spread, "__defaults__", (5,))
    assert "hashpartitioning(p_partkey" in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_an_update_extracts_each_side_once(spark):
    assert "MapInArrow" not in QUERIES["update_between_commits"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_outward_edges_and_containment_read_the_rows_once(spark):
    raw = P.extract(spark.createDataFrame([("a.java", "java", bytearray(b"import x.Y;\nclass A {\n  int f;\n  int g() { return 1; }\n}\n"))], "path string, lang string, content binary"))
    for edges in (P.outward_edges(raw, "p", "c1"), P.containment(raw, "p", "c1")):
        assert edges._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.kind, r.label) for r in P.outward_edges(raw, "p", "c1").collect()) == [("DEPENDS_ON", "x.Y"), ("IMPORTS", "x.Y"), ("TYPES", "int")]


def test_a_block_of_queries_holds_few_scores_at_once():
    """Peak memory doesn't follow the batch; copies of a vector are ranked by id."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(2000, 8)), 2, axis=0)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])
    block = SimpleNamespace(value=(np.arange(2000), v[:2000]))
    tracemalloc.start()
    (got,) = K._block_top(block, 4)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.round(unit[:2000] @ unit.T, 12)
    want = [np.lexsort((np.arange(4000), -row))[:4].tolist() for row in near]
    assert np.asarray(got.column("id")).reshape(2000, 4).tolist() == want and peak < 100e6


def test_frames_of_one_place_are_looked_up_once(spark):
    """Many frames of a place and a name: they meet the node that was found, not the file's nodes."""
    frames = spark.range(50).selectExpr("'f' || id AS frame_id", "'src\\\\m3/go.x' AS path", "25 AS line", "'go' AS lang")
    n = spark.createDataFrame([(f"n{i}", "src/m3/go.x", "go", i, 90, None) for i in range(1, 20)], "id string, file_path string, lang string, start_line int, end_line int, valid_to string")
    got = L.nodes_by_location(frames, n)
    assert "start_line <=" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r["count"]) for r in got.groupBy("id").count().collect()] == [("n19", 50)]


def test_a_walk_gives_the_least_depth_and_the_start_of_a_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")]
    nodes = spark.createDataFrame([(x, None) for x in "abcd"], "id string, valid_to string")
    edges = spark.createDataFrame([("CALLS", *p, None) for p in pairs], "kind string, from_id string, to_id string, valid_to string")
    found = G.reach_live(nodes, edges, spark.createDataFrame([("a",)], "seed_id string"), None, "out", 5)
    assert sorted((r.id, r.depth) for r in found.collect()) == [("a", 2), ("b", 1), ("c", 1), ("d", 2)]
    assert exchanges(found) == 0


def test_a_neighbourhood_takes_edges_by_one_scan(spark):
    nodes = spark.createDataFrame([(x, None) for x in "abcd"], "id string, valid_to string")
    edges = spark.createDataFrame([(f"e{i}", "CALLS", *p, None) for i, p in enumerate(["ab", "cb", "cd", "aa"])], "id string, kind string, from_id string, to_id string, valid_to string")
    n, e = G.expand_neighbourhood(nodes, edges, "a", 2)
    assert sorted(r.id for r in n.collect()) == list("abc") and sorted(r.id for r in e.collect()) == ["e0", "e1", "e3"]
    assert exchanges(e) == 0


def test_edges_go_with_either_end(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d")], "id string, from_id string, to_id string")
    left = V.edges_without(e, spark.createDataFrame([("a",), ("c",)], "id string"))
    assert left.isEmpty() and exchanges(left) == 0


def test_edges_are_stored_without_their_ids(spark):
    assert A.stored(spark, SF, "edges_raw").columns == ["kind", "from_id", "to_id", "confidence", "valid_to"]


def test_an_upsert_of_edges_moves_no_ids_and_sorts_by_rows_not_by_session(spark, monkeypatch):
    """The plan is the same at every size, and a task's share of edges doesn't follow the session's number of partitions."""
    monkeypatch.setattr(A, "EDGES_PER_TASK", 2000)
    n = A.edge_tasks(spark, SF)
    plan = QUERIES["edge_upsert_semijoin"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert n > 4 and "hashpartitioning(id#" not in plan and "BroadcastHashJoin" not in plan
    assert plan.count(f", {n}), REPARTITION_BY_NUM") == 4 and plan.count("Exchange") == 6


def test_upsert_by_several_columns(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 2, "w"), ("b", 2, None), (None, 1, "q")], old.schema)
    want = [("None", 1, "q"), ("None", 1, "z"), ("a", 1, "x"), ("a", 2, "w"), ("b", 2, None)]
    for parts in (None, 3):
        got = V.upsert(old, new, ["k", "n"], parts).collect()
        assert sorted((str(r.k), r.n, r.v) for r in got) == want


def test_rows_that_are_not_wanted_are_not_made():
    texts = [
        ("a.java", "java", "import x.Y;\nclass A extends B {\n  @Inject int f;\n  int g(int a) { if (a > 0) { return h(a); } return 0; }\n}\n"),
        ("a.py", "python", "import os\nclass P(Q):\n    x: int = f()\n    def g(self, n: T = h(1)) -> U:\n        for i in n:\n            k(lambda y: i + y)\n"),
        ("a.rs", "rust", "use a::b;\nfn f(x: i32) -> i32 { let g = |y| x + y; if x > 0 { h(x) } else { 0 } }\nimpl T for S { }\n"),
    ]
    for path, lang, text in texts:
        rows = P.extract_text(path, lang, text)
        assert {r["what"] for r in rows} == set(P.WHAT)
        for what in P.WHAT:
            assert P.extract_text(path, lang, text, (what,)) == [r for r in rows if r["what"] == what]


@pytest.mark.parametrize("name, want", [("extract_nodes", "node"), ("extract_blocks", "block"), ("containment_edges", "node"), ("outward_edges", "ref")])
def test_queries_of_sources_ask_for_their_rows_alone(spark, monkeypatch, name, want):
    asked, extract = [], P.extract
    monkeypatch.setattr(P, "extract", lambda files, *w: asked.append(w) or extract(files, *w))
    QUERIES[name](spark, SF)
    assert asked == [(want,)]


def test_unknown_rows_are_an_error(spark):
    with pytest.raises(ValueError):
        P.extract(spark.createDataFrame([], "path string, lang string, content binary"), "nodes")


def test_nodes_far_from_the_ids_are_not_moved(spark, monkeypatch):
    n = A.nodes(spark, SF)
    ids = spark.createDataFrame([("C1",), ("C1",), (None,), ("C30",), ("S2",), ("nothing",)], "id string")
    want = ["C1", "C30", "S2"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = L.get_nodes(n, ids)
        assert sorted(r.id for r in got.collect()) == want
        filters = got._jdf.queryExecution().optimizedPlan().toString()
        assert "<= C30" in filters and "<= S2" in filters  # before the join
        monkeypatch.setattr(L, "MOST_SPANS", 2)
        assert sorted(r.id for r in L.get_nodes(n, ids).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert L.get_nodes(n, ids.filter("false")).isEmpty()


def test_a_line_is_moved_once_for_all_its_edges(spark, monkeypatch):
    monkeypatch.setattr(A, "LINES_PER_TASK", 1000)
    got = A._edge_keys(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3 and "Exchange hashpartitioning(a#" in plan  # lines, the other edges, events of a user
    assert plan.index("Generate") < plan.index("Exchange")  # edges are made of lines after the exchange
    assert got.count() == got.distinct().count() == A.view(spark, SF, "edges_raw").count()
