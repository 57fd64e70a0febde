from codequarry.operators import lookup as L
from codequarry.operators import references as R
from codequarry.operators import signature as S
from codequarry.operators import traverse as G
from codequarry.operators import versioning as V


def graph(spark, pairs, dead=()):
    names = sorted({x for p in pairs for x in p[:2]})
    nodes = spark.createDataFrame([(n, "Function", n, f"m.{n}", "go", "c2" if n in dead else None) for n in names], "id string, kind string, name string, qualified_name string, lang string, valid_to string")
    edges = spark.createDataFrame([(f"e{i}", (p[2:] or ("CALLS",))[0], p[0], p[1], None) for i, p in enumerate(pairs)], "id string, kind string, from_id string, to_id string, valid_to string")
    return nodes, edges


def ids(df):
    return sorted(r.id for r in df.collect())


def test_chain_is_capped_at_five(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g")])
    assert ids(G.find_callees(*g, "a", 6)) == list("bcdef")
    assert ids(G.find_callers(*g, "c", 2)) == list("ab")


def test_cycle_and_self_loop_return_the_start(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert ids(G.find_callers(*g, "a", 3)) == list("abc")
    assert ids(G.find_callees(*graph(spark, [("a", "a")]), "a", 1)) == ["a"]


def test_dead_middle_stops_the_walk_and_kinds_filter(spark):
    assert ids(G.find_callees(*graph(spark, [("a", "x"), ("x", "b")], dead=("x",)), "a", 3)) == []
    assert ids(G.find_callees(*graph(spark, [("a", "b", "INHERITS"), ("a", "c")]), "a", 1)) == ["c"]


def test_neighbourhood(spark):
    n, e = G.expand_neighbourhood(*graph(spark, [("a", "b"), ("c", "b"), ("c", "d")]), "a", 2)
    assert ids(n) == list("abc") and e.count() == 2


def test_pages_join_up(spark):
    nodes, edges = graph(spark, [(f"s{i}", "t") for i in range(7)])
    nodes = nodes.selectExpr("*", "'f' as file_path", "1 as start_line")
    defs = nodes.filter("id = 't'")
    whole = [r.edge_id for r in R.find_references(defs, nodes, edges, 500, 0).collect()]
    parts = [r.edge_id for o in (0, 3, 6) for r in R.find_references(defs, nodes, edges, 3, o).collect()]
    assert whole == parts and len(whole) == 7


def test_unknown_kind_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        L.find_definition(graph(spark, [("a", "b")])[0], "a", kind="Nonsense")


def test_signature_patterns():
    import re

    assert S.split_params("int, map<K, V>, x") == ["int", "map<K, V>", "x"]
    rx = S.to_regex(S.parse_pattern("get*(int, map<K, V>) -> T"))
    assert rx.startswith("(?s)") and re.search(rx, "getAll(int a,\n map<K, V> b) -> T") and not re.search(rx, "put(int a)")
    assert re.search(S.to_regex(S.parse_pattern("*")), "any(x)")


def test_diff_and_apply_laws(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, code_hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "id string, code_hash string")
    diff = V.snapshot_diff(old, new)
    assert sorted((r.change, r.id) for r in diff.collect()) == [("added", "d"), ("deleted", "a"), ("updated", "b")]
    hist = V.apply_changes(old.selectExpr("*", "'c1' valid_from", "cast(null as string) valid_to"), new, diff, "c2")
    live = hist.filter("valid_to is null")
    assert V.snapshot_diff(live, new).isEmpty() and hist.count() == 5
    assert V.snapshot_diff(old, old).isEmpty()


def test_ends_only_walks_over_the_dead(spark):
    assert ids(G.find_callees(*graph(spark, [("a", "x"), ("x", "b")], dead=("x",)), "a", 3, ends_only=True)) == ["b"]


def test_outputs_and_vectors(spark):
    from codequarry.operators import output as O
    from codequarry.operators import rank as K

    n = spark.createDataFrame([("a", "f", "m.f", "Function", "go", "m.go", 3, 9, "f(x)", None)], "id string, name string, qualified_name string, kind string, lang string, file_path string, start_line int, end_line int, signature string, code_hash string")
    std = O.standard(n)
    assert std.columns == O.STANDARD and std.first().metadata == {"signature": "f(x)"}
    assert O.markdown(std).first().value == "- **m.f** (Function) `m.go:3`" and '"id":"a"' in O.json_lines(std).first().value
    v = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(60)], "id int, embedding array<double>")
    new = K.update_vectors(v, spark.createDataFrame([(0, [9.0, 9.0, 9.0])], v.schema), spark.createDataFrame([(1,)], "id int"))
    assert new.count() == 59 and new.filter("id = 0").first().embedding[0] == 9.0
    exact = [r.id for r in K.vector_topk(v, [1.0, 2.0, 1.0], 5).collect()]
    near = [r.id for r in K.nearest_by_lsh(v, [1.0, 2.0, 1.0], 5, length=2.0).collect()]
    assert len(set(exact) & set(near)) >= 4
