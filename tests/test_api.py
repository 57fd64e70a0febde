import json

import pytest

from codequarry import cli, config
from codequarry.api import CodeGraph
from codequarry.functions import sql
from codequarry.operators import crud as C
from codequarry.operators import evaluate as E
from codequarry.operators import lookup as L
from codequarry.operators import rank as K
from codequarry.operators import summarize as Z


def test_index_query_and_commands(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "__init__.py").write_text("def helper(x): return x\n")
    (src / "main.py").write_text("def main():\n  for i in [1]:\n    helper(i)\n")
    (tmp_path / "c.json").write_text(json.dumps({"root": str(src), "store": f"file://{tmp_path}/store", "project": "p"}))
    at = ["--config", str(tmp_path / "c.json")]
    run = lambda *a: (cli.main([*at, *a], spark), capsys.readouterr().out)[1]
    assert "nodes: 4" in run("index", str(src))
    assert '"name":"helper"' in run("--format", "json", "goto", "helper") and '"name":"main"' in run("--format", "json", "callers", "helper")
    assert "**main.main**" in run("--format", "markdown", "query", "main") and "for" in run("blocks") and "files" in run("stats")
    (tmp_path / "t.txt").write_text(f'Traceback (most recent call last):\n  File "{src}/main.py", line 3, in main\n    x\nKeyError: k\n')
    assert "key_error (low)" in run("trace", str(tmp_path / "t.txt"))
    g = CodeGraph(spark, config.load(str(tmp_path / "c.json")))
    assert g.references("helper").count() == 1 and g.signature("main*").count() == 1
    assert "declarations" in g.store.validate()
    g.store.declare_standard()
    assert g.store.validate() == {} and g.store.is_declared("node_id")
    g.store.undeclare("node_name")
    assert g.store.validate() == {"declarations": ["node_name"]}
    g.store.write("later", nodes=g.nodes.limit(0))
    assert g.nodes.count() == 0
    g.store.rollback("INIT")
    assert g.nodes.count() == 4
    with pytest.raises(ValueError):
        g.store.rollback("none")
    with pytest.raises(ValueError):
        (tmp_path / "bad.json").write_text('{"nope": 1}')
        config.load(str(tmp_path / "bad.json"))
    assert config.load(None).vector_weight == 0.7


def test_rows_by_key(spark):
    n = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, name string")
    assert sorted(map(tuple, C.insert(n, spark.createDataFrame([("b", "no"), ("c", "z")], n.schema)).collect())) == [("a", "x"), ("b", "y"), ("c", "z")]
    assert {r.id: r.name for r in C.update_properties(n, "a", {"name": "new"}).collect()} == {"a": "new", "b": "y"}
    with pytest.raises(ValueError):
        C.update_properties(n, "a", {"nope": 1})
    e = spark.createDataFrame([("1", "CALLS", "a", "b"), ("2", "TYPES", "a", "b"), ("3", "CALLS", "b", "a")], "id string, kind string, from_id string, to_id string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(C.out_edges(e, "a")) == ["1", "2"] and ids(C.in_edges(e, "a")) == ["3"] and ids(C.edges_between(e, "a", "b", "TYPES")) == ["2"]
    assert C.edge_exists(e, "3") and not C.edge_exists(e, "4") and ids(C.delete_ids(e, e.filter("kind = 'CALLS'"))) == ["2"]
    assert ids(C.create_edges(e, spark.createDataFrame([("4", "CALLS", "b", "b"), ("5", "CALLS", "b", "none")], e.schema), n).orderBy("id")) == ["1", "2", "3", "4"]


def test_names_are_found_without_pairs(spark):
    nodes = spark.createDataFrame([(f"n{i}", "Function", f"get{i}", f"m.get{i}", "go", "s/a__init__.py", 1, 9, None) for i in range(30)], "id string, kind string, name string, qualified_name string, lang string, file_path string, start_line int, end_line int, valid_to string")
    frames = spark.createDataFrame([("f1", "get", "go"), ("f2", "get7", "go"), ("f3", "nope", "go"), ("f4", "et2", "go"), ("f5", "get", "java"), ("f6", None, "go")], "frame_id string, name string, lang string")
    assert {r.frame_id: r.id for r in L.nodes_by_name(frames, nodes).collect()} == {"f1": "n0", "f2": "n7", "f4": "n2"}
    assert {r.name: r.id for r in L.first_containing(frames.select("lang", "name"), nodes, block=2).collect()} == {"get": "n0", "get7": "n7", "et2": "n2"}
    at = spark.createDataFrame([("g1", "a__init__.py", 3, "go"), ("g2", "s/a__init__.py", 3, "go"), ("g3", "xs/a__init__.py", 3, "go"), ("g4", "s\\a__init__.py", 99, "go")], "frame_id string, path string, line int, lang string")
    assert {r.frame_id for r in L.nodes_by_location(at, nodes).collect()} == {"g1", "g2"}


def test_vectors_encoders_and_lsh_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    q = v.filter("id % 20 = 0").selectExpr("id AS query_id", "embedding")
    exact = K.vector_topk_batch(v, q, 10, block=7)
    whole = {(r.query_id, r.id) for r in exact.collect()}
    assert whole == {(r.query_id, r.id) for r in K.vector_topk_batch(v.repartition(5), q, 10).collect()} and len(whole) == 10 * q.count()
    hits = sum(len({(r.query_id, x.id) for x in K.nearest_by_lsh(v, r.embedding, 10).collect()} & whole) for r in q.limit(5).collect())
    assert hits >= 0.9 * 50
    texts = spark.createDataFrame([(str(i), "t" * i) for i in range(5)], "id string, text string")
    asked = K.embed(texts.coalesce(1), lambda xs: [[float(len(x)), 1.0] for x in xs] if len(xs) <= 2 else 1 / 0, batch=2)
    assert {r.id: round(sum(x * x for x in r.embedding), 6) for r in asked.collect()} == {str(i): 1.0 for i in range(5)}
    assert K.check_vectors(asked, 3).count() == 5
    with pytest.raises(ValueError):
        K.http_encoder("http://x", "other")


def test_summaries_with_fallback(spark):
    n = spark.createDataFrame([("a", "Function", "f", "m.f", "go", "m.go", "h1", "f(x)", None), ("b", "Function", "g", "m.g", "go", "m.go", "h2", None, None)], "id string, kind string, name string, qualified_name string, lang string, file_path string, code_hash string, signature string, valid_to string")
    e = spark.createDataFrame([("1", "CALLS", "a", "b", None)], "id string, kind string, from_id string, to_id string, valid_to string")
    p = Z.prompts(n, e, spark.createDataFrame([("a", "func f() {}")], "id string, code string"))
    text = {r.node_id: r.prompt for r in p.collect()}
    assert "Callees:\n- m.g" in text["a"] and "func f() {}" in text["a"] and "Callers:\n- m.f" in text["b"]
    got = {r.node_id: r for r in Z.summarise(p, n, lambda xs: ['{"summary": "S", "tags": ["t"]}' if "Name: m.f" in x else None for x in xs]).collect()}
    assert got["a"].summary == "S" and got["a"].tags == ["t"] and not got["a"].failed and got["b"].failed and got["b"].summary == "Function m.g."


def test_evaluation_over_the_tools(spark):
    n = spark.createDataFrame([("a", "Function", "f", "m.f", "go", "m.go", 1, "f(x)", None), ("b", "Function", "g", "m.g", "go", "m.go", 5, "g()", None)], "id string, kind string, name string, qualified_name string, lang string, file_path string, start_line int, signature string, valid_to string")
    e = spark.createDataFrame([("1", "CALLS", "a", "b", None)], "id string, kind string, from_id string, to_id string, valid_to string")
    qs = [{"id": "q1", "expected_tool": "find_definition", "expected_params": {"symbol_name": "f"}}, {"id": "q2", "expected_tool": "callers", "expected_params": {"function_name": "g", "max_depth": "2"}}, {"id": "q3", "expected_tool": "sig", "expected_params": {"search": "none*"}}]
    got = E.run_queries(qs, n, e)
    want = E.resolve_expected(spark.createDataFrame([("q1", "m.f", "m.go"), ("q2", "m.f", "elsewhere.go")], "query_id string, qualified_name string, file_path string"), n)
    scores = {r.query_id: (r.precision, r.recall) for r in E.prf(want, got, ["id"], spark.createDataFrame([(q["id"],) for q in qs], "query_id string")).collect()}
    assert scores == {"q1": (1.0, 1.0), "q2": (1.0, 1.0), "q3": (1.0, 1.0)}


def test_table_functions(spark):
    sql.register(spark, lambda xs: [[float(len(x))] for x in xs])
    text = "class A {\n void f() { if (x) { g(); } }\n}\n"
    spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("texts")
    rows = lambda f: [tuple(r) for r in spark.sql(f"select s.* from texts, lateral {f}('a.java', 'java', t) s").collect()]
    assert rows("extract_blocks")[0][:4] == ("if", None, "f", 2) and ("CALLS", "f", "g", 2) in rows("extract_references") and len(rows("extract_symbols")) == 4
    assert [r.name for r in spark.sql("select s.name from (select 'the Parser fails in run_it' t) x, lateral identifiers(x.t) s").collect()] == ["Parser", "fails", "run_it"]
    assert spark.sql("select encode_text('abc') v").first().v == [3.0]
    assert spark.sql("select edge_id('a', 'CALLS', 'b', null, null, 0.7D) = substr(sha2('a:CALLS:b:::0.7', 256), 1, 24) x").first().x
