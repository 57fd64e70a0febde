import hashlib
import subprocess

import pytest

from codequarry import schema as S
from codequarry import update as U
from codequarry.index import index
from codequarry.operators import blocks as B
from codequarry.operators import lookup as L
from codequarry.operators import references as R
from codequarry.operators import traverse as G
from codequarry.operators import rank as K
from codequarry.operators import summarize as Z
from codequarry.operators import traces as C
from codequarry.sources import git, walk
from codequarry.sources.extract import extract_text
from codequarry.store import GraphStore

JAVA = """package x;
import java.util.List;
/* class Ghost {} */
public class Foo extends Base implements I {
  @Autowired Svc svc;
  public Foo(int a) { }
  @Override public int run(String s, List<A> b) { if (s.isEmpty()) { for (;;) { help(s); } } return 1; }
  void help(String s) { }
}
"""


def rows(lang, text, what):
    return [(r["kind"], r.get("name"), r.get("target")) for r in extract_text(f"a/m.{lang}", lang, text) if r["what"] == what]


def test_java():
    kinds = {(k, n) for k, n, _ in rows("java", JAVA, "node")}
    assert {("Class", "Foo"), ("Field", "svc"), ("Constructor", "Foo"), ("Method", "run"), ("Method", "help")} == kinds
    refs = {(k, t) for k, _, t in rows("java", JAVA, "ref")}
    assert {("EXTENDS", "Base"), ("IMPLEMENTS", "I"), ("INJECTS", "Svc"), ("OVERRIDES", "run"), ("CALLS", "help"), ("IMPORTS", "java.util.List"), ("TYPES", "Svc")} <= refs
    assert [r["depth"] for r in extract_text("m", "java", JAVA) if r["what"] == "block"] == [1, 2]
    far = "class A {\n  @Override\n  @Deprecated(since = \"a{b}\")\n" + "  // note\n" * 30 + "  public int far(int x) { if (" + "x > 0 && " * 100 + "true) { g(); } return 1; }\n  @Inject A(Svc s, @Named(\"q\") Other<T> o) {}\n}\n"
    got = extract_text("m", "java", far)
    assert ("OVERRIDES", "far") in {(r["kind"], r.get("target")) for r in got} and [r["kind"] for r in got if r["what"] == "block"] == ["if"]
    assert {(r["target"], r["dep_kind"]) for r in got if r["kind"] == "INJECTS"} == {("Svc", "inject"), ("Other<T>", "inject")}


def test_python_and_others():
    text = "class A(B):\n  x: int\n  def m(self, *a): return f(1)\nasync def f(x=1):\n  for i in x:\n    if i: g = lambda q, b: q + i\n"
    assert {("Class", "A"), ("Field", "x"), ("Function", "m"), ("Function", "f")} == {(k, n) for k, n, _ in rows("python", text, "node")}
    assert [(r["kind"], r["depth"], r["captures"]) for r in extract_text("m", "python", text) if r["what"] == "block"] == [("for", 1, []), ("if", 2, []), ("lambda", 3, ["i"])]
    assert ("lambda", "lambda(q, b)", None) in rows("python", text, "block")
    assert ("Method", "M", None) in rows("go", "type S struct {\n A int\n}\nfunc (s *S) M(a int) string { return f() }\n", "node")
    rust = "struct P;\ntrait T {}\nimpl T for P { fn go(&self) { let y = 2; let c = |a, b: i32| a + b + y; loop { v.map(|x| { x * y }); } } }\n"
    assert ("IMPLEMENTS", None, "T") in rows("rust", rust, "ref")
    assert [(r["kind"], r["name"], r["depth"], r["captures"]) for r in extract_text("m", "rust", rust) if r["what"] == "block"] == [("lambda", "|a, b|", 1, ["y"]), ("loop", None, 1, []), ("lambda", "|x|", 2, ["y"])]
    assert ("INHERITS", None, "B") in rows("cpp", "class D : public B { };\n", "ref") and ("CROSS_FILE_CALL", None, "ns::x") in rows("cpp", "ns::x;\n", "ref")
    ts = "class K extends L { private go(a: number): void { if (a) { b(a); } } }\nconst f = (x: number): number => { return g(x); };\n"
    assert {("Class", "K"), ("Method", "go"), ("Function", "f")} == {(k, n) for k, n, _ in rows("typescript", ts, "node")} and ("CALLS", None, "g") in rows("typescript", ts, "ref")
    assert extract_text("m", "python", "  \n") == [] and extract_text("m", "python", "def (") == []


def test_bytes_and_lines():
    text = "# é\nclass A:\n  def m(self): return 'ü'\n"
    for r in extract_text("m.py", "python", text):
        if r["what"] == "node":
            part = text.encode()[r["start_byte"] : r["end_byte"]].decode()
            assert part.startswith({"A": "class", "m": "def"}[r["name"]]) and r["code_hash"] == hashlib.sha256(part.encode()).hexdigest()[:24]
    java = "// é\nclass A { void m() { } }\n"
    spans = {r["name"]: java.encode()[r["start_byte"] : r["end_byte"]].decode() for r in extract_text("m", "java", java) if r["what"] == "node"}
    assert spans == {"A": "class A { void m() { } }", "m": "m() { }"}


def files_of(spark, **texts):
    lang = {"py": "python", "java": "java", "rs": "rust", "cpp": "cpp", "ts": "typescript", "go": "go", "tsx": "tsx"}
    rows_ = [(name.replace("__", "/").replace("_", ".", 1) if "_" in name else name, t) for name, t in texts.items()]
    return spark.createDataFrame([(p, lang[p.rpartition(".")[2]], bytearray(t.encode())) for p, t in rows_], "path string, lang string, content binary")


def test_index_then_query_in_every_language(spark):
    """The graph that index makes can be walked, counted and stored as it is."""
    g = index(
        files_of(
            spark, a_py="class A:\n  def m(self): return f()\nclass B(A):\n  def m(self): pass\ndef f(): g()\ndef g(): pass\n", a_java="import x.Y;\nclass J extends K { @Override int run() { return help(); } int help() { return 1; } }\n",
            b_java="class K { int run() { return 0; } }\n", a_rs="struct P;\ntrait T { fn t(&self); }\nimpl T for P { fn t(&self) { if true { q(); } } }\nfn q() {}\n", a_cpp="#include <vector>\nclass C { public: void m() { n(); } void n() { } };\n",
            a_ts="import {z} from 'z';\nfunction u() { return v(); }\nfunction v() { return 1; }\n", a_go="package a\nfunc w() { x() }\nfunc x() { }\n", b_tsx="function r() { return s(); }\nfunction s() { return 1; }\n",
        ),
        "p", "c1",
    )
    assert [f.name for f in S.EDGES] == g["edges"].columns and {f.name for f in S.NODES} <= set(g["nodes"].columns)
    name = {r.id: f"{r.lang}:{r.name}" for r in g["nodes"].collect()}
    edges = g["edges_raw"].collect()
    assert all(e.from_id in name for e in edges) and len({e.id for e in edges}) == len(edges) and all(e.valid_from == "c1" and e.valid_to is None for e in edges)
    got = {(e.kind, name[e.from_id], name.get(e.to_id)) for e in edges}
    calls = {("python:m", "python:f"), ("python:f", "python:g"), ("java:run", "java:help"), ("rust:t", "rust:q"), ("cpp:m", "cpp:n"), ("typescript:u", "typescript:v"), ("go:w", "go:x"), ("tsx:r", "tsx:s")}
    assert {(a, b) for k, a, b in got if k == "CALLS"} == calls and {e.confidence for e in edges if e.kind == "CALLS"} == {0.7}
    assert {("CONTAINS_METHOD", "python:A", "python:m"), ("CONTAINS_METHOD", "python:B", "python:m")} <= got  # one node, two parents
    assert {("OVERRIDES", "java:run", "java:run"), ("EXTENDS", "java:J", "java:K"), ("INHERITS", "python:B", "python:A"), ("IMPLEMENTS", "rust:P", "rust:T")} <= got
    assert {"IMPORTS", "INCLUDES", "DEPENDS_ON", "CONTAINS_BLOCK", "CONTAINS_CLASS", "CONTAINS_FUNCTION"} <= {k for k, _, _ in got}
    target = next(i for i, n in name.items() if n == "python:g")
    assert sorted(r.name for r in G.find_callers(g["nodes"], g["edges"], target, 3).collect()) == ["f", "m"]
    assert R.find_references(L.find_definition(g["nodes"], "help"), g["nodes"], g["edges"]).count() == 1


def test_index_resolves_across_files_and_local_first(spark):
    files = spark.createDataFrame([("a/callee.py", "python", bytearray(b"def far(): pass\ndef near(): pass\n")), ("a/caller.py", "python", bytearray(b"def near(): pass\ndef go():\n    far()\n    near()\n"))], "path string, lang string, content binary")
    g = index(files, "p", "c1")
    n = {r.id: r.qualified_name for r in g["nodes"].collect()}
    calls = {(n[r.from_id], n[r.to_id]) for r in g["edges"].filter("kind = 'CALLS'").collect()}
    assert calls == {("caller.go", "callee.far"), ("caller.go", "caller.near")}


def test_ignore_rules():
    r = walk.parse_rules("# note\n*.log\n!keep.log\nbuild/\n/top\na/**/z\n")
    ig = lambda p, d=False: walk.should_ignore(r, p, d)
    assert ig("x/y.log") and not ig("x/keep.log") and ig("build", True) and not ig("build") and ig("build/f.py")
    assert ig("top") and not ig("x/top") and ig("a/b/c/z") and not ig("../x.log")
    assert walk.ignore_rules("") == [] and walk.should_ignore(walk.ignore_rules(None), "node_modules/a.js", False)


def test_walk_and_git(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.py").write_text(" \n")
    (tmp_path / "build").mkdir()
    (tmp_path / "build/c.py").write_text("y\n")
    assert [r.path for r in walk.walk(spark, str(tmp_path)).collect()] == ["src/a.py"]
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    assert {r.path for r in git.snapshot(spark, str(tmp_path)).collect()} == {"src/a.py", "src/b.py", "build/c.py"}
    (tmp_path / "src/a.py").write_text("x = 2\n")
    assert [(r.path, r.status) for r in git.diff(spark, str(tmp_path), "HEAD").collect()] == [("src/a.py", "M")]


TRACES = [
    ("p", 'Traceback (most recent call last):\n  File "a/x.py", line 3, in A.run\n    f()\nValueError: bad thing here'),
    ("j", "java.lang.NullPointerException: oops here now\n\tat com.x.Foo.run(Foo.java:12)\n\tat com.x.Foo.nat(Native Method)\n"),
    ("c", "terminate\n#0  0x0001 in ns::Foo::bar (this=0x0) at src/foo.cpp:42\n"),
    ("r", "thread 'main' panicked at 'index out of bounds', src/main.rs:4\nstack backtrace:\n   0: app::work::go\n             at src/main.rs:4\n"),
    ("u", "nothing to see"),
]


def test_traces(spark):
    t = spark.createDataFrame(TRACES, "trace_id string, text string")
    f = {(r.trace_id, r.frame_index): (r.function_name, r.class_name, r.file_path, r.line_number, r.is_native) for r in C.frames(t).collect()}
    assert f[("p", 0)] == ("run", "A", "a/x.py", 3, False)
    assert f[("j", 0)] == ("run", "com.x.Foo", "Foo.java", 12, False) and f[("j", 1)][4]
    assert f[("c", 0)] == ("bar", "ns::Foo", "src/foo.cpp", 42, False)
    assert f[("r", 0)][0] == "panic" and f[("r", 1)][0] == "go" and not [k for k in f if k[0] == "u"]
    e = {r.trace_id: (r.language, r.error_type) for r in C.errors(t).collect()}
    assert e["p"] == ("python", "ValueError") and e["j"] == ("java", "java.lang.NullPointerException") and e["r"] == ("rust", "panic") and e["u"] == ("python", "UnknownError")
    nodes = spark.createDataFrame([("n1", "Function", "run", "x.run", "python", "/r/a/x.py", 1, 9, None)], "id string, kind string, name string, qualified_name string, lang string, file_path string, start_line int, end_line int, valid_to string")
    rep = {r.trace_id: r for r in C.report(t, nodes).collect()}
    assert rep["p"].mapped_frames == 1 and rep["u"].total_frames == 0 and rep["j"].category == "null_pointer"


def test_snippet_and_summary(spark):
    f = spark.createDataFrame([("a\nb\nc\nd", 2, 9), ("x\x00y", 1, 1)], "text string, start_line int, end_line int")
    assert [r.snippet for r in B.snippet(f).collect()] == ["b\nc\nd", ""]
    a = spark.createDataFrame([('```json\n{"summary": "s"}\n```',), ("nope",)], "t string").select(Z.parse_answer(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("a"))
    assert [r.a and r.a.summary for r in a.collect()] == ["s", None]


def test_fuse_weights(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id int, score double")
    k = spark.createDataFrame([(2, 7.0), (3, 1.0)], "id int, score double")
    assert [r.id for r in K.fuse(v, k, 1, 0).collect()][0] == 1
    assert [r.id for r in K.fuse(v, k, 0, 1).collect()][0] == 2


def test_update_from_git_and_workspace(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True).stdout.decode().strip()
    run("init", "-q")
    assert {(r.path, r.status) for r in git.diff(spark, str(repo), "HEAD").collect()} == set()
    (repo / "a.py").write_text("def f(): g()\ndef g(): pass\n")
    (repo / "b.py").write_text("def h(): g()\n")
    (repo / "note.txt").write_text("x\n")
    assert {r.path for r in U.changed(spark, str(repo), "HEAD").collect()} == {"a.py", "b.py"}  # all files, when there is no commit
    run("add", "-A")
    run("commit", "-qm", "one")
    one = run("rev-parse", "HEAD")
    store = GraphStore(spark, f"file://{tmp_path}/g")
    g = index(U._files(git.snapshot(spark, str(repo), one)), "p", one)
    store.write(one, nodes=g["nodes"], edges=g["edges"], blocks=g["blocks"])
    (repo / "a.py").write_text("def f(): pass\ndef g(): pass\ndef new(): h()\n")
    (repo / "b.py").unlink()
    (repo / "c.py").write_text("def h():\n  if 1: g()\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    two = run("rev-parse", "HEAD")
    assert not U.dry_run(spark, str(repo), one, two).first().exceeds and U.dry_run(spark, str(repo), one, two, most=10).first().warning
    with pytest.raises(U.TooLarge):
        U.update_from_git(store, str(repo), one, two, "p", most=10)
    assert store.current()[0] == one
    diff = U.update_from_git(store, str(repo), one, two, "p")
    changes = {(r.edge_type, r.name) for r in U.results(diff).collect()}
    assert {("ADDED", "new"), ("ADDED", "h"), ("DELETED", "h"), ("UPDATED", "f"), ("UPDATED", "a.py")} <= changes and ("UPDATED", "g") not in changes
    assert store.current()[0] == two
    live = store.table("nodes").filter("valid_to is null")
    whole = index(U._files(git.snapshot(spark, str(repo), two)), "p", two)
    pick = lambda df: sorted((r.id, r.code_hash) for r in df.collect())
    assert pick(live) == pick(whole["nodes"])
    e = lambda df: sorted(r.id for r in df.filter("valid_to is null").collect())
    assert e(store.table("edges")) == e(whole["edges"]) and store.table("nodes").filter("valid_to is not null").count() >= 3
    (repo / "d.py").write_text("def fresh(): new()\n")
    got = U.apply_workspace_diff(store, str(repo), "p")
    assert {r.name for r in U.results(got).collect()} == {"d.py", "fresh"} and store.current()[0] == two
    target = store.table("nodes").filter("name = 'new'").first().id
    assert [r.name for r in G.find_callers(store.table("nodes"), store.table("edges"), target).collect()] == ["fresh"]


def test_walk_lists(spark, tmp_path):
    for p in ("src/a.py", "src/__init__.py", "src/B.HH", ".hid/x.py", ".venv/v.py", "venv/w.py", "vendor/k.go", "build/c.py", "gen/e.py", "src/f.pyi"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(walk.walk(spark, str(tmp_path))) == ["gen/e.py", "src/B.HH", "src/__init__.py", "src/a.py", "vendor/k.go"]
    assert paths(walk.walk(spark, str(tmp_path), exclude_globs=("gen/*", "*.HH"))) == ["src/__init__.py", "src/a.py", "vendor/k.go"]
    assert paths(walk.index_folder_files(spark, str(tmp_path))) == [".hid/x.py", "gen/e.py", "src/B.HH", "src/__init__.py", "src/a.py", "vendor/k.go"]
    assert walk.parse_file(spark, f"{tmp_path}/src/a.py").first().lang == "python"
    with pytest.raises(ValueError):
        walk.parse_file(spark, f"{tmp_path}/src/f.pyi")
    with pytest.raises(FileNotFoundError):
        walk.parse_file(spark, f"{tmp_path}/none.py")


def test_reports_and_similar_issues(spark):
    t = spark.createDataFrame(TRACES, "trace_id string, text string")
    nodes = spark.createDataFrame([("n1", "Function", "run", "x.run", "python", "/r/a/x.py", 1, 9, None)], "id string, kind string, name string, qualified_name string, lang string, file_path string, start_line int, end_line int, valid_to string")
    rep = C.report(t, nodes, semantic=spark.createDataFrame([("java", "function nat class com.x.Foo", "n1")], "lang string, name string, id string"))
    got = {r.trace_id: r for r in rep.collect()}
    assert got["p"].category == "value_error" and got["p"].related == ["n1"] and got["r"].category == "out_of_bounds"
    assert {r.how for r in C.map_frames(C.frames(t), nodes, spark.createDataFrame([("java", "function nat class com.x.Foo", "n1")], "lang string, name string, id string")).collect()} >= {"location", "semantic"}
    assert "**Category:** value_error (medium)" in C.report_markdown(rep).filter("trace_id = 'p'").first().value and '"trace_id":"p"' in C.report_json(rep).filter("trace_id = 'p'").first().value
    past = spark.createDataFrame([("i1", "ValueError", "bad thing there"), ("i2", "ValueError", "other"), ("i3", "KeyError", "bad thing here")], "issue_id string, error_type string, message string")
    assert [(r.trace_id, r.issue_id, r.score) for r in C.similar_issues(t, past).collect()] == [("p", "i1", 0.5)]
    files = spark.createDataFrame([("a/x.py", "one\ntwo\nthree\nfour")], "file_path string, text string")
    assert ">   3 three" in C.with_snippets(C.frames(t), files, 1).filter("trace_id = 'p'").first().snippet
