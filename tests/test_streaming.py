from codequarry.streaming import watch as W


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("2024-01-01 00:00:00", "modified", "a.py", None), ("2024-01-01 00:00:01", "moved", "a.py", "b.py"), ("2024-01-01 00:00:09", "created", "c.java", None), ("2024-01-01 00:00:09", "created", "c.png", None), ("2024-01-01 01:00:00", "created", "last.py", None)]
    df = spark.createDataFrame(rows, "ts string, event string, path string, dest string").selectExpr("cast(ts as timestamp) ts", "event", "path", "dest")
    df.coalesce(1).write.parquet(str(src))
    want = sorted((str(r.start), tuple(r.paths)) for r in W.debounce(W.paths_of(df)).collect())
    got = []
    q = W.watch(spark.readStream.schema(df.schema).parquet(str(src)), lambda b, i: got.extend((str(r.start), tuple(r.paths)) for r in b.collect()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    assert sorted(got) == want[:-1] and want[0][1] == ("a.py", "b.py")  # the last burst waits for the watermark


def test_store_moves_the_pointer_last(spark, tmp_path):
    from codequarry.store import GraphStore

    s = GraphStore(spark, str(tmp_path / "g"))
    assert s.current() is None
    nodes = spark.createDataFrame([("a", "go")], "id string, lang string")
    s.write("c1", nodes=nodes, edges=spark.createDataFrame([("e",)], "id string"))
    s.write("c2", nodes=nodes.union(spark.createDataFrame([("b", "go")], "id string, lang string")))
    assert s.current()[0] == "c2" and s.table("nodes").count() == 2 and s.table("edges").count() == 1
    assert s.query("select count(*) n from nodes where lang = :l", l="go").first().n == 2 and s.violations("nodes").isEmpty()


def test_sql_functions(spark):
    from codequarry.functions import sql

    sql.register(spark)
    assert abs(spark.sql("select cosine(array(1D, 0D), array(1D, 1D)) c").first().c - 0.70710678) < 1e-6
    got = spark.sql("select s.kind, s.name from (select 'def f(): g()' t) x, lateral extract_symbols('a.py', 'python', x.t) s").collect()
    assert ("Function", "f") in [(r.kind, r.name) for r in got]
