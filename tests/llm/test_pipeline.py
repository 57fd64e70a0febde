"""The pipeline against brute force on a small table, stage by stage."""

import random

import corpus_pipeline as P
from codequarry.llm.fertility import quality_rules

from .helpers import BLANK, cut, hits, near_groups
from .test_text_operators import expected_ids, some_docs

#: Prose-like words, so that the first stage keeps some texts.
VOCAB = [a + b for a in "the and thing reason other under water later".split() for b in "er ing ation ed s ly ness able".split()]

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, rows, name, sf_dir):
    f = dict(P.STAGES)[name]
    return f(spark, spark.createDataFrame(rows, COLS), sf_dir).collect()


def test_stages(spark, tmp_path):
    r = random.Random(11)
    items = [(1, " ".join(r.choice(VOCAB) for _ in range(30))), (2, " ".join(r.choice(VOCAB) for _ in range(30)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = some_docs(12, 80, VOCAB) + [(500, " ".join(VOCAB[:40]) + " " + items[0][1] + "!! " + " ".join(VOCAB[50:90])), (501, items[0][1] + " . " + items[1][1])]
    docs = [(d, t, "en", "s", len(t or "")) for d, t in texts]
    spark.createDataFrame(docs, COLS).write.parquet(str(tmp_path / "documents.parquet"))

    got = stage(spark, docs, "quality_rules", str(tmp_path))
    ok = {(x.doc_id, x.n_words) for x in quality_rules(spark.createDataFrame(docs, COLS)).filter("kept").collect()}
    want = [d for d in docs if (d[0], len(BLANK.findall(d[1] or ""))) in ok]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)

    assert 20 < len(want) < len(docs)

    groups = near_groups([d[:2] for d in want], 5, 80)
    keep = {(d, c) for d, _, c in groups if d == c}
    kept = sorted({w for w, g in zip(want, groups, strict=True) if (g[0], g[2]) in keep}, key=str)
    got = stage(spark, want, "near_dedup", str(tmp_path))
    assert sorted(map(tuple, got), key=str) == kept

    got = stage(spark, kept, "substring_dedup", str(tmp_path))
    lost = {(d, h): n for d, _, n, h in cut([k[:2] for k in kept])}
    import hashlib

    for x in got:
        assert (x.doc_id, hashlib.sha256(" ".join(BLANK.findall(x.text)).encode()).hexdigest()) in lost and x.n_chars == len(x.text)
    assert len(got) == len(kept)

    before = [tuple(x) for x in got]
    got = {x.doc_id: x for x in stage(spark, before, "decontamination", str(tmp_path))}
    judged = {h[0]: h for h in hits([b[:2] for b in before], items)}
    assert set(got) == {d for d, h in judged.items() if not h[5]} and 501 not in got
    for b in before:
        if b[0] in got:
            assert hits([(b[0], got[b[0]].text)], items)[0][2] == 0
            assert judged[b[0]][2] or got[b[0]].text == b[1]

    last = [tuple(x) for x in got.values()]
    pieces = stage(spark, last, "packing", str(tmp_path))
    want = {d[0]: len(x) for d, x in zip(last, expected_ids([d[:2] for d in last]), strict=True)}
    seen = dict.fromkeys(want, 0)
    for p in pieces:
        seen[p.doc_id] += p.length
    assert seen == want

    whole = P.run(spark, str(tmp_path))
    assert sorted((p.doc_id, p.start, p.length) for p in whole.collect()) and {p.doc_id for p in whole.collect()} == set(want)


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null ids and columns that clash with names the operators use."""
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = COLS + ", carried string, _h long, _id long, runs string, kept_text string, _text string, n_words int"
    prose = " ".join(VOCAB[:45])
    lines = "\n".join(" ".join(VOCAB[i : i + 9]) for i in range(0, 54, 9)) + "\n\n\tlast line of the text here"
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(None, prose, "en", "s", 1), (7, f"{lines}\n{passage}\n\nend", "en", "s", 1), (3, f"{passage} {prose}", "en", "s", 1), (8, None, "en", "s", 0), (9, "", "en", "s", 0)]
    df = spark.createDataFrame([(*r, "c", 1, 2, "r", "k", "t", 5) for r in rows], more)
    for name, f in P.STAGES[:-1]:
        got = f(spark, df, str(tmp_path))
        assert got.columns == df.columns
        found = {r.doc_id: r for r in got.collect()}
        assert all(r.carried == "c" and r._h == 1 and r.kept_text == "k" and r.runs == "r" for r in found.values())
        if name == "substring_dedup":
            assert found[7].text == f"{lines}\nend" and found[7].n_chars == len(found[7].text) and found[None].text == prose
        assert f(spark, df.limit(0), str(tmp_path)).count() == 0
    assert P.packing(spark, df, str(tmp_path)).filter("doc_id is null").count() == 1
