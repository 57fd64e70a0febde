"""Operators 2 and 5: held-out accuracy, exact Viterbi, odd cases."""

import random
import zlib

import numpy as np

from codequarry.llm import language as L
from codequarry.llm import quadratic as Q

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in L.identify_languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [d for d, r in got.items() if r.held_out]
    assert sorted(out) == sorted(d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0)
    assert np.mean([got[d].lang_pred == truth[d] for d in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixed_text_has_spans_and_odd_texts_are_und(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.learn_languages(docs)
    one = {x: docs.filter(f"lang = '{x}' and n_chars > 900").orderBy("doc_id").first().text.split()[:100] for x in ("en", "de")}
    rows = [(1, " ".join(one["en"] + one["de"])), (2, None), (3, ""), (4, "123 ... !! ×"), (5, "Привет мир"), (6, " ".join(one["de"])), (6, " ".join(one["en"]))]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = [r for r in L.identify_languages(df, model).collect()]
    by = {r.doc_id: r for r in got if r.doc_id != 6}
    assert [s.lang for s in by[1].spans] == ["en", "de"] and abs(by[1].spans[0].end - 100) <= 3
    assert {by[i].lang_pred for i in (2, 3, 4)} == {"und"} and by[5].lang_pred in model.langs
    assert sorted(r.lang_pred for r in got if r.doc_id == 6) == ["de", "en"]


def test_every_script_can_be_learned(spark):
    say = {"ka": "ეს არის ქართული ტექსტი", "am": "ይህ የአማርኛ ጽሑፍ ነው", "km": "នេះជា អត្ថបទ ខ្មែរ", "dv": "މިއީ ދިވެހި ލިޔުމެކެވެ", "hy": "սա հայերեն տեքստ է և", "he": "זה טקסט בעברית", "my": "ဤ မြန်မာ စာ ဖြစ်သည်", "th": "นี่ คือ ข้อความ ไทย", "hi": "यह हिन्दी पाठ है", "bn": "এটি বাংলা লেখা", "ja": "これは にほんご の ぶんしょう", "zh": "这是 中文 文字", "ko": "이것은 한국어 글", "ff": "𞤀𞤣𞤤𞤢𞤥 𞤆𞤵𞤤𞤢𞤪", "vi": "ở ổ ấy", "en": "“this” is — an English text"}
    rows = [(1000 * k + i, x, t) for k, (x, t) in enumerate(say.items()) for i in range(9 if x == "en" else 3)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert {r[1] for r in rows} == set(say)
    got = L.identify_languages(spark.createDataFrame([(d, t, x) for d, x, t in rows], "doc_id long, text string, lang string")).collect()
    want = {d: x for d, x, _ in rows}
    assert all(r.lang_pred == want[r.doc_id] and r.score == 1 for r in got)


def test_a_draw_keeps_rare_languages(spark):
    rows = [(i, f"common words number {i}", "en") for i in range(2000)] + [(5000 + 10 * k + i, f"rare{k} saying", f"r{k}") for k in range(8) for i in range(10)]
    model = L.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=300)
    assert model.langs == sorted(["en", *(f"r{k}" for k in range(8))])
    assert L._bound({"a": 2000, "b": 10}, 300) == 290 and L._bound({"a": 5, "b": 7}, 300) == 7
    plain = [(i, "x y", x) for i, x in enumerate(["en"] * 3000 + ["zz"])]
    assert "zz" in L.learn_languages(spark.createDataFrame([(i + 1 + (i == 3000), t, x) for i, t, x in plain], "doc_id long, text string, lang string"), most_rows=150).langs


def test_best_path_is_exact():
    r = np.random.default_rng(1)
    for _ in range(40):
        sizes = r.integers(0, 9, size=5)
        off = np.concatenate(([0], np.cumsum(sizes)))
        s = r.normal(0, 3, size=(off[-1], 3))
        got = L.best_path(s, off, 2.5)
        for a, b in zip(off, off[1:], strict=False):
            if a == b:
                continue
            worth = lambda p: sum(s[a + i, x] for i, x in enumerate(p)) - 2.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
            v = s[a].copy()
            for t in range(a + 1, b):
                v = np.maximum(v, v.max() - 2.5) + s[t]
            assert abs(worth(got[a:b]) - v.max()) < 1e-9


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify_languages(none).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.identify_languages(one).first().lang_pred == "und"


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in Q.quality_scores(docs, labels).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    out = [d for d in y if got[d].held_out]
    good, bad = [got[d].score for d in out if y[d]], [got[d].score for d in out if not y[d]]
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.97
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_odd_cases(spark):
    docs = spark.createDataFrame([(i, random.Random(i).choice(["a b c. ", "## !! "]) * (i % 5), "s") for i in range(40)] + [(50, None, "s"), (51, "", "s"), (None, "x y", "s"), (3, "again", "s")], "doc_id long, text string, x string")
    labels = [(i, i % 2, 0) for i in range(40)] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (3, 7, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.quality_scores(docs, lab).collect()
    assert len(got) == 44 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.quality_scores(docs, lab.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in Q.quality_scores(docs, lab.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), lab).count() == 0


def test_quality_scores_are_the_densities(spark):
    """The model and its scores against densities written out, with numpy's own determinant and inverse."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    x = {d: v for d, v in Q.only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(Q._measure, "doc_id long, x array<double>").collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    data = {c: np.array([x[d] for d, q in y.items() if q == c and d in x]) for c in (0, 1)}
    n = sum(map(len, data.values()))
    every = np.vstack([data[0], data[1]])
    mean, scale = every.mean(axis=0), np.sqrt(np.maximum(every.var(axis=0), 1e-12)) + 1e-6
    z = {c: (v - mean) / scale for c, v in data.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in z.items()}
    pooled = sum(len(z[c]) * cov[c] for c in z) / n
    log = {}
    some = sorted(x)[:200]
    for c in z:
        v = (1 - Q.TO_POOLED) * cov[c] + Q.TO_POOLED * pooled
        v = (1 - Q.TO_UNIT) * v + Q.TO_UNIT * max(np.trace(v) / len(v), 1e-6) * np.eye(len(v))
        d = (np.array([x[i] for i in some]) - mean) / scale - z[c].mean(axis=0)
        log[c] = np.log(len(z[c]) / n) - 0.5 * np.linalg.slogdet(v)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(v), d)
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))
    got = {r.doc_id: r.score for r in Q.quality_scores(docs, labels).collect()}
    assert np.allclose([got[i] for i in some], want, atol=1e-6)


def test_long_texts_for_models(spark):
    big = " ".join(f"the{i % 977}" for i in range(300_000))
    rows = [(i, big if i == 1 else "y" * 1_000_000 if i == 2 else f"the text {i}", "en") for i in range(1, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert {r.lang_pred for r in L.identify_languages(df).collect()} == {"en"}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    assert Q.quality_scores(df, labels).count() == 11
