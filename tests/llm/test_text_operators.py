"""Operators 4 and 6 to 10 against brute force, and their odd cases."""

import random
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import fertility
from codequarry.llm import superminhash as M
from codequarry.llm._tokens import vocabulary, word_bpe
from codequarry.llm._words import BLANK, words
from codequarry.llm.bestfit import best_fit_decreasing, pack_best_fit, segments
from codequarry.llm.fertility import quality_rules
from codequarry.llm.hilbert import hilbert_key, pack_along_curve
from codequarry.llm.substring import SubstringIndex, apply_cuts, cut_duplicates
from codequarry.llm.winnowing import contamination

from .helpers import base_rules, cut, hits, near_groups

DOC = "doc_id long, text string"
VOCAB = [f"w{i}" for i in range(400)]


def some_docs(seed=1, n=60, vocab=VOCAB):
    """Texts with exact and near copies, shared passages, repeats, odd and empty ones; ids repeat and are null."""
    r = random.Random(seed)
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, docs = say(70), []
    for i in range(n):
        w = say(r.choice([0, 1, 3, 7, 20, 60, 150]))
        kind = i % 6
        if kind == 1 and docs:
            w = (docs[r.randrange(len(docs))][1] or "").split()
            for _ in range(r.randrange(4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        elif kind == 2:
            at = r.randrange(len(w) + 1)
            w = w[:at] + passage[r.randrange(8) :] + w[at:]
        elif kind == 3:
            w = w * 2
        docs.append((i, r.choice([" ", "\n", "  \t", "\r\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, " \n\t"), (103, "É" * 5 + " | # $x"), (5, "another text of id five"), (None, docs[8][1]), (None, "alone"), docs[4], docs[4], (104, "Ünï cödé 日本語 Привет"), (105, "a b"), (106, "A B"), (107, "\x00 x\x0by")]
    return docs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def odd_frame(spark, docs):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(*d, "z", 1, True) for d in docs], DOC + ", cid string, n_words int, kept boolean")


@pytest.mark.parametrize("small", [64, 1])
def test_near_duplicates(spark, monkeypatch, small):
    """Also with every bucket on the large buckets' way."""
    monkeypatch.setattr(M, "SMALL", small)
    docs = some_docs()
    got = M.near_duplicates(odd_frame(spark, docs), k=4).select("doc_id", "n_shingles", "component_id")
    assert rows(got) == sorted(near_groups(docs, 4, 80), key=str)


def test_near_copies_in_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 4)
    r = random.Random(3)
    base = [r.choice(VOCAB) for _ in range(60)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(60)] = r.choice(VOCAB)
        docs.append((i, " ".join(w)))
    got = M.near_duplicates(spark.createDataFrame(docs, DOC), k=4).select("doc_id", "n_shingles", "component_id")
    assert rows(got) == sorted(near_groups(docs, 4, 80), key=str)


def test_large_groups_of_long_texts_make_smaller_blocks(spark, monkeypatch):
    """Groups over SMALL with texts of very different length."""
    monkeypatch.setattr(M, "SMALL", 4)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 2_000)
    r = random.Random(5)
    base = [r.choice(VOCAB) for _ in range(50)]
    docs = []
    for i in range(60):
        w = base * (1 if i % 10 else 20)
        w = [*w, *(r.choice(VOCAB) for _ in range(3000 if i % 15 == 0 else 0))]
        w[r.randrange(len(w))] = r.choice(VOCAB)
        docs.append((i, " ".join(w)))
    got = M.near_duplicates(spark.createDataFrame(docs, DOC), k=4).select("doc_id", "n_shingles", "component_id")
    assert rows(got) == sorted(near_groups(docs, 4, 80), key=str)


def test_signature_estimates_similarity():
    off = np.array([0, 1000, 2000], dtype=np.int64)
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.arange(112, 1112, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # 889 of 1111 in common
    s = M.signatures(np.concatenate([a, b]), off)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15
    assert sorted(M._place(np.full(128, np.uint64(99)), 0)[:1]) and len({int(M._place(np.array([7], np.uint64), j)[0]) for j in range(128)}) == 128


@pytest.mark.parametrize("gram", [10, 3])
def test_substring(spark, gram):
    docs = some_docs(2, 80)
    got = cut_duplicates(odd_frame(spark, docs), gram=gram).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(got) == sorted(cut(docs), key=str)


PICK = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("order", ["falling", "mixed"])
def test_substring_in_batches_equals_one(spark, order, tmp_path):
    """Whatever the order, over a session's end, before and after compaction."""
    docs = [d for d in some_docs(4, 60) if d[0] is not None]
    df = spark.createDataFrame(docs, DOC)
    batches = [df.filter("doc_id < 20"), df.filter("doc_id between 20 and 39"), df.filter("doc_id between 40 and 69"), df.filter("doc_id >= 70")]
    batches = {"falling": batches[::-1], "mixed": [df.filter(f"doc_id % 3 = {i}") for i in range(3)]}[order]
    index = SubstringIndex(spark, f"file://{tmp_path}/index", fanout=3)
    runs = []
    for i, b in enumerate(batches):
        runs.append(index.add(b))
        if i == 1:  # as in a new session
            index.close()
            index = SubstringIndex(spark, f"file://{tmp_path}/index")
            assert index.fanout == 3 and len(index.runs) == 2
    want = sorted(cut(docs), key=str)

    def judged():
        cuts = [index.duplicates(b, df, run) for b, run in zip(batches, runs, strict=True)]
        return rows(apply_cuts(df, reduce(DataFrame.unionByName, cuts)).select(*PICK))

    assert judged() == want
    index.compact(whole=True)
    assert len(index.runs) == 1 and judged() == want
    index.destroy()


def test_substring_judges_the_batch_alone(spark):
    words_ = [f"w{i}" for i in range(200)]
    docs = {1: words_[:120], 2: words_[:80] + ["x"] * 60, 9: words_[20:140] + ["y"] * 70}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], DOC)
    history, batch = df.filter("doc_id < 9"), df.filter("doc_id = 9")
    index = SubstringIndex(spark)
    first = index.add(history)
    run = index.add(batch)
    cuts = index.duplicates(batch, history, run)
    assert {r.doc_id for r in cuts.collect()} == {9}
    assert apply_cuts(batch, cuts).first().n_removed == 100
    with pytest.raises(ValueError):
        index.duplicates(batch, None, run)
    assert {r.doc_id for r in index.duplicates(history, batch, first).collect()} == {2}
    index.destroy()


def test_a_frequent_fingerprint_is_spread_and_history_is_not_shuffled(spark):
    """A line within many different contexts, and one passage in many documents."""
    r = random.Random(3)
    line, passage = [f"l{i}" for i in range(12)], [f"p{i}" for i in range(70)]
    docs = [(i, " ".join([r.choice(VOCAB) for _ in range(45)] + line + [r.choice(VOCAB) for _ in range(45)] + (passage if i % 2 else []))) for i in range(150)]
    df = spark.createDataFrame(docs, DOC).coalesce(1)
    got = cut_duplicates(df, batches=4).select(*PICK)
    assert rows(got) == sorted(cut(docs), key=str)
    index = SubstringIndex(spark)
    index.add(df.filter("doc_id < 75"))
    run = index.add(df.filter("doc_id >= 75"))
    assert index._rows(1, *index._live()).select("b").distinct().count() > 20
    own, old = (index._rows(0, r["id"]) for r in index.runs[::-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = own.select("b").join(old.select("b", "span"), "b")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan and index._find is not None and run
    index.destroy()


def test_cut_text_keeps_lines(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(1, passage), (2, f" a\n\tb  {passage}\n\nc\td \n"), (3, f"e\n{passage}"), (4, "x\ny")]
    got = {r.doc_id: r.kept_text for r in cut_duplicates(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {1: passage, 2: " a\n\tb  c\td \n", 3: "e\n", 4: "x\ny"}


@pytest.mark.parametrize("window", [5, 8, 13])
@pytest.mark.parametrize("most", [500_000, 0])
def test_contamination(spark, most, window):
    docs = some_docs(5)
    r = random.Random(9)
    items = [(1, docs[6][1][:200]), (2, " ".join(docs[26][1].split()[3:14])), (3, "w1 w2"), (3, "w7"), (4, None), (5, ""), (None, "w9 w8"), (7, " ".join((docs[6][1] or "").split()[2:12])), (6, " ".join(r.choice(VOCAB) for _ in range(30)))]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, fp int")
    got = contamination(odd_frame(spark, docs), bench, window=window, most_broadcast=most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(got) == sorted(hits(docs, items, window), key=str)


def test_quality_rules(spark):
    docs = some_docs(6) + [(200, "word%%% that*** has### marks&&& all$$$ over### " * 1 + " ".join(f"x{i}%%%" for i in range(40))), (201, " ".join(VOCAB[:60])), (202, "a\nb\na\n\n\na \n" * 4)]
    got = quality_rules(odd_frame(spark, docs))
    assert rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(base_rules(docs), key=str)
    assert not got.filter("kept and base_failed").count() and not got.filter("doc_id = 200 and kept").count()


#: The first article of the Universal Declaration of Human Rights; two-letter keys are languages in Latin letters.
PROSE = {
    'en': 'All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.',
    'vi': 'Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.',
    'pl': 'Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.',
    'tr': 'Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.',
    'fi': 'Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.',
    'cs': 'Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.',
    'greek': 'Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.',
    'cyrillic': 'Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.',
    'hebrew': 'כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.',
    'arabic': 'يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.',
    'devanagari': 'सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।',
    'thai': 'มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ',
    'han': '人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。',
    'kana': 'すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。',
    'hangul': '모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.',
    'georgian': 'ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით.',
    'armenian': 'Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով։ Նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն։',
    'bengali': 'সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে। তাঁদের বিবেক এবং বুদ্ধি আছে; সুতরাং সকলেরই একে অপরের প্রতি ভ্রাতৃত্বসুলভ মনোভাব নিয়ে আচরণ করা উচিত।',
    'tamil': 'மனிதப் பிறவியினர் சகலரும் சுதந்திரமாகவே பிறக்கின்றனர்; அவர்கள் மதிப்பிலும், உரிமைகளிலும் சமமானவர்கள், அவர்கள் நியாயத்தையும் மனச்சாட்சியையும் இயற்பண்பாகப் பெற்றவர்கள்.'
}


def figures(text):
    """The four figures of one text, word by word."""
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    with open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    ids = [i for x in w for i in lib.encode(x)]
    least = max(1, min(len(ids), sum(len(other.encode_ordinary((" " if not i else "") + v[i : i + 1000])) for v in w for i in range(0, len(v), 1000))))
    blocks = [b for b in np.array_split(ids, -(-len(ids) // 4096)) if len(b)] if ids else []
    bits = [sum(-c / len(b) * np.log2(c / len(b)) for c in Counter(b.tolist()).values()) / np.log2(max(len(b), 2)) for b in blocks]
    letters = sum(c.isalnum() if c.isascii() else True for x in w for c in x)
    return sum(map(len, w)) / least, letters / least, np.mean([lib.is_byte(i) for i in ids]) if ids else 0.0, np.mean(bits) if bits else 0.0


def test_fertility_figures_bands_and_verdicts(spark):
    """Prose of every script passes; the same words shouted or decorated don't, where letters tell; each rule has a text that breaks it alone."""
    r = random.Random(8)
    docs = [(i, f"{t} " * 2) for i, t in enumerate(PROSE.values())]  # of 20 words or more, where words have blanks
    shout = [(100 + i, " ".join(w.upper() + "!!" for w in PROSE[x].split())) for i, x in enumerate(("en", "vi", "cs", "greek", "cyrillic", "armenian"))]
    odd = [
        (200, " ".join("abcd"[i % 4] + chr(0x1F600 + i % 60) * 2 + "word" for i in range(80))),  # byte fallback
        (201, " ".join(r.choice(["thing", "water", "other"]) for _ in range(400))),  # few different tokens
        (202, None), (203, ""), (204, " \n"), (205, "w " * 19), (206, "x" * 300_000 + " y" * 30), (207, "\U00010330\U00010331\U00010332 " * 3 + " ".join("\U00010330" * k for k in range(1, 30))),
    ]
    some = [d for d in some_docs(6) if d[0] is not None and d[0] != 5]
    got = {x.doc_id: x for x in quality_rules(odd_frame(spark, [*docs, *shout, *odd, *((1000 + d, t) for d, t in some)])).collect()}
    for d, t in [*docs, *shout, *odd, *((1000 + d, t) for d, t in some)]:
        x = got[d]
        assert np.allclose([x.chars_per_token, x.letters_per_token, x.byte_share, x.entropy], figures(t or "")), (d, t)
        band = fertility.BANDS.get(x.script, fertility.BANDS["other"])
        out = [f for f in fertility.FIGURES if not getattr(band, f)[0] <= getattr(x, f) <= getattr(band, f)[1]]
        assert set(out) == set(x.rejected_by) - {"few_words", "repeats"} and x.kept == (not x.rejected_by)
    assert all(not set(got[d].rejected_by) - {"few_words", "repeats"} for d, _ in docs)
    assert {got[d].script for d, _ in docs} == {"latin", *(k for k in PROSE if len(k) > 2)}
    assert all("letters_per_token" in got[d].rejected_by for d, _ in shout)
    assert "byte_share" in got[200].rejected_by and "entropy" in got[201].rejected_by and got[207].script == "gothic"


def test_quality_rules_do_not_tire_of_long_texts(spark):
    """A long run of clean documents is as clean as they are; a long run of few words is not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'de'")
    clean = docs.join(quality_rules(docs).filter("kept").select("doc_id"), "doc_id").select("doc_id", "text").dropDuplicates(["text"]).orderBy("doc_id").collect()
    r, long = random.Random(2), " ".join(x.text for x in clean)
    dull = " ".join(r.choice(["aa", "bb", "cc"]) for _ in range(60_000))
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame([(1, long), (2, dull)], DOC)).collect()}
    assert got[1].n_tokens > 48_000 and got[1].kept and not got[1].rejected_by
    assert got[2].n_tokens > 48_000 and "entropy" in got[2].rejected_by


def expected_ids(docs):
    lib = word_bpe(vocabulary("word_bpe_49k.json")).lib
    return [np.array(e.ids + [1], dtype="<u4") for e in lib.encode_batch([t or "" for _, t in docs], add_special_tokens=False)]


TRICKY = ["it's 'tis \"'s ''s they'RE", "É À × ÷ ß Ÿ ñandú", "<|endoftext|> a<|b", "12a3!?#x--y", "日本語 Привет İstanbul ﬁ é", "\x00 a\x01b", "x" * 300, "naïve café—dash…"]


def test_array_bpe_is_the_library(spark):
    bpe = word_bpe(vocabulary("word_bpe_49k.json"))
    r = random.Random(1)
    texts = TRICKY + ["".join(r.choice("abcDEF'é×Éñ<|>12 .,!-\n") for _ in range(50)) for _ in range(300)]
    want = expected_ids(list(enumerate(texts)))
    at = 0
    for w in words(pa.array(texts), BLANK):
        ids, off = bpe.documents(w, 1)
        for i in range(len(w)):
            assert ids[off[i] : off[i + 1]].tolist() == want[at].tolist(), texts[at]
            at += 1


@pytest.mark.parametrize("how", ["curve", "best_fit"])
def test_packing(spark, how):
    docs = [d for d in some_docs(7) if d[0] is not None and d[0] not in (4, 5)] + [(300 + i, t) for i, t in enumerate(TRICKY)] + [(400, " ".join(VOCAB * 3))]
    df = odd_frame(spark, docs)
    got = pack_along_curve(df, length=256) if how == "curve" else segments(pack_best_fit(df, length=256))
    want = dict(zip([d for d, _ in docs], expected_ids(docs), strict=True))
    seen, seq = {d: 0 for d in want}, {}
    for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
        seen[r.doc_id] += r.length
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {d: len(x) for d, x in want.items()}
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    if how == "curve":
        assert sorted(seq) == list(range(len(seq))) and sum(n for p in seq.values() for _, n in p) > 256 * (len(seq) - 1)


def test_best_fit_is_the_plain_one_and_its_sequences_are_full(spark):
    """Against a list that is searched through; cumulative lengths, resets and padding of what is written; windows carry what is open."""
    r = random.Random(4)
    sizes = [r.choice([1, 7, 30, 64, 100, r.randrange(1, 101)]) for _ in range(500)]
    room, plain = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room[j], -j) for j in range(len(room)) if room[j] >= sizes[i]]
        if fits:
            j = -min(fits)[1]
        else:
            j = len(room)
            room.append(100)
            plain.append([])
        room[j] -= sizes[i]
        plain[j].append(i)
    got = best_fit_decreasing(sizes, 100)
    assert len(got) == len(plain) and sorted(sum(sizes[i] for i in b) for b in got) == sorted(100 - x for x in room)
    docs = [(i, " ".join(r.choice(VOCAB) for _ in range(r.choice([2, 9, 40, 120])))) for i in range(400)]
    df, fill = spark.createDataFrame(docs, DOC).coalesce(1), {}
    for window in (1_000_000, 20_000):
        rows_ = pack_best_fit(df, length=256, pad=7, window=window).collect()
        for x in rows_:
            ids, n = np.frombuffer(x.ids, "<u4"), x.cu_seqlens[-1]
            assert len(ids) == 256 and x.cu_seqlens[0] == 0 and x.position_resets == x.cu_seqlens[:-1] and (ids[n:] == 7).all()
            assert [b - a for a, b in zip(x.cu_seqlens, x.cu_seqlens[1:], strict=False)] == [p.length for p in x.pieces]
        fill[window] = sum(x.cu_seqlens[-1] for x in rows_) / (256 * len(rows_))
        assert len({x.sequence_id for x in rows_}) == len(rows_)
    assert fill[20_000] > fill[1_000_000] - 0.02


def test_neighbours_on_the_curve_are_alike(spark):
    """Token sets of documents next to one another share far more than those of random pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars between 100 and 5000").select("doc_id", "text").dropDuplicates(["text"])
    got = pack_along_curve(docs).select("doc_id", (F.col("sequence_id") * 2048 + F.col("offset")).alias("at"), "start").filter("start = 0").orderBy("at").collect()
    sets = {r.doc_id: set(r.text.lower().split()) for r in docs.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    order = [r.doc_id for r in got]
    near = np.mean([alike(a, b) for a, b in zip(order, order[1:], strict=False)])
    far = list(order)
    random.Random(1).shuffle(far)
    assert near > 1.5 * np.mean([alike(a, b) for a, b in zip(far, far[1:], strict=False)])


def test_very_long_texts(spark):
    """3 MB in one text, and one word of 1 MB, beside an ordinary text."""
    big = " ".join(f"t{i % 5000} u{i % 7}" for i in range(300_000))
    docs = spark.createDataFrame([(1, big), (2, "x" * 1_000_000), (3, " ".join(VOCAB[:60]))], DOC).repartition(3)
    bench = spark.createDataFrame([(1, " ".join(f"t{i} u{i % 7}" for i in range(100, 110)))], "item_id long, text string")
    n = {1: 600_000, 2: 1, 3: 60}
    for df in (quality_rules(docs), contamination(docs, bench), cut_duplicates(docs, batches=1)):
        assert {r.doc_id: r.n_words for r in df.select("doc_id", "n_words").collect()} == n
    assert contamination(docs, bench).filter("doc_id = 1").first().n_hit > 0
    assert {r.doc_id: r.kept for r in M.near_duplicates(docs, k=4).collect()} == {1: True, 2: True, 3: True}
    for df in (pack_along_curve(docs, with_ids=False), segments(pack_best_fit(docs))):
        got = df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
        assert len(got) == 3 and all(r.n == r.t for r in got)


def test_best_fit_and_hilbert():
    sizes = [random.Random(i).randrange(1, 100) for i in range(200)]
    bins = best_fit_decreasing(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(200)) and max(sum(sizes[i] for i in b) for b in bins) <= 100
    assert len(bins) <= sum(sizes) / 100 * 1.15 + 1
    cells = np.array([(x, y) for x in range(8) for y in range(8)], dtype=np.uint64)
    order = cells[np.argsort(hilbert_key(cells, 3))].astype(int)
    assert sorted(hilbert_key(cells, 3)) == list(range(64)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (M.near_duplicates(none), cut_duplicates(none), contamination(none, bench), quality_rules(none), pack_along_curve(none), pack_best_fit(none)):
        assert df.count() == 0
    assert contamination(spark.createDataFrame([(1, "a")], DOC), bench).first().n_hit == 0


def test_components_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.cid): bytes(r.comp) for r in M.components(links.repartition(7)).collect()}
    assert {got[bytes([i])] for i in range(41)} == {b"\x00"} and got[b"\xf1"] == b"\xf0"
