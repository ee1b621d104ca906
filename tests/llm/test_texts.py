"""Vectors, canonical lists, packing, mixing and sentences."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import p4_neighbours, p7_canonical, p8_packing, p9_mixing, p10_sentences, tokens


def test_nearest(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 384))
    x = (centre[rng.integers(12, size=400)] + 0.6 * rng.normal(size=(400, 384))).astype(np.float32)
    x[300:320] = x[5]  # exact copies, more than are stored
    x[350] = 7 * x[6]
    rows = [(int(i), [float(v) for v in x[i]], "clash") for i in range(400)] + [(900, None, "n"), (901, [0.0] * 384, "z"), (902, [1.0] * 10, "s"), (903, [float("nan")] * 384, "q")]
    df = spark.createDataFrame(rows, "rec_id bigint, vector array<float>, g string")
    got = {}
    for r in p4_neighbours.nearest([(df, "rec_id", "vector")]).collect():
        got.setdefault(r.id, set()).add(r.other)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    best = {i: set(np.lexsort((np.arange(400), -s[i]))[:5].tolist()) for i in range(400)}
    assert got == best
    assert p4_neighbours.nearest([(df.limit(0), "rec_id", "vector")]).count() == 0


def _clustered(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 25, 64))[rng.integers(n // 25, size=n)] + 0.5 * rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = np.round(x.astype(np.float64) @ x.T.astype(np.float64), 6)
    np.fill_diagonal(s, -2)
    return x, {(i, int(j)) for i in range(n) for j in np.lexsort((np.arange(n), -s[i]))[:5]}


def test_a_task_holds_a_slice_of_the_queries():
    x, best = _clustered(1000, 3)
    read = 0

    def batches():
        nonlocal read
        for g, base, ids in [(4, True, range(1000)), *[(4, False, range(5000 + lo, 5000 + lo + 1000)) for lo in range(0, 20_000, 1000)], (5, False, range(10)), (6, True, range(30_000, 30_003))]:
            read += 1
            v = [x[i % 1000].tobytes() for i in ids]
            ask = [base is False or i % 2 == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(v), pa.int32()), pa.array(list(ids), pa.int64()), pa.array([base] * len(v)), pa.array(ask), pa.array(v, pa.binary())], names=["g", "id", "base", "ask", "v"])

    got, early = [], 0
    for b in p4_neighbours.search_groups(batches(), 5, 64):
        assert b.num_rows <= 6 * p4_neighbours.SLICE
        early += read < 5
        got += zip(*[c.to_pylist() for c in b.columns])
    assert early > 3  # lists come before the other queries are read
    assert {(q, o) for q, o, _ in got if q < 1000 and q != o} == {p for p in best if p[0] % 2 == 0}
    assert {((q - 5000) % 1000, o) for q, o, _ in got if 5000 <= q < 30_000 and (q - 5000) % 1000 != o} == best
    assert len(got) == 500 * 6 + 20_000 * 6 + 2 * 3


def test_parts_are_balanced_and_keep_neighbours():
    x, best = _clustered(1500, 1)
    near = p4_neighbours.neighbour_graph(x, 8)
    label = p4_neighbours.balanced_parts(near, p4_neighbours.bisect(x, 200), 240)
    parts = int(label.max()) + 1
    assert np.bincount(label).max() <= 240 and parts > 6
    w, b = p4_neighbours.softmax_fit(x, label, parts)
    home = (x @ w + b).argmax(1)
    assert (home[near[:, :5]] == home[:, None]).mean() > 0.8


@pytest.mark.parametrize("part,block,coverage,least", [(100, 6000, 0.95, 0.97), (100, 30, 0.95, 0.97), (5000, 500, 1.0, 1.0)])
def test_nearest_in_many_parts(spark, part, block, coverage, least):
    x, best = _clustered(3000, 2)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in range(len(x))], "rec_id bigint, vector array<float>")
    tree = p4_neighbours.fit_tree(df.toDF("id", "v"), 3000, 64, 512, part, block)
    if part == 100:
        assert len(tree.blocks) > 20 and tree.below  # two levels
    assert (tree.blocks.max() > 1) == (block < 6000)
    got = {(r.id, r.other) for r in p4_neighbours.nearest([(df, "rec_id", "vector")], dim=64, sample=512, part=part, block=block, coverage=coverage).collect()}
    assert len(got) == 15_000 and len(got & best) / len(best) >= least


def test_canonical():
    c = p7_canonical.Canon([(1, "Selsor", None), (2, "New Katan", "Old Katan"), (3, "New Kntan", None), (4, "Mobile Phones", "Smartphones"), (5, "Tea & Coffee", None), (6, "Warim Bay", "Vordenmar Town")])
    for raw, want in {"selsor": 1, " SELSOR Dist. ": 1, "7 Harbour Rd, Selsor": 1, "slesor": 1, "new kmatan": 2, "New Kntan": 3, "Phones, Mobile": 4, "Mobile_Phone": 4, "Mob. Pho.": 4, "tea n coffee": 5, "Coffee + Tea": 5, "Mobile van": -1, "asdf": -1, "???": -1, "12345": -1, "Vordenmar Town": 6, "WarimBay": 6, "x" * 50_000: -1}.items():
        assert c.find(raw) == want, raw
    assert p7_canonical.Canon([]).find("selsor") == -1


def test_map_values(spark):
    ref = spark.createDataFrame([(1, "Selsor", None)], "id bigint, name string, other string")
    rec = spark.createDataFrame([(1, "SELSOR", 0), (2, "n/a", 0), (3, None, 0), (4, "", 0), (5, "Nowhere at all", 0), (6, "SELSOR", 0)], "rec_id bigint, city string, ref_id int")
    assert {(r.rec_id, r.ref_id) for r in p7_canonical.map_values(rec, "city", ref).collect()} == {(1, 1), (5, -1), (6, 1)}
    assert p7_canonical.map_values(rec.limit(0), "city", ref).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 5, 40, 300, 900, 2047, 2048, r.randrange(1, 2048)]) for _ in range(300)]
    bins = p8_packing.pack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(300))
    loads = [sum(sizes[i] for i in b) for b in bins]
    assert max(loads) <= 2048 and len(bins) <= -(-sum(sizes) // 2048) * 1.12 + 1


def test_differencing_balances():
    r = random.Random(9)
    sizes = [r.randrange(50, 400) for _ in range(200)]
    loads = [sum(sizes[i] for i in w) for w in p8_packing.differencing(sizes, 10)]
    assert max(loads) - min(loads) <= 12
    assert p8_packing.pack([]) == [] and p8_packing.pack([2048]) == [[0]]


def test_lay_out(spark):
    sized = spark.createDataFrame([(1, 5000), (2, 2048), (3, 0), (4, 100), (5, 1948)], "doc_id bigint, tokens bigint")
    rows = p8_packing.lay_out(sized).collect()
    assert sum(r.tokens for r in rows) == 9096 and {(r.doc_id, r.piece) for r in rows} == {(1, 0), (1, 1), (1, 2), (2, 0), (4, 0), (5, 0)}
    fill = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert max(fill.values()) <= 2048
    assert p8_packing.lay_out(sized.limit(0)).count() == 0


def test_token_counts(spark):
    texts = ["", None, "Hello world", "é" * 9_000, "日本語。" * 50, "a b " * 3000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, tokens int")
    got = {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()}
    enc = tokens.encoder(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}")
    assert got[0] == got[1] == 0 and got[2] == len(enc("Hello world")) and got[4] == len(enc(texts[4])) and got[5] == len(enc(texts[5])) and got[3] > 0


def test_mixing(spark):
    rows = [(i, ["A_x", " a-X", "b", "c"][i % 4] if i < 400 else "rare", f"h{i}", 10 + i % 7) for i in range(404)] + [(1000, "b", "h2", 12), (1001, None, "n", 4), (1002, "b", "z", 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, h string, tokens bigint")
    targets = spark.createDataFrame([("a_x", 0.3, 1), ("b", 0.4, 3), ("rare", 0.3, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats bigint")
    for run in (20_000, 16):
        taken, report = p9_mixing.mix(sized, targets, run)
        t, rep = taken.collect(), {r.source: r for r in report.collect()}
        budget = sum(r[3] for r in rows if r[1] in ("A_x", " a-X", "b", "rare"))
        total = sum(r.tokens * r.uses for r in t)
        assert budget - 60 <= total <= budget
        assert all(r.uses <= {"a_x": 1, "b": 3, "rare": 2}[r.source] for r in t) and 1000 not in {r.doc_id for r in t}
        assert rep["rare"].uses == 8 and rep["none"].tokens == 0 and abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-4
        assert abs(rep["b"].tokens / rep["a_x"].tokens - 4 / 3) < 0.05
    empty, report = p9_mixing.mix(sized.limit(0), targets)
    assert empty.count() == 0 and report.count() == 0


CASES = {
    "en": ["Dr. Lorhal asked for invoice No. 30 before 3:45 p.m. on Monday.", "Approval came from the Asst. Mgr. at Ultavar.", '"The seal was broken. I want my money back," wrote Ms. Ulvo on 5 Sept. 2024.', "Rev. Yel asked, \"Is it safe?\"", "'I never got it!' shouted the man.", "We charged Rs. 85.57 (both for 13.).", "Great service!!!", "Well... the lamp works."],
    "de": ["Sie wohnt im 4. Stock bei Fam. Delkaran.", "U. a. fehlen Telefon, PLZ usw. in der Akte.", "„Die Kiste ist kaputt. Ich will mein Geld“, schrieb Herr Kel."],
    "fr": ["M. Calin a dit « attendez ! » puis il est parti.", "La facture, c.-à-d. le document no 1, est illisible...", "Qui a signé le bon ?"],
    "es": ["D. Lars Isd vive en la C. Dor, n.º 415, 2.º izq. desde marzo.", "¿Cuánto cuesta?", "—No lo compré yo —dijo Farida en caja."],
    "zh": ["“没有人回复我！”她写道，“请尽快处理。”", "客户说：“箱子是空的。我要退款。”", "积分还剩288分……下个月过期。", "发票号459是错的．"],
    "ja": ["「箱は空でした。返金してください。」とUl様が書きました。", "すごい！！"],
    "hi": ["मेसर्स Ban प्रा. लि. ने उत्तर नहीं दिया।", "वज़न 77.6 कि.ग्रा. है ।", 'ग्राहक ने कहा, "मैंने यह नहीं ख़रीदा।"', "यह केतली कब आएगा?"],
    "th": ["คุณ Dmitri มีสองบัญชีครับ", "พัสดุหนัก 41.54 กก. ค่ะ", "เบอร์โทรถูกต้องไหมคะ"],
    "ar": ["قال د. Linra إن الفاتورة خاطئة.", "دفع العميل 10.48 د.إ. في المتجر.", "هل رقم الهاتف صحيح؟", "«الصندوق فارغ. أريد المال»، كتبت السيدة Waf."],
}


@pytest.mark.parametrize("lang", CASES)
def test_sentences(lang):
    glue = "" if lang in ("zh", "ja") else " "
    text = glue.join(CASES[lang])
    assert [text[a:b] for a, b in p10_sentences.sentences(text)] == CASES[lang]


def test_lines():
    text = "Dear Mr. Cheton,\r\n\r\nThe box holds one rice\r\ncooker. It works.No refund\n was issued\n\nName: A. B. Corp. Ltd.\nPhone: 12\n\n- one. two.\n- three\n2. four\n\nKind regards,\nSusan Ter\n \n"
    got = [text[a:b] for a, b in p10_sentences.sentences(text)]
    assert got == ["Dear Mr. Cheton,", "The box holds one rice\r\ncooker.", "It works.", "No refund\n was issued", "Name: A. B. Corp. Ltd.", "Phone: 12", "- one. two.", "- three", "2. four", "Kind regards,", "Susan Ter"]


def test_segment_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "One. Two."), (5, "One. Two."), (6, "word " * 20_000 + "end."), (7, "\"" * 3000 + ". A"), (8, "😀 Hi there. Bye!")], "doc_id bigint, text string")
    rows = p10_sentences.segment(docs).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    assert got[4] == got[5] == [(0, 4), (5, 9)] and got[6] == [(0, 100_004)] and not {1, 2, 3} & got.keys() and got[8] == [(0, 11), (12, 16)]


def test_long_runs_are_counted_whole():
    import os

    from siltstone.llm import tokens

    encode = tokens.encoder(os.path.join(tokens.TOKENIZER_DIR, tokens.TOKENIZER))
    text = "語文字中国人" * 3_333
    assert tokens.count(text, encode) == len(encode(text))


def test_long_quotations_are_whole():
    text = '"' + "I want my money back. " * 150 + 'It is late," wrote Ms. Ulvo on 5 Sept. 2024. Then she left.'
    assert [text[a:b] for a, b in p10_sentences.sentences(text)] == [text[:-15], "Then she left."]


def test_marks_without_partner_take_linear_time():
    def spent(n):
        t = time.perf_counter()
        assert len(p10_sentences.sentences("(" * n + "“" * n + " y " + "]" * n + "»" * n + ".")) == 1
        return time.perf_counter() - t

    spent(100)
    assert spent(80_000) < 5


def test_what_follows_reported_speech_is_new():
    text = 'Rev. Yel asked, "Is it safe?" Nobody answered at extn. 30... then the line went dead.'
    assert [text[a:b] for a, b in p10_sentences.sentences(text)] == ['Rev. Yel asked, "Is it safe?"', "Nobody answered at extn. 30... then the line went dead."]
