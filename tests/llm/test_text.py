"""Problems 5, 8, 9 and 10: vectors, packing, leakage, personal data."""

import random
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegraph.llm import formats as O
from lodegraph.llm import leakage as K
from lodegraph.llm import neighbours as N
from lodegraph.llm import packing as B
from lodegraph.llm import personal as P


# --- 5 --------------------------------------------------------------------------------------------------------------
def brute(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {ids[i]: [(ids[j], s[i, j]) for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 6), ids[j]))[:k]] for i in range(len(ids))}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    vectors = {f"n{i:03}": (base[i % 12] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist() for i in range(300)}
    vectors |= {f"copy{i}": vectors["n000"] for i in range(9)}  # more copies than k
    rows = [(k, v) for k, v in vectors.items()] + [("n001", vectors["n001"]), ("zero", [0.0] * 8), ("null", None), ("short", [1.0]), ("nan", [float("nan")] * 8), ("hole", [None] * 8), (None, vectors["n002"])]
    df = spark.createDataFrame(rows, "node_id string, embedding array<float>").withColumn("vec", F.lit("clash"))
    want = brute(vectors, 5)
    got = {}
    for r in N.neighbours(df, dim=8, probe=10_000).collect():
        got.setdefault(r.node_id, []).append((r.other, r.similarity))
    assert set(got) == set(vectors)
    for k, near in want.items():
        assert sorted(round(s, 3) for _, s in got[k]) == sorted(round(s, 3) for _, s in near), k
    assert {o for o, _ in got["copy3"]} <= {*(f"copy{i}" for i in range(9)), "n000"}
    pairs = {(r.node_a, r.node_b) for r in N.close_pairs(df, 0.9, dim=8).collect()}
    sure = {tuple(sorted((a, b))) for a, near in want.items() for b, s in near if s >= 0.9 and not {a, b} & {*(f"copy{i}" for i in range(9)), "n000"}}
    assert len(sure & pairs) >= 0.9 * len(sure) and all(a < b for a, b in pairs)
    assert N.neighbours(df.limit(0), dim=8).count() == 0
    two = spark.createDataFrame([("a", [1.0] * 8), ("b", [1.0] * 7 + [0.0])], "node_id string, embedding array<float>")
    assert {(r.node_id, r.other) for r in N.neighbours(two, dim=8).collect()} == {("a", "b"), ("b", "a")}


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(2)
    index = N.Index(rng.normal(size=(5, 2)).astype(np.float32), rng.normal(size=(6, 2)).astype(np.float32), np.arange(30) % 4)
    d1, d2 = rng.random(5), rng.random(6)
    cells = index.walk(d1, d2, 10_000)
    order = sorted((c for c in range(30) if index.counts[c]), key=lambda c: d1[c // 6] + d2[c % 6])
    assert cells == order and index.walk(d1, d2, 3) == order[: next(i for i in range(30) if index.counts[order[: i + 1]].sum() >= 3) + 1]


def test_recall_on_clusters():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(300, 64)), 10, axis=0) + 0.1 * rng.normal(size=(3000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = N.Index(N.fit(x[:, :32], 8), N.fit(x[:, 32:], 8), np.empty(0, int))
    cell = index.cells(x)
    index.counts = np.bincount(cell, minlength=64)
    d1, d2 = index.distances(x)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hit = np.mean([np.isin(cell[np.argsort(-s[i])[:5]], index.walk(d1[i], d2[i], 600)).mean() for i in range(0, 3000, 10)])
    assert hit >= 0.95


# --- 8 --------------------------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins: list[int] = []
    want = []
    for s in sizes:
        i = next((i for i, used in enumerate(bins) if used + s <= 50), len(bins))
        if i == len(bins):
            bins.append(0)
        bins[i] += s
        want.append(i)
    assert B.first_fit_decreasing(np.array(sizes, int), 50).tolist() == want


@pytest.mark.parametrize("text", ["", "short text", "wörter und 😀 " * 60, "x" * 3000, "\n\n" * 500])
def test_pieces_round_trip(text):
    got = B.pieces(text, B.TOKENIZER, 40)
    assert "".join(text[a:b] for _, a, b in got) == text
    assert all(n <= 40 for n, _, _ in got) and sum(n for n, _, _ in got) == len(B.encoding(B.TOKENIZER).encode_ordinary(text))


def test_pack(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("word" for _ in range(rnd.randint(1, 400)))) for i in range(300)] + [(900, "long " * 9000), (901, None), (902, ""), (903, " \n\t "), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("grp", F.lit("clash"))
    got = B.pack(docs, group_docs=100).collect()
    used: dict = {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 2048 and {r.doc_id for r in got} == {*range(300), 900}
    assert sum(r.n_tokens for r in got if r.doc_id == 900) >= 9000 and sum(1 for r in got if r.doc_id == 5) == 2
    least = -(-sum(used.values()) // 2048)
    assert len(used) <= least * 11 / 9 + 4
    assert B.fill_report(B.pack(docs, group_docs=100)).first().n_items == len(got)
    assert B.pack(docs.limit(0)).count() == 0


# --- 9 --------------------------------------------------------------------------------------------------------------
NOUNS = "ledger vault beacon canvas harvest mirror quota relay shard ticket voucher widget anchor bucket cursor digest envelope fraction gateway histogram".split()


def passage(rnd, n=40):
    return " ".join(rnd.choice(NOUNS) + rnd.choice(["s", "", "ing", "ed"]) for _ in range(n))


def test_leaks(spark):
    rnd = random.Random(7)
    items = [(i, passage(rnd)) for i in range(30)]
    w = items[3][1].split()
    edited = " ".join("changed" if i % 7 == 3 else x for i, x in enumerate(items[5][1].split()))
    docs = [(1, "intro words " + items[0][1] + " and more"), (2, items[1][1].upper().replace(" ", ",  ")), (3, "<b>" + "</b> <b>".join(w) + "</b>"), (4, edited)]
    docs += [(5, " ".join(w[:8]) + " is a short excerpt"), (6, passage(rnd, 80)), (7, None), (8, ""), (9, " ".join(items[2][1].split()[:14]) + " filler " * 30 + " ".join(items[2][1].split()[14:30]))]
    docs += [(10, items[4][1].replace("e", "е").replace("ing", "i\u00adng")), (11, "\n// ".join(items[6][1].split())), (1, docs[0][1])]
    docs += [(100 + i, items[9][1]) for i in range(40)]  # one passage in most documents
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    e = spark.createDataFrame([*items, (98, None), (99, ""), (97, "two words")], "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id) for r in K.find_leaks(d, e).collect()}
    assert got == {(1, 0), (2, 1), (3, 3), (4, 5), (9, 2), (10, 4), (11, 6), *((100 + i, 9) for i in range(40))}
    assert K.find_leaks(d.limit(0), e).count() == 0 and K.find_leaks(d, e.limit(0)).count() == 0


def test_leak_into_every_document(spark):
    rnd = random.Random(11)
    items = [(i, passage(rnd, 80)) for i in range(3)]
    half = items[0][1].split()[:46]
    docs = [(i, f"intro number {i} " + " ".join("changed" if k == i % 40 + 3 else x for k, x in enumerate(half))) for i in range(40)]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    assert {(r.doc_id, r.item_id) for r in K.find_leaks(d, e).collect()} == {(i, 0) for i in range(40)}


def test_leak_in_stretches_is_counted_whole(spark):
    text = passage(random.Random(13), 60)
    w = text.split()
    doc = " ".join(w[:34]) + " filler" * 50 + " " + " ".join(w[34:])
    d, e = spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), spark.createDataFrame([(1, text)], "item_id bigint, passage string")
    assert [(r.matched_words, r.item_words) for r in K.find_leaks(d, e).collect()] == [(60, 60)]


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (K.MATCH if x == y else K.MISMATCH), h[i - 1, j] + K.GAP, h[i, j - 1] + K.GAP)
    return h.max()


def test_alignment_is_best():
    rnd = random.Random(4)
    for _ in range(40):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(1, 15))] for _ in range(2))
        pairs = K.align(np.array(a), np.array(b))
        assert all(a[i] == b[j] for i, j in pairs)
        score = K.MATCH * len(pairs)
        for (i, j), (p, q) in zip(pairs, pairs[1:]):
            down, right = p - i - 1, q - j - 1
            score += max(K.MISMATCH * m + K.GAP * (down + right - 2 * m) for m in range(min(down, right) + 1))
        assert score == smith_waterman(a, b) or (not pairs and smith_waterman(a, b) == 0)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=120))
@settings(deadline=None)
def test_alignment_in_blocks_is_that_of_the_whole(item, doc):
    item, doc = np.array(item, np.int64), np.array(doc, np.int64)
    got = K.align(item, doc)
    score, _ = K._align(item, doc)
    assert bool(got) == (score > 0) and all(item[i] == doc[j] for i, j in got)
    if got:
        (i0, j0), (i1, j1) = got[0], got[-1]
        assert K._align(item[i0 : i1 + 1], doc[j0 : j1 + 1])[0] == score


def test_far_windows_do_not_touch():
    doc = np.arange(1, 2001)
    window = K.near(doc, np.array([500, 1500]), 20, 11)
    assert window.tolist() == [-1] * 11 + doc[480:520].tolist() + [-1] * 11 + doc[1480:1520].tolist() + [-1] * 11
    assert K.near(doc[:70], np.array([1]), 20, 11).tolist() == doc[:70].tolist()


def test_leaks_in_any_script(spark):
    passage = {1: "Быстрая коричневая лиса прыгает через ленивую собаку и бежит домой по лесу", 2: "敏捷的棕色狐狸跳过了懒惰的狗然后跑回家去了", 3: "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και τρέχει"}
    evals = spark.createDataFrame(list(passage.items()), "item_id bigint, passage string")
    docs = spark.createDataFrame([(10 * i, f"Notes: {t.upper()}! And more.") for i, t in passage.items()] + [(99, "Совсем другой текст про погоду и море без этих слов"), (98, "今天天气很好我们去公园散步")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in K.find_leaks(docs, evals).collect()} == {(10, 1), (20, 2), (30, 3)}


def test_items_in_several_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices(string.ascii_lowercase, k=6))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(7)]
    evals = spark.createDataFrame(items, "item_id bigint, passage string")
    docs = spark.createDataFrame([(i, f"see {p} there") for i, p in items], "doc_id bigint, text string")
    monkeypatch.setattr(K, "BLOCK", 3)
    assert {(r.doc_id, r.item_id) for r in K.find_leaks(docs, evals).collect()} == {(i, i) for i in range(7)}


# --- 10 -------------------------------------------------------------------------------------------------------------
CASES = [
    ("Send it to ana.b+x@mail.site.example, please", [("email", "ana.b+x@mail.site.example")]),
    ("mail=jo [at] site [dot] test; tel=(406) 555-0105", [("email", "jo [at] site [dot] test"), ("phone", "(406) 555-0105")]),
    ("call Rosa Nim via +44 7700 900660 or 07700 900 728", [("name", "Rosa Nim"), ("phone", "+44 7700 900660"), ("phone", "07700 900 728")]),
    ("ring 068/829 5541 21 or 01 99 00 29 63", [("phone", "068/829 5541 21"), ("phone", "01 99 00 29 63")]),
    ("leaked SSN 951294406 and QQ 38 35 37 C, DNI 22307535-W", [("id_number", "951294406"), ("id_number", "QQ 38 35 37 C"), ("id_number", "22307535-W")]),
    ("Deliver to: Nimson, Rosa, Flat 7, 201 Thistle Terrace, Castrel, phone 301.555.0136", [("name", "Nimson, Rosa"), ("address", "Flat 7, 201 Thistle Terrace, Castrel"), ("phone", "301.555.0136")]),
    ("Lieferung an Juniperweg 51, Nether Quill. Adresse: Calle Juniper 173, 63892 Villaseca Norte", [("address", "Juniperweg 51, Nether Quill"), ("address", "Calle Juniper 173, 63892 Villaseca Norte")]),
    ("Upgrade to commit@3.36.6, path template@noisy/x, Range 100-232-3262, run 4411-8530-69, 192.0.2.152:2302, Use `@route.bundle`", []),
    ("Order 945 interval Street view tiles. Cold Tensor is the code name. The Cluster Secret team owns port 7395.", []),
    ("Thanks to Apache Spark we ask Redis Cluster, call Great Expectations and ping Visual Studio. Contact: Service Desk. Built by Cold Tensor.", []),
    ("Maria Keller fixed the bug after Dr. John Smith and Frau Zorka Plim saw it.", [("name", "Maria Keller"), ("name", "John Smith"), ("name", "Zorka Plim")]),
    ("Account DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00", [("id_number", "DE89 3704 0044 0532 0130 00")]),
    ("card 4111 1111 1111 1111 paid, ticket 4111 1111 1111 1112 closed", [("id_number", "4111 1111 1111 1111")]),
    ("ssn 000-00-0000, 999-99-9999, passport 1, SSN: 123-00-4567, 943-24-4325", [("id_number", "943-24-4325")]),
    ("born on 29.02.1984, date of birth: 31.02.1990, released 2024-01-05", [("date", "29.02.1984")]),
    ("call +1 112 555 0100 or (112) 555-0100, never 0000 000 000", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_mentions(text, want):
    assert [(k, text[a:b]) for a, b, k in P.mentions(text)] == want


@given(st.text(max_size=200))
@settings(deadline=None)
def test_any_text_redacts(text):
    out, found = P.redact(text, KEY)
    assert all(a < b for a, b, *_ in found) and (found or out == text)


KEY = b"sixteen bytes it"


def test_feistel_permutes():
    for n in (1, 2, 3):
        values = {O.feistel(str(i).zfill(n), string.digits, KEY) for i in range(10**n)}
        assert len(values) == 10**n
    assert O.feistel("123456789", string.digits, b"a") != O.feistel("123456789", string.digits, b"b")
    even = {O.walk(f"{i:03}", string.digits, KEY, lambda s: int(s) % 2 == 0) for i in range(0, 1000, 2)}
    assert len(even) == 500 and all(int(x) % 2 == 0 for x in even)
    assert sorted(O.shift(i, 365, KEY) for i in range(365)) == list(range(365))
    assert P.pseudonym("Nim, Rosa", "name", KEY) == P.pseudonym("rosa nim", "name", KEY)


def test_phone_formats():
    put = lambda s: P.pseudonym(s, "phone", KEY)
    new = put("+1 (212) 555-0100")
    assert new.startswith("+1 (") and O.split_phone(new) and put("(212) 555-0100") == new[3:] and put("212.555.0100") == new[4:7] + "." + new[9:12] + "." + new[13:]
    assert put("+44 7700 900660")[4:].replace(" ", "") == put("07700 900 660")[1:].replace(" ", "") and put("+44 (0) 7700 900660").startswith("+44 (0) ")
    assert put("386 555 0116 ext. 598").count(" ") == 4 and " ext. " in put("386 555 0116 ext. 598")
    numbers = [f"(2{a}2) 55{b}-0{c:03}" for a in range(3) for b in range(3) for c in range(0, 1000, 97)]
    assert len({put(s) for s in numbers}) == len(numbers)


@pytest.mark.parametrize("value", ["DE89 3704 0044 0532 0130 00", "4111-1111-1111-1111", "1 84 12 76 451 089 46", "12345678Z", "x1234567l", "943-24-4325", "QQ 18 90 51 A", "Z4403486"])
def test_identity_formats(value):
    new = P.pseudonym(value, "id_number", KEY)
    assert O.id_format(new) == O.id_format(value) and O.id_format(value)[1] and new != value
    assert [c.isalnum() for c in new] == [c.isalnum() for c in value] and [c.islower() for c in new] == [c.islower() for c in value]


def test_dates_stay_linked():
    same = ["1984-02-29", "29.02.1984", "29/02/1984", "29 February 1984", "29 février 1984", "29 de febrero de 1984"]
    new = [O.split_date(P.pseudonym(s, "date", KEY))[0] for s in same]
    assert len(set(new)) == 1 and P.pseudonym(same[1], "date", KEY)[2] == "."
    assert P.pseudonym("31.02.1984", "date", KEY) == "31.02.1984"


def test_redact_documents(spark):
    rows = [(1, "Ping Rosa Nim on +1-397-555-0149 if"), (2, None), (3, ""), (4, "nothing"), (1, "Ping Rosa Nim on +1-397-555-0149 if"), (5, "(397) 555-0149")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    got = P.find_mentions(docs, KEY).collect()
    assert sorted((r.doc_id, r.kind, r.start_at) for r in got) == [(1, "name", 5), (1, "phone", 17), (5, "phone", 0)]
    tail = {r.doc_id: "".join(c for c in r.pseudonym if c.isdigit())[-10:] for r in got if r.kind == "phone"}
    assert tail[1] == tail[5]  # one number, two ways of writing it, two documents
    red = {r.doc_id: r for r in P.redact_documents(docs, KEY).collect()}
    assert red[2].text is None and red[3].text == "" and red[4].text == "nothing" and red[1].text.startswith("Ping [name:")
    assert P.find_mentions(docs.limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        P.find_mentions(docs, b"short")


def test_names_of_a_collection_are_learned(spark):
    texts = [f"Owner: Zorvane Plimsol{c} <zp{c}@site.example> and the pilot plan runs" for c in "abcdef"] + ["the stage plan was kept by Zorvane Quist. Stage Plan is old."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lexicon = P.learn_names(docs)
    assert "zorvane" in lexicon.given and "plan" in lexicon.ordinary and "plimsola" not in lexicon.ordinary
    assert [texts[6][a:b] for a, b, k in P.mentions(texts[6], lexicon)] == ["Zorvane Quist"]


def test_names_are_learned_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 1_000, raising=False)  # counts leave a task in parts
    letters = F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), string.digits, "abcdefghij")
    rare = F.when(F.col("id") % 2_000 == 0, " the rareword plan").when(F.col("id") % 2_200 == 0, " the scarce plan").otherwise("")
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Owner: Z"), letters, F.lit(" Plimsol <p@site.example>"), rare).alias("text"))
    lexicon = P.learn_names(docs)
    assert {"z" + f"{i:05}".translate(str.maketrans(string.digits, "abcdefghij")) for i in range(24_000)} <= lexicon.given
    assert "rareword" in lexicon.ordinary and "scarce" not in lexicon.ordinary  # once in 2 000 texts is ordinary: 12 of 24 000


RARE_FORMS = [
    ("wire to GB29 NWBK 6016 1331 9268 19 now", [("id_number", "GB29 NWBK 6016 1331 9268 19")]),
    ("passport C01X00T478 and passport no. AB123456", [("id_number", "C01X00T478"), ("id_number", "AB123456")]),
    ("write jo (at) site.example or jo at site dot example soon", [("email", "jo (at) site.example"), ("email", "jo at site dot example")]),
    ("kept by: rosa nim, then\nby rosa keller", [("name", "rosa nim"), ("name", "rosa keller")]),
]


@pytest.mark.parametrize("text,want", RARE_FORMS)
def test_quick_looks_lose_nothing(text, want):
    assert [(k, text[a:b]) for a, b, k in P.mentions(text)] == want
