"""The text operators against brute force, exact round trips and planted cases."""

import base64
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrollwork.llm import bpe, confusables, mojibake, names, packing, setjoin

ZH = "檐下的铃响了一阵，没有人应声。她把缺角的铜钱塞进袖里，老者低声说：“谁告诉你的？”……"
FR = "L’héritière n’a pas touché la lettre scellée à marée basse, « Où étais-tu passé ? » — café, œuvre, naïve."


# -- 1 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("per_task", [20_000, 2])
def test_similar_records(spark, rows, per_task):
    rnd = random.Random(7)
    data = [(i, sorted(rnd.sample("abcdefgh", rnd.randint(1, 5)))) for i in range(60)] + [(100, None), (101, []), (3, None)]
    data += [(200 + i, ["hot"]) for i in range(12)] + [(200, ["hot"])] + [(220 + i, sorted(["hot", "x", f"y{i}"])) for i in range(5)]
    df = spark.createDataFrame(data, "id long, vals array<string>").withColumn("sid", F.lit(1))
    sets, _ = setjoin.classes(df)
    want = sorted({(a, b) for a, x in data for b, y in data if a < b and x and y and 5 * len(set(x) & set(y)) >= 3 * len(set(x) | set(y))})
    assert rows(setjoin.similar_records(df)) == sorted(want, key=repr)
    byid = {r["sid"]: set(r["vals"]) for r in sets.collect()}
    close = [(a, b) for a in byid for b in byid if a < b and 5 * len(byid[a] & byid[b]) >= 3 * len(byid[a] | byid[b])]
    assert rows(setjoin.similar_sets(sets, 3, 5, per_task)) == sorted(close, key=repr)


@pytest.mark.parametrize("per_part", [1_000, 3])
def test_similar_records_of_two_tables_and_hot_classes(spark, rows, per_part):
    rnd = random.Random(9)
    one = [(i, sorted(rnd.sample("abcdef", rnd.randint(1, 4)))) for i in range(30)] + [(100 + i, ["hot", "x", "y"]) for i in range(8)]
    two = [(i, sorted(rnd.sample("abcdef", rnd.randint(1, 4)))) for i in range(20)] + [(50 + i, ["hot", "x", "y", "z"]) for i in range(7)] + [(90, None), (91, [])]
    a, b = (spark.createDataFrame(x, "id long, vals array<string>") for x in (one, two))
    close = lambda x, y: bool(x and y) and 5 * len(set(x) & set(y)) >= 3 * len(set(x) | set(y))
    assert rows(setjoin.similar_records(a, other=b, per_part=per_part)) == sorted([(i, j) for i, x in one for j, y in two if close(x, y)], key=repr)
    both = [(i, x) for i, x in one] + [(1000 + i, y) for i, y in two]
    c = spark.createDataFrame(both, "id long, vals array<string>")
    pairs = [(i, j) for i, x in both for j, y in both if i < j and close(x, y)]
    assert rows(setjoin.similar_records(c, per_part=per_part)) == sorted(pairs, key=repr)
    links = {r["id"]: (r["sid"], r["n_links"]) for r in setjoin.similar_links(c).collect()}
    assert links == {i: (min(j for j, y in both if y == x), sum(i in p for p in pairs)) for i, x in both if x}


def test_pieces_and_empty_table(spark, rows):
    df = spark.createDataFrame([(1, "甲乙-丙／甲乙、a|bc"), (2, ""), (3, None)], "id long, t string")
    got = df.select("id", setjoin.pieces(F.col("t"), r"\-／、|", 2).alias("v"))
    assert rows(got) == [(1, ["bc", "甲乙"]), (2, []), (3, None)]
    assert setjoin.similar_records(spark.createDataFrame([], "id long, vals array<string>")).count() == 0


# -- 3 --------------------------------------------------------------------------------------------


def distance(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_walk_against_brute_force():
    rnd = random.Random(2)
    keys = ["".join(rnd.choices("abc", k=rnd.randint(1, 7))) for _ in range(40)]
    t = names.Trie()
    for i, k in enumerate(keys):
        t.add(k, str(i))
    for _ in range(60):
        w = "".join(rnd.choices("abc", k=rnd.randint(1, 8)))
        for bound in (1, 2):
            assert t.near(w, bound) == {str(i): distance(w, k) for i, k in enumerate(keys) if distance(w, k) <= bound}


def test_linked(spark, rows):
    people = [("B", "C-1", "即墨晚阑", ["师父"]), ("B", "C-2", "庹钧", ["师父", None]), ("B", "C-3", "Turmonis Ulmsel", None), ("B", "C-4", "洛朵莱·普德普", None), ("B", "C-5", None, None), ("D", "C-1", "X Y", None), ("B", "C-1", "即墨晚阑", None)]
    typed = {"即墨大人": "C-1", "阿钧": "C-2", "庹，钧": "C-2", "即墨晚栏": "C-1", "师父": None, "城东更夫": None, "Captain Ulmsel": "C-3", "Trumonis Ulmsel": "C-3", "Ulmsel, Turmonis": "C-3", "T. Ulmsel": "C-3", "TURMONIS ULMSEL": "C-3", "洛·普德普": "C-4", "Hobbert Pook": None, "": None, "即墨晚阑": None, "  ": None}
    c = spark.createDataFrame([(*p, 1) for p in people], "book string, id string, name string, aliases array<string>, spelling int")
    s = spark.createDataFrame([("B", k) for k in typed] + [("B", None), (None, "阿钧"), ("B", "阿钧"), ("Z", "阿钧")], "book string, spelling string")
    want = sorted((("B", k, v) for k, v in typed.items() if v), key=repr)
    assert rows(names.linked(s, c)) == want
    assert rows(names.linked(s, c, names_per_trie=2, spellings_per_task=3)) == want
    assert names.linked(s, c.limit(0)).count() == 0


def test_ties_are_broken_over_all_tries(spark, rows):
    n = 6
    at = dict(spark.range(60).selectExpr("concat('C-', id) as i", f"pmod(xxhash64(concat('C-', id)), {n}) as t").collect())
    a, b = next((x, y) for x in at for y in at if at[x] != at[y])
    c, d = next((x, y) for x in at for y in at if at[x] != at[y] and not {x, y} & {a, b})
    e, f = next((x, y) for x in at for y in at if at[x] == at[y] and x < y and not {x, y} & {a, b, c, d})
    # 兰 and 栏 are near each other by sound, 兰 and 空 are not; two of one name stay undecided.
    people = [(a, "José Marin"), (b, "Jose Keller"), (c, "林晚兰"), (d, "林晚空"), (e, "Ana Petri"), (f, "Ana Ruiz")]
    names_ = spark.createDataFrame([("B", i, x, None) for i, x in people], "book string, id string, name string, aliases array<string>")
    asked = spark.createDataFrame([("B", x) for x in ("José", "Jose", "林晚栏", "Ana", "林晚")], "book string, spelling string")
    want = sorted([("B", "José", a), ("B", "Jose", b), ("B", "林晚栏", c)], key=repr)
    assert rows(names.linked(asked, names_)) == want
    assert rows(names.linked(asked, names_, names_per_trie=1)) == want


@pytest.mark.parametrize("name,alias,typed", [
    ("Juan Carlos Maria Lopez Ruiz", None, "Lopez Ruiz Juan Carlos Maria"), ("Juan Carlos Maria Lopez Ruiz", None, "Lopez Riuz Juan Carlos Maria"),
    ("Anna", None, "Ana"), ("X Y", "Lanternkeeper", "Lanternkeper"), ("Iraove de Wilseleth", None, "Iraove Wilseleth"), ("洛朵莱·普德普", None, "普德普·洛朵来"),
])
def test_no_caps_on_parts_lengths_or_aliases(name, alias, typed):
    book = names.Book([("C-1", name, True), ("C-2", "Hobbert Pook", True), ("C-3", "褟弦珩", True)] + ([("C-1", alias, False)] if alias else []))
    assert list(book.find(typed)[1]) == ["C-1"]


def test_strangers_stay_unlinked():
    book = names.Book([("C-1", "Anna", True), ("C-1", "老王", False), ("C-2", "Tom Fisk", True), ("C-2", "Captain Fisk", False), ("C-3", "褟弦", True)])
    assert all(book.find(x) == (99, {}) for x in ("Anne", "老李", "Captain Risk", "Old Bill", "Tim", "Captain", "", "弦"[:0]))


@pytest.mark.parametrize("name,alias,typed,found", [("林晚兰", "老K爷", "老王爷", False), ("弦", None, "小弦", True), ("/ Ana Petri", None, "Petri Ana", True), ("/林晚", None, "林 晚", True)])
def test_names_with_letters_signs_or_one_character(name, alias, typed, found):
    book = names.Book([("C-1", name, True)] + ([("C-1", alias, False)] if alias else []))
    assert list(book.find(typed)[1]) == ["C-1"] * found


def test_every_spelling_is_found_through_the_trie(monkeypatch):
    walked = []
    near = names.Trie.near
    monkeypatch.setattr(names.Trie, "near", lambda self, *a: walked.append(near(self, *a)) or walked[-1])
    book = names.Book([("C-1", "即墨晚阑", True), ("C-3", "Turmonis Ulmsel", True)])
    for typed in ("即墨大人", "阿阑", "Captain Ulmsel", "T. Ulmsel", "Ulmsel, Turmonis", "Trumonis Ulmsel"):
        walked.clear()
        got = list(book.find(typed)[1])
        assert len(got) == 1 and any(w for w in walked)


def test_a_walk_makes_few_states_and_gives_plain_distances(monkeypatch):
    keys = ["".join(x) for n in range(1, 6) for x in itertools.product("ab林", repeat=n)]
    trie = names.Trie()
    for k in keys:
        trie.add(k, k)

    def plain(a, b):
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    made = []
    step = names.Automaton.step
    monkeypatch.setattr(names.Automaton, "step", lambda self, *a: made.append(a) or step(self, *a))
    for word in ("ab", "bab林", "ax林ba"):
        for bound in range(4):
            made.clear()
            assert trie.near(word, bound) == {k: d for k in keys if (d := plain(k, word)) <= bound}
            assert len(made) < len(keys)


# -- 6 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text,form", [
    ("Ｇｒａｄｅ ７", "Grade 7"), ("café", "café"), ("鄢﻿珩", "鄢珩"), ("a\xa0b", "a b"), ("Lеvel 19", "Level 19"), ("NΡC商人", "NPC商人"), ("德哈⽂", "德哈文"), ("\uf967能", "不能"), ("so\xadft", "soft"), ("⻛起", "风起"),
])
def test_posing_characters(text, form):
    assert confusables.normal_form(text) == (form, True)


@pytest.mark.parametrize("text", ["代号α的第2次试验", "墙上刻着 Ворон 一词", "Grade Ω, file 7", "（“。！”）　…—·・．〇", "naïve ñandú ß œ", "", "a\nb\r\nc\td", "👩‍🚀 ok", "年号写作二〇三年", "µm ª º"])
def test_ordinary_characters(text):
    assert confusables.normal_form(text) == (text, False)


@pytest.mark.parametrize("text,form", [("ѕсоре", "scope"), ("the раура tree", "the paypa tree")])
def test_whole_script_confusables(text, form):
    assert confusables.normal_form(text, whole=True) == (form, True)
    assert confusables.normal_form(text) == (text, False)


@pytest.mark.parametrize("text", ["он сказал", "墙上刻着 Ворон 一词", "οὐσία και", "アリス"])
def test_words_of_another_script_beyond_doubt(text):
    assert confusables.normal_form(text, whole=True) == (text, False)


@pytest.mark.parametrize("text,form", [("𝐀lpha", "Alpha"), ("ﬁn", "fin"), ("Ⅳ", "IV"), ("ｶﾅ", "カナ"), ("ｶﾞ", "ガ")])
def test_remaining_forms(text, form):
    assert confusables.normal_form(text) == (form, False)


def test_script_extensions_and_public_table(spark):
    assert {"Japanese", "Chinese", "Korean"} <= confusables.scripts("木") and confusables.resolved("aб") == frozenset() and confusables.resolved("カ木") == {"Japanese"}
    assert confusables.scripts("1") == frozenset() and "Cyrillic" in confusables.scripts("\u0483") and "Latin" not in confusables.scripts("\u0483")
    t = confusables.public_table(spark)
    assert t["а"] == ("a", True) and t["н"] == ("h", False) and t["Ꭺ"] == ("A", True) and t["օ"] == ("o", True) and len(t) > 200
    confusables.install(t)
    assert confusables.normal_form("Ꭺlpha") == ("Alpha", True) and confusables.whole_script("ѕсоре") == "scope"
    confusables.install({})


def test_normalized_keeps_nulls(spark, rows):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ａ")], "id int, text string")
    assert rows(confusables.normalized(df, "text")) == [(1, None, None, False), (2, "", "", False), (3, "ａ", "a", True)]


# -- 7 --------------------------------------------------------------------------------------------


def test_ids_equal_the_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    texts = [ZH, FR, "<|endoftext|> it's we'll", "a" * 3000, "\x1c \x85  x  \n\n y", "👩‍🚀 𠮷 ǅ", None, "", "ab " * 500, "没" * 700]
    texts += ["".join(chr(rnd.choice((rnd.randint(32, 126), rnd.randint(0xA0, 0x24F), rnd.randint(0x4E00, 0x9FFF), 32, 10))) for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(df).collect()}
    assert all(got[i] == lib.encode_ordinary(t or "") for i, t in enumerate(texts))
    small = bpe.Bpe(bpe.default_vocabulary(), keep=5)
    ids, n = small.encode(texts)
    assert ids.tolist() == [x for t in texts for x in lib.encode_ordinary(t or "")] and n.sum() == len(ids)
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.sizes(df).collect()} == {i: len(x) for i, x in got.items()}


# -- 8 --------------------------------------------------------------------------------------------


def best_bins(items, c):
    """Fewest bins by search, for small cases."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for j, b in enumerate(bins):
            if b + items[i] <= c and b not in seen:
                seen.add(b)
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_plans_are_whole_and_near_the_best():
    rnd = random.Random(8)
    for trial in range(120):
        c = rnd.choice([10, 50, 200])
        items = [rnd.randint(1, c) for _ in range(rnd.randint(1, 9 if trial < 60 else 200))]
        hist = {s: items.count(s) for s in set(items)}
        load, placed = {}, {}
        for s, r0, r1, p, q in packing.plan(hist, c):
            placed[s] = placed.get(s, 0) + r1 - r0
            for k in range((r1 - r0) // q):
                load[p + k] = load.get(p + k, 0) + s * q
        assert placed == hist and max(load.values()) <= c and sorted(load) == list(range(len(load)))
        if trial < 60:
            assert len(load) <= best_bins(items, c) + 1
    counts = np.zeros(11, np.int64)
    for s in (7, 3, 6, 6):
        counts[s] += 1
    assert packing.dominant_sets(counts, 10) == [(1, ((7, 1), (3, 1))), (2, ((6, 1),))]


def test_dominant_sets_keep_the_best():
    rnd = random.Random(11)
    seen = set()
    for _ in range(400):
        c = rnd.choice([10, 20, 40])
        items = [rnd.randint(1, c) for _ in range(rnd.randint(1, 8))]
        counts = np.bincount(items, minlength=c + 1).astype(np.int64)
        fixed = packing.dominant_sets(counts, c)
        rest = [s for s, n in enumerate(counts.tolist()) for _ in range(n)]
        taken = [s for n, what in fixed for s, q in what for _ in range(n * q)]
        assert sorted(rest + taken) == sorted(items) and all(sum(s * q for s, q in what) <= c for _, what in fixed)
        assert sum(n for n, _ in fixed) + (best_bins(rest, c) if rest else 0) == best_bins(items, c)
        seen |= {sum(q for _, q in what) for _, what in fixed}
    assert seen >= {1, 2, 3}


def test_packed(spark):
    n = [0, 5, 10, 23, 7, 3, 3, 3, 0, 10] + [4] * 40
    df = spark.createDataFrame(list(enumerate(n)), "doc_id long, n_tokens int")
    got = [tuple(r) for r in packing.packed(df, 10, per_part=4).select("doc_id", "part", "n_tokens", "pack_id").collect()]
    by, loads = {}, {}
    for d, p, t, k in got:
        by.setdefault(d, []).append((p, t))
        loads[k] = loads.get(k, 0) + t
    assert max(loads.values()) <= 10 and len(loads) == 27
    assert all(sum(t for _, t in by[i]) == x for i, x in enumerate(n))
    assert sorted(by[3]) == [(1, 10), (2, 10), (3, 3)] and all(len(by[i]) == 1 for i, x in enumerate(n) if x <= 10)
    assert packing.packed(df.limit(0), 10).count() == 0


def test_packs_of_every_kind(spark):
    docs = spark.createDataFrame([(1, ZH), (2, None), (3, FR * 3)], "doc_id long, text string").withColumn("pack_id", F.lit("x"))
    budgets = spark.createDataFrame([("a", "byte_bpe_50k", 64), ("b", "byte_bpe_multi_50k", 4096)], "pack_kind string, tokenizer string, capacity int")
    got = packing.packs(docs, budgets).collect()
    assert sorted(packing.packs(docs.union(docs), budgets).collect()) == sorted(got)
    assert {r["doc_id"] for r in got if r["pack_kind"] == "b"} == {1, 2, 3} and max(r["n_tokens"] for r in got if r["pack_kind"] == "a") <= 64


# -- 9 --------------------------------------------------------------------------------------------


def wrong(text, true, read):
    return "".join(mojibake._table(read)[b] for b in text.encode(true)) if read not in mojibake.WIDE else text.encode(true).decode(read, "replace")


@pytest.fixture(scope="module")
def corpus():
    return [ZH] * 40 + [FR] * 40 + ["гонец спрятал карту без подписи в последний раз, никто не отвечал"] * 30 + ["牌子背面写着 등대 두 번째 골목。", "少女自称アヤメ。", "MAÇÃ®、Ωμέγα。", "«PÂ», puis «IRMÃ»", "ﬁn ﬂeur", "modrá síň, č. 7", "№7 §3 ½ 両", "n° 5, nº 6"] * 2


CASES = [(ZH, "utf-8", "latin-1"), (ZH, "utf-8", "cp1251"), (ZH, "utf-8", "gbk"), (ZH, "gbk", "latin-1"), (ZH, "gbk", "koi8-r"), (FR, "utf-8", "cp1252"), (FR, "utf-8", "mac_roman"), ("гонец спрятал карту", "utf-8", "cp1251"), ("гонец спрятал карту без подписи", "koi8-r", "cp1251"), ("檐下的铃响了一阵", "gbk", "cp949")]


def test_detection(spark, corpus):
    right = corpus
    bad = [wrong(*c) for c in CASES] + ["x�y", "caf\x85\x82", "锟斤拷"]
    docs = spark.createDataFrame(list(enumerate([*right, *bad, None, ""])), "doc_id long, text string").withColumn("restored", F.lit(1))
    got = {r["doc_id"]: r for r in mojibake.garbled(docs).collect()}
    assert sorted(got) == list(range(len(right), len(right) + len(bad)))
    plain = mojibake.garbled(docs, restore=False)
    assert plain.columns == ["doc_id"] and sorted(r[0] for r in plain.collect()) == sorted(got)
    for i in (0, 1, 3, 5, 7):
        assert got[len(right) + i]["restored"] == CASES[i][0]
    assert mojibake.garbled(docs.limit(0)).count() == 0


def test_only_the_span_is_replaced(spark, corpus):
    text = f"{ZH}{wrong('没有人应声', 'utf-8', 'latin-1')}{FR}"
    docs = spark.createDataFrame(list(enumerate([*corpus, text])), "doc_id long, text string")
    got = mojibake.garbled(docs).collect()
    assert [(r["doc_id"], r["restored"], r["n_lost"]) for r in got] == [(len(corpus), f"{ZH}没有人应声{FR}", 0)]


def test_rare_characters_of_a_large_corpus():
    d = mojibake.Detector({"a": 2_000_000_000, "é": 50_000_000, "守": 30})
    assert [(s.restored, s.pair) for s in d.spans("a " + wrong("守", "utf-8", "latin-1") + " a")][-1:] == [("守", "utf-8>latin-1")]
    assert d.spans("aéa 守") == []


@pytest.mark.parametrize("times", [1, 1_000, 1_000_000])
def test_a_larger_corpus_loses_nothing(times):
    from collections import Counter

    rest, few = Counter("gonec spriatal é ü ñ карту без подписи 没有人应声檐下的铃响了一阵" * 50), Counter("守夜珗" * 5)
    d = mojibake.Detector({c: n * times for c, n in rest.items()} | few)
    for c in few:
        bad = "a " + wrong(c, "utf-8", "latin-1") + " a"
        assert d.is_garbled(bad) and d.restore(bad, d.spans(bad)) == f"a {c} a"
    assert not d.is_garbled("gonec é 守夜 карту")


def test_every_finding_starts_from_a_match(corpus, monkeypatch):
    from collections import Counter

    d = mojibake.Detector(Counter("".join(corpus)))
    bad = [wrong(*c) for c in CASES[:8]] + ["x�y", "caf\x85\x82", "锟斤拷", "a\ue123"]
    assert all(d.is_garbled(t) for t in bad[:6] + bad[8:])
    monkeypatch.setattr(mojibake.Detector, "matches", lambda self, text: [])
    assert not any(d.is_garbled(t) or d.spans(t) for t in bad)


@pytest.mark.parametrize("before,word,after", [("«", "карту", "»"), ("他说", "гонец", "，"), ("—", "спрятал", "…"), ("", "КАРТУ", "!"), ("x ", "карту на столе в", " y"), ("", "гонец—спрятал", ""), ("", "спряталкартубезподписи" * 4, "")])
@pytest.mark.parametrize("true,read", [("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "cp866")])
def test_cyrillic_words_in_any_place(before, word, after, true, read):
    from collections import Counter

    grams = Counter()
    text = "гонец спрятал карту без подписи в последний раз, никто не отвечал, на столе. " * 200 + "спряталкартубезподписиспрятал " * 9
    text += "«À», où — était-ce l'été ? “É”, ÄÖÜ. " * 50 + "他说：“——你……” «Да», — сказал он. НЕ НА "
    grams.update(text)
    for w in mojibake._CYRILLIC_WORD.findall(text):
        grams.update(map("".join, zip(w, w[1:])))
    d = mojibake.Detector(grams)
    assert not list(d._cyrillic(text, d.matches(text)))
    parts = [mojibake._read(x.encode(true), read) for x in word.split("—")]
    bad = before + "—".join(parts) + after
    assert d.restore(bad, [s for s in d.spans(bad) if s.pair == f"{true}>{read}"]) == before + word + after
    assert d.is_garbled(f"x {mojibake._read('на'.encode(true), read)} y") == (read != "cp866")  # two small letters there


def test_queries_run_over_whole_tables(spark):
    from scrollwork.llm import queries

    got = {name: queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect() for name in ("p1_found", "p3_found", "p6_found", "p9_found", "p9_restored", "p1_classes")}
    assert all(len(r) == len(set(r)) for r in got.values()) and all(got.values())
    assert {r["doc_id"] for r in got["p9_found"]} == {r["doc_id"] for r in got["p9_restored"]}
    links = sum(r["n_links"] for r in got["p1_classes"])
    assert links == 2 * len(got["p1_found"])
