"""Blocks of sequences, intake, corpus measures, files and SQL functions on small cases."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scrollwork import __main__ as cli
from scrollwork.functions import packs, sqlfunctions, text
from scrollwork.operators import brief, checks, corpus, history, intake, ledger, metrics, rules, sequence, similarity
from scrollwork.sources import files, sinks, tables

AT = "timestamp'2024-01-01'"


@pytest.mark.parametrize("block", [2, 256])
def test_running_numbered_and_previous_against_brute_force(spark, rows, block):
    rnd = random.Random(5)
    data = [(k, t, rnd.randint(0, 9)) for k in "ab" for t in sorted(rnd.sample(range(900), 25))]
    df = spark.createDataFrame(data, "k string, t int, v int").repartition(3)
    total = [(k, t, sum(w for q, s, w in data if q == k and s <= t)) for k, t, _ in data]
    got = sequence.running(df, ["k"], F.floor(F.col("t") / block), ["t"], F.col("v"), "sum")
    assert rows(got, "k", "t", "sum") == sorted(total, key=repr)
    assert rows(sequence.numbered(df, ["k"], "t", "n", block), "k", "t", "n") == sorted([(k, t, sum(q == k and s <= t for q, s, _ in data)) for k, t, _ in data], key=repr)
    before = {(k, t): max(((s, w) for q, s, w in data if q == k and s < t), default=(None, None)) for k, t, _ in data}
    assert rows(sequence.previous(df, ["k"], "t", {"pt": "t", "pv": "v"}, block), "k", "t", "pt", "pv") == sorted([(k, t, *before[k, t]) for k, t, _ in data], key=repr)
    assert sequence.running(df.limit(0), ["k"], F.col("t"), ["t"], F.col("v"), "s").count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_intervals_with_the_one_before(spark, rows, block):
    data, want = [], []
    rnd = random.Random(6)
    for k in range(5):
        times = sorted(rnd.sample(range(60), 20))
        for i, t in enumerate(times):
            v, until, back = rnd.choice("ab"), times[i + 1] if i + 1 < len(times) else None, times[i - 1] if i else None
            if rnd.random() < 0.2:
                continue
            data.append((k, v, t, until, back))
            if want and want[-1][0] == k and want[-1][3] == t and want[-1][1] == v:
                want[-1] = (*want[-1][:3], until)
            else:
                want.append((k, v, t, until))
    df = spark.createDataFrame(data, "k int, v string, s int, e int, b int").repartition(3)
    assert rows(sequence.coalesce_intervals(df, ["k"], "v", "s", "e", block, "b"), "k", "v", "s", "e") == sorted(want, key=repr)


def test_observations_over_blocks(spark, rows):
    s = spark.createDataFrame([(1, "B", 1, [("C", {"a": "1"}), ("C", {"a": "9"})]), (2, "B", 300, [("C", {"a": "1"})]), (3, "B", 301, [("D", None)]), (4, None, 5, [("C", {"a": "x"})])], "snapshot_id long, book string, chapter int, characters array<struct<id:string,state:map<string,string>>>").withColumn("taken_at", F.expr(AT))
    c = spark.createDataFrame([("B", "C", 700, {"a": "1"}), ("B", "D", 300, {"a": "2"}), ("B", "E", 4, {"a": "3"})], "book string, id string, last_chapter int, state map<string,string>").withColumn("updated_at", F.expr(AT))
    assert rows(history.observations(s, c), "character_id", "chapter", "before", "until") == sorted([("C", 1, None, 300), ("C", 300, 1, 700), ("C", 700, 300, None), ("D", 301, None, None), ("E", 4, None, None)], key=repr)
    assert rows(history.versions(s, c), "character_id", "value", "from_chapter", "to_chapter") == [("C", "1", 1, 0), ("E", "3", 4, 0)]


def _analysis(spark, rows_, extra):
    return spark.createDataFrame(rows_, "analysis_id long, book string, chapter int, " + extra).withColumn("submitted_at", F.expr(AT))


def test_memberships_join_and_leave(spark, rows):
    org = lambda *m: [("Guild", list(m))]
    a = _analysis(spark, [(1, "B", 1, org(("A", "elder", "join"), ("X", None, "join"))), (2, "B", 2, org(("A", None, "role"), ("X", None, "leave"), (None, "x", "join"))), (3, "B", 3, None)], "organizations array<struct<name:string,members:array<struct<character:string,role:string,action:string>>>>")
    assert rows(ledger.memberships(a)) == [("B", "Guild", "A", "elder", 1)]


def test_relations_of_nobody(spark, rows):
    a = _analysis(spark, [(1, "B", 1, [("A", "Z"), ("N", None)], [("N",)])], "relationships array<struct<a:string,b:string>>, characters array<struct<name:string>>")
    c = spark.createDataFrame([("B", "C-1", "A", None)], "book string, id string, name string, aliases array<string>")
    assert rows(intake.unknown_relations(a, c)) == [("B", 1, "b", "Z")]


def test_plants_meet_threads_in_three_steps(spark, rows):
    op = lambda t, i=None, act="plant": (i, act, (t,))
    a = _analysis(spark, [(1, "B", 1, [op("旧 灯！"), op("两"), op("全新"), op("x", "F-1"), op(None), op("y", None, "payoff"), op("z", "F-77", "payoff")])], "foreshadow_ops array<struct<id:string,action:string,new_item:struct<title:string>>>")
    f = spark.createDataFrame([("B", "F-1", "planned", "旧灯"), ("B", "F-2", "resolved", "两")], "book string, id string, status string, title string").withColumn("fp", F.lit(None).cast("string")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    assert rows(intake.matched_plants(a, f), "pos", "thread", "step") == sorted([(0, "F-1", 1), (1, "F-2", 3), (2, None, None)], key=repr)
    assert rows(intake.operation_faults(a, f), "pos", "code") == [(4, "plant_without_title"), (5, "op_without_id"), (6, "op_unknown_id")]


def test_snapshot_after_chapters(spark, rows):
    a = _analysis(spark, [(i, "B", ch, [("A", {"loc": v})]) for i, ch, v in ((1, 1, "x"), (2, 300, "y"), (3, 900, "z"))], "characters array<struct<name:string,updates:map<string,string>>>")
    c = spark.createDataFrame([("B", "C-1", "A", None)], "book string, id string, name string, aliases array<string>")
    at = spark.createDataFrame([("B", n) for n in (0, 1, 299, 300, 1000)], "book string, chapter int")
    assert rows(intake.snapshot(a, c, at), "chapter", "value") == [(1, "x"), (1000, "z"), (299, "x"), (300, "y")]


def test_split_chapters(spark, rows):
    d = spark.createDataFrame([(1, "前言\n第一章 开\n甲乙\n## 第2章\n丙"), (2, "第一章 只有\n一个"), (3, None)], "doc_id long, text string")
    assert rows(corpus.split_chapters(d), "doc_id", "no", "title", "body") == [(1, 1, "第一章 开", "\n甲乙\n"), (1, 2, "第2章", "\n丙")]


def test_anchors_are_guarded(spark, rows, tmp_path):
    good = spark.createDataFrame([("sentence_median", 30.04), ("short20_ratio", 0.2), ("ellipsis", 1.0), ("excl", 9.0)], "measure string, median double")
    assert rows(corpus.anchors(good)) == [(30.0, 0.2, 1.0, "corpus")]
    for bad in (good.where("measure <> 'ellipsis'"), good.withColumn("median", F.lit(500.0)), good.limit(0)):
        assert rows(corpus.anchors(bad)) == [(*packs.ANCHORS.values(), "builtin")]
        with pytest.raises(ValueError, match="too small"):
            sinks.write_anchors(corpus.anchors(bad), str(tmp_path / "a.json"))
    sinks.write_anchors(corpus.anchors(good), str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text())["sentence_median"] == 30.0


def test_counting_alternatives_one_by_one(spark):
    import re

    rnd = random.Random(3)
    patterns = [p for p in [*packs.COUNTS.values(), *packs.NARRATION_COUNTS.values()] if not any(c in p for c in "[(")] + ["扑|扑通|哗啦|啦", "a|ab|ba", "甲|乙丙|丙"]
    words = sorted({w for p in patterns for w in p.split("|") if re.escape(w) == w})
    texts = ["".join(rnd.choice(words) if rnd.random() < 0.6 else rnd.choice("的了a\n") for _ in range(80)) for _ in range(12)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(*[text.hits(F.col("t"), p).alias(f"n{i}") for i, p in enumerate(patterns)]).collect()
    assert [tuple(r) for r in got] == [tuple(len(re.findall(p, t)) for p in patterns) for t in texts]


def test_narration_without_whole_speech_at_the_end(spark):
    import re

    texts = ["他说“一”。“没完 了", "“「甲」乙”", "」开", "“a” # x\n# 标题\n“b", "", "无"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(text.narration(F.col("t"))).collect()]
    assert got == [re.sub("(?m)^#.*$", "", re.sub(packs.SPEECH, "", t)) for t in texts]


def test_scenes_at_both_ends(spark, rows):
    d = spark.createDataFrame([(1, "递茶递水" + "长" * 20 + "递茶"), (2, None), (3, "无")], "doc_id long, text string")
    assert rows(metrics.scenes(d, packs.CARE), "no", "hit", "excerpt") == [(1, "递茶", "递茶递水" + "长" * 14), (2, "递水", "递茶递水" + "长" * 16), (3, "递茶", "长" * 12 + "递茶")]


def test_upper_median_of_shares(spark, rows, monkeypatch):
    shares = [1, 1, 2, 5, 7, 7]
    r = spark.createDataFrame([("B", i, 0, s, 10) for i, s in enumerate(shares)] + [("C", 1, 0, 3, 10)], "book string, chapter int, other int, shared long, total long")
    monkeypatch.setattr(similarity, "repeats", lambda docs: r)
    assert rows(similarity.repeat_baseline(None), "book", "n_pairs", "median") == [("B", 6, 0.5), ("C", 1, 0.3)]


def test_ban_lists_and_libraries(spark, rows, tmp_path):
    bans = spark.createDataFrame([("一丝", False), ("总之[,，]", True), ("(", True)], "pattern string, regex boolean")
    d = spark.createDataFrame([("有一丝",), ("总之，",), ("(",)], "t string")
    assert [r[0] for r in d.select(checks.banned(F.col("t"), bans)).collect()] == [True, True, False]
    assert [r[0] for r in d.select(checks.banned(F.col("t"), bans.limit(0))).collect()] == [False] * 3
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"id": "A", "level": "core", "mode": "ban", "kind": "word", "pattern": "x", "hint": "h"}, {"id": "B", "level": "wide", "mode": "watch", "kind": "word", "pattern": "y", "hint": "h"}]}))
    assert rows(files.rule_library(spark, str(tmp_path / "r.json"), "standard"), "id") == [("A",)]
    fixed = spark.createDataFrame([(1, "好,好。。坏词")], "doc_id long, text string")
    assert rows(rules.repairs(fixed, [("坏词", "好词")])) == [(1, "好，好。好词", False)]


def test_projects_on_disk(spark, rows, tmp_path):
    (tmp_path / "material" / "style-sample").mkdir(parents=True)
    (tmp_path / "material" / "style-sample" / "a.txt").write_text("甲", encoding="utf-8")
    (tmp_path / "material" / "style-sample" / "b.md").write_text("  \n", encoding="utf-8")
    (tmp_path / "material" / "style-sample" / "c.log").write_text("x")
    where = files.resolve_corpus(str(tmp_path))
    assert where.endswith("style-sample") and files.resolve_corpus(where) == where
    assert rows(files.corpus(spark, where)) == [("a", "甲")]
    made = sinks.scaffold(spark, str(tmp_path), {"books": "book string", "plans": "doc_id long, text string"})
    assert made == ["books", "plans"] and sinks.scaffold(spark, str(tmp_path), {"books": "x int"}) == []
    assert tables.register(spark, str(tmp_path), ("books",)) == ["books"] and spark.sql("select book from books").count() == 0
    p = str(tmp_path / "ledger.json")
    for v in (1, 2):
        sinks.write_json(spark.createDataFrame([(v,)], "v int"), p)
    assert rows(spark.read.json(p)) == [(2,)]
    sinks.report(spark.range(1500).selectExpr("id", "'a|b' as s"), str(tmp_path / "r.md"), "t")
    assert (tmp_path / "r.md").read_text().count("\\|") == 1500
    c = spark.createDataFrame([(1, "# 一\n甲"), (3, "丙")], "n int, text string")
    with pytest.raises(ValueError, match="chapter 2"):
        sinks.export_epub(c, str(tmp_path / "b.epub"), "书", whole=True)
    sinks.export_epub(c, str(tmp_path / "b.epub"), "书")
    with zipfile.ZipFile(tmp_path / "b.epub") as z:
        opf = z.read("OEBPS/content.opf").decode()
        assert {"OEBPS/title.xhtml", "OEBPS/style.css"} <= set(z.namelist()) and "dcterms:modified" in opf


def test_names_with_slashes_are_dropped(spark, rows, tmp_path):
    p = str(tmp_path / "events")
    e = spark.createDataFrame([("a", "B/1: x", 1), ("b", "B/1: x", 2)], "v string, book string, chapter int")
    sinks.write_events(e, p)
    sinks.drop_chapter(spark.read.parquet(p), p, "B/1: x", 1)
    assert rows(spark.read.parquet(p), "v", "chapter") == [("b", 2)]
    bad = spark.createDataFrame([("E", "x")] * 150, "severity string, code string")
    assert len(sinks.apply_chapters(e, bad, p, str(tmp_path / "errors"), shown=5)) == 5
    assert spark.read.parquet(str(tmp_path / "errors")).count() == 150


def test_sql_functions_equal_the_column_functions(spark, rows):
    assert set(sqlfunctions.register(spark)) >= {"count_words", "text_lines"}
    d = spark.createDataFrame([("　甲 乙\t",), ("A，b！",), ("",), (None,)], "t string")
    d.createOrReplaceTempView("some")
    for fn, col in (("count_words", text.count_words), ("strip_ws", text.strip_ws), ("title_fingerprint", text.fingerprint)):
        assert [r[0] for r in spark.sql(f"select {fn}(t) from some").collect()] == [r[0] for r in d.select(col(F.col("t"))).collect()]
    assert rows(spark.sql("select no, line from text_lines('a\nb')")) == [(1, "a"), (2, "b")]
    assert spark.sql("select set_overlap(hook_values('甲乙-丙丁'), hook_values('丙丁'))").first()[0] == 0.5


def test_recall_of_a_plan(spark, rows):
    long = "铜钥匙在井台下面，谁也没有再提起它，直到雨停了，潮水退去，墙角的影子也不见了，众人才想起来。"
    docs = spark.createDataFrame([(i, "chapter", "B", i, f"# 第{i}章\n\n" + (long if i == 2 else f"天色{i}，" + "旁的事情说了很多很多很多很多很多很多很多很多很多很多很多很多很多。")) for i in range(1, 9)] + [(99, "plan", "B", 9, "铜钥匙 井台")], "doc_id long, doc_kind string, book string, chapter int, text string")
    books = spark.sql("select 'B' as book, 9 as current_chapter")
    assert rows(brief.recall(docs, books, least=1.0), "chapter", "rank") == [(2, 1)]
    assert brief.recall(docs.limit(0), books).count() == 0


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "p2_found" in capsys.readouterr().out
    assert cli.main([]) == 2 and cli.main(["no_such", "x"]) == 2
