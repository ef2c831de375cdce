"""Text statistics, rules, retrieval, checks and readers on small inline texts."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from scrollwork.functions import packs, text
from scrollwork.operators import checks, lookup, metrics, retrieval, rules, similarity
from scrollwork.sources import files, sinks

PILE = "他攥拳，手在抖。刀落了，他偏头。他明白了。一切都完了。没人动。"


@pytest.fixture
def docs(spark):
    def make(*texts, **cols):
        return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", *[f"{v} as {k}" for k, v in cols.items()])

    return make


def one(df, *cols):
    r = df.select(*cols).collect()
    assert len(r) == 1
    return tuple(r[0])


def test_counts(docs, spark):
    d = docs("# 题\n他仿佛瞬间明白了……然而。“我还没——”“沙沙——”她说：“来不及！”看，听，闻。！！", None, "", words="'clash'")
    c = metrics.counts(d)
    r = c.where("doc_id = 0").collect()[0]
    assert (r["n_simile"], r["n_pacer"], r["n_connector"], r["n_ellipsis"], r["n_dash"], r["n_excl"], r["n_setback"], r["n_punct_repeat"], r["n_cut_off"]) == (1, 1, 1, 1, 2, 3, 1, 1, 1)
    assert [tuple(x) for x in c.where("doc_id > 0").select("words", "n_excl").collect()] == [(0, 0), (0, 0)]
    assert metrics.densities(d).where("doc_id > 0").select("excl").distinct().collect()[0][0] == 0.0
    assert {x["flag"] for x in metrics.flags(d).collect()} >= {"excl", "dash", "punct_repeat"}
    assert metrics.counts(docs()).count() == 0


def test_sentences_use_the_upper_median(docs):
    d = docs("一二三四。一二三四五六。一二。一二三四五六七八。“不算在内的话。”")
    assert one(metrics.sentence_stats(d), "n_sent", "total", "median", "n_short", "longest") == (4, 20, 6, 4, 8)


def test_paragraph_rhythm_and_runs(docs):
    d = docs("# t\n\n甲乙丙。\n\n甲乙丁。\n甲乙戊。丁己庚。\n甲乙辛。\n")
    assert one(metrics.paragraph_rhythm(d), "n_para", "n_one", "longest_run", "run_line") == (4, 3, 2, 3)
    assert one(metrics.start_runs(d), "run", "head") == (4, "甲乙")


def test_exposition_needs_neighbours(docs):
    expo = "官盐与粗盐的密度相差甚远本质上属于两种物质"
    got = metrics.exposition_runs(docs(f"# t\n他走了。\n\n{expo}\n\n{expo}\n他走了。", f"{expo}\n他走了。\n{expo}"))
    assert one(got, "doc_id", "first_line", "last_line", "n_para") == (0, 4, 6, 2)


def test_short_and_emphasis_runs(docs, rows):
    plain = "天亮了。他醒了。门开着。灯没灭。茶凉了。"
    d = docs(f"{plain}\n\n{plain}\n他想了很久很久才终于把那句话完整地说出口来。\n\n\n{plain}", PILE, "一句。")
    assert rows(metrics.short_runs(d).where("doc_id = 0"), "first_line", "last_line", "n_sent") == [(1, 3, 10), (7, 7, 5)]
    got = {r["doc_id"]: r for r in metrics.emphasis_runs(d).collect()}
    assert 0 not in got


def test_frames(docs, rows):
    d = docs("“走。”\n他说完了？", "清晨，雪。\n命运的齿轮转动", "# 只有题", "他走了。\n……", doc_kind="'chapter'", book="'B'", chapter="cast(doc_id as int)")
    assert rows(metrics.frames(d)) == [(0, "speech", "question"), (1, "time", "summary"), (2, "empty", "empty"), (3, "other", "ellipsis")]
    same = docs(*["“甲。”\n乙。"] * 3, doc_kind="'chapter'", book="'B'", chapter="cast(doc_id * 5 as int)")
    assert rows(metrics.frame_runs(same), "side", "kind", "first_chapter", "last_chapter") == [("opening", "speech", 0, 10)]
    assert rows(metrics.quota_windows(same)) == [("B", 10)]


def test_side_flips_and_scenes(docs, rows):
    d = docs("左手左手右手", "无", "右手", doc_kind="'chapter'", book="'B'", chapter="cast(doc_id as int)")
    assert rows(metrics.side_flips(d)) == [("B", "手", 2, "left", "right")]
    got = rows(metrics.scenes(docs("他端来一碗。她递茶。"), packs.CARE), "no", "hit", "excerpt")
    assert got == [(1, "端来", "他端来一碗。她递茶。"), (2, "递茶", "他端来一碗。她递茶。")]


def test_gaps_and_duplicates(docs, rows):
    assert one(metrics.dialogue_gap(docs("“甲”乙丙“丁”戊“")), "n_quotes", "gap") == (3, 5)
    s = "这一句话要足够地长才能够算数"
    assert rows(metrics.duplicate_sentences(docs(f"{s}。{s}！短。短。")), "sentence", "n") == [(s, 2)]


def test_repetition(docs, rows):
    d = docs("甲乙丙丁戊己", "甲乙丙丁庚辛", "子丑寅卯", None, doc_kind="'chapter'", book="'B'", chapter="cast(doc_id as int)")
    assert rows(similarity.repeats(d)) == [("B", 1, 0, 2, 4), ("B", 2, 0, 0, 2), ("B", 2, 1, 0, 2)]
    assert one(similarity.repeat_baseline(d), "n_pairs", "median", "threshold") == (3, 0.0, 0.15)


def test_rules(docs, spark, rows):
    d = docs("他不禁一丝不苟，一丝一毫。\n总之，算了。", None)
    assert rows(rules.counts(d), "rule", "n") == [("R001", 2), ("R003", 1), ("R102", 1)]
    assert rows(rules.scan(d), "line", "rule", "hit") == [(1, "R001", "一丝"), (1, "R003", "不禁"), (2, "R102", "总之，")]
    assert rules.validate(packs.RULES) == []
    bad = [("R1", "core", "ban", "regex", "(", "h"), ("R1", "x", "ban", "word", "a", "")]
    assert {f for _, f in rules.validate(bad)} == {"bad pattern", "repeated id", "unknown level", "no hint"}
    assert rules.validate([("R", "core", "ban", "word", "甲", "h")], {"R": (["甲乙", "丙"], ["甲"])}) == [("R", "example not hit"), ("R", "example hit")]
    manual = spark.createDataFrame([("一丝",), ("自家",), ("自家",)], "pattern string")
    assert rules.merged_bans(manual, rules.library(spark, "core")).where("source = 'manual'").count() == 1


def test_repair_keeps_the_prose(docs):
    assert one(rules.repairs(docs("他说,好!!真的？？走3,000里.嗯", "没有毛病。")), "text", "same_prose") == ("他说，好!!真的？走3,000里。嗯", True)


def test_evasion(docs):
    d = docs("勾起一抹，勾起一丝，勾起，勾起")
    assert one(rules.evasions(d, ["嘴角勾起"]), "pair", "n") == ("勾起", 4)


def test_bm25(docs, spark, rows):
    d = docs("# 题\n" + "甲乙" * 100 + "\n\n" + "丙丁" * 60 + "\n\n短", "丙丁", None)
    c = retrieval.chunks(d)
    assert rows(c.selectExpr("doc_id", "chunk", "length(body)")) == [(0, 0, 200), (0, 1, 122), (1, 0, 2)]
    q = spark.createDataFrame([(1, "丙丁 丙丁"), (2, "无此"), (3, None)], "query_id long, query string")
    got = [(r["doc_id"], r["chunk"]) for r in retrieval.bm25(c, q).where("query_id = 1").orderBy("rank").collect()]
    assert got == [(0, 1), (1, 0)] and retrieval.bm25(c, q).where("query_id > 1").count() == 0


def test_bm25_of_whole_plans_against_brute_force(spark, tmp_path):
    import math
    import random

    from scrollwork.plans import corpusqueries

    rnd = random.Random(3)
    word = lambda: rnd.choice(["Rook", "gate", "l9", "甲乙", "丙", "丁戊己", "刀", "，"])
    body = lambda n: " ".join(word() for _ in range(n))
    chapters = [(i, "chapter", "\n\n".join(body(rnd.randint(20, 60)) for _ in range(rnd.randint(0, 5)))) for i in range(30)]
    tail = "末" + body(5)
    chapters += [(30, "chapter", tail), (31, "chapter", tail)]
    plans = [(50 + i, "plan", "# 计划 " + "…" * 60 + body(40)) for i in range(5)] + [(60, "plan", "…" * 80 + "末"), (61, "plan", None), (62, "plan", "…")]
    spark.createDataFrame(chapters + plans, "doc_id long, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpusqueries.bm25_plans(spark, str(tmp_path), every=1)

    parts = [tuple(r) for r in retrieval.chunks(spark.createDataFrame(chapters, "doc_id long, k string, text string")).collect()]
    toks = {r[:2]: [x for x in spark.range(1).select(text.tokens(F.lit(r[2]))).first()[0]] for r in parts[:3]}
    assert all(sorted(toks[r[:2]]) == sorted(retrieval._local_tokens(r[2])) for r in parts[:3])
    toks = {r[:2]: retrieval._local_tokens(r[2]) for r in parts}
    avg = sum(map(len, toks.values())) / len(toks)
    want = set()
    for q, _, t in plans:
        s = {}
        for at, ts in toks.items():
            for w in set(retrieval._local_tokens(t or "")) & set(ts):
                df, tf = sum(w in x for x in toks.values()), ts.count(w)
                s[at] = s.get(at, 0) + math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        best = sorted(((round(x, 6), *at) for at, x in s.items()), reverse=True)[:8]
        want |= {(q, d, c, x, i + 1) for i, (x, d, c) in enumerate(best)}
    assert {tuple(r) for r in got.select("query_id", "doc_id", "chunk", "score", "rank").collect()} == want
    assert {r[1] for r in want if r[0] == 60} == {30, 31}
    chapters = retrieval.chunks(spark.createDataFrame(chapters, "doc_id long, k string, text string"))
    cut = retrieval.bm25(chapters, spark.createDataFrame([p[::2] for p in plans], "query_id long, query string"), tokens_per_task=900, queries_per_task=2, at_once=3)
    assert {tuple(r) for r in cut.select("query_id", "doc_id", "chunk", "score", "rank").collect()} == want


def test_edit_guard_and_locks(docs, rows):
    long = "# 题\n" + "\n".join(["“说话。”" + "字" * 60] * 8)
    got = rows(checks.edit_guard(docs(long, "x" * 100, long), docs("太短", "x" * 100, long)))
    assert got == [(0, "dialogue_lost"), (0, "paragraphs_lost"), (0, "text_lost"), (0, "title_lost"), (0, "under_80")]
    locked = docs("a", "b", "c").selectExpr("doc_id", "sha2(text, 256) as sha")
    assert rows(checks.tampered(locked, docs("a", "B"))) == [(1, "final_tampered"), (2, "final_text_missing")]


def test_functions(docs):
    d = docs("甲 - 乙丙-丁戊")
    assert one(d, text.dna(d["text"]).alias("d"))[0] == ["乙丙", "丁戊"]
    x = docs("- **章节类型**：推进 \n冲突值: 4")
    assert one(x, text.plan_field(x["text"], "章节类型").alias("a"), text.plan_field(x["text"], "冲突值").alias("b"), text.plan_field(x["text"], "无").alias("c")) == ("推进", "4", None)
    y = docs("a　b c\x1c d\n")
    assert one(y, text.count_words(y["text"]).alias("n"), text.lines(y["text"]).alias("l")) == (4, ["a　b c", "", "d"])
    z = docs("Ab1 甲乙丙")
    assert one(z, text.tokens(z["text"]).alias("t"))[0] == ["ab1", "甲", "乙", "丙", "甲乙", "乙丙"]


def test_files(spark, rows, tmp_path):
    ch = tmp_path / "chapters"
    ch.mkdir()
    (ch / "001.md").write_text("# 一 <开>\n\n甲 & 乙\n\n丙", encoding="utf-8")
    (ch / "003.md").write_text("无题", encoding="utf-8")
    (ch / "notes.md").write_text("x")
    c = files.chapters(spark, str(ch))
    assert rows(c, "n") == [(1,), (3,)] and rows(files.bad_names(spark, str(ch))) == [("notes.md",)]
    assert rows(sinks.missing(c, 1, 3)) == [(2,)]
    log = tmp_path / "t.jsonl"
    log.write_text('{"chapter": 1, "event": "e"}\nbroken\n{"chapter": 2}\n')
    assert rows(files.json_lines(spark, str(log)), "chapter") == [(1,), (2,)]
    led = tmp_path / "c.json"
    led.write_text(json.dumps({"characters": [{"id": "C-1", "name": "n", "state": {"hp": 3, "loc": "x"}}]}))
    assert rows(files.json_file(spark, str(led), files.CHARACTERS, "characters"), "id", "name") == [("C-1", "n")]
    assert files.json_file(spark, str(tmp_path / "none.json"), files.CHARACTERS).count() == 0
    sinks.export_txt(c, str(tmp_path / "b.md"), "书", markdown=True)
    assert "## 一 <开>\n\n甲 & 乙" in (tmp_path / "b.md").read_text(encoding="utf-8")
    sinks.export_epub(c, str(tmp_path / "b.epub"), "书")
    with zipfile.ZipFile(tmp_path / "b.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "甲 &amp; 乙</p><p>丙" in z.read("OEBPS/c001.xhtml").decode()


def test_events_are_replaced_by_chapter(spark, rows, tmp_path):
    p = str(tmp_path / "events")
    e = lambda *r: spark.createDataFrame(list(r), "v string, book string, chapter int")
    sinks.write_events(e(("a", "B", 1), ("b", "B", 2)), p)
    for _ in range(2):
        sinks.write_events(e(("c", "B", 2)), p)
    assert rows(spark.read.parquet(p), "chapter", "v") == [(1, "a"), (2, "c")]
    ok = spark.createDataFrame([], "severity string, code string")
    bad = spark.createDataFrame([("E", "x")], "severity string, code string")
    assert sinks.apply_chapters(e(("z", "B", 1)), bad, p) and rows(spark.read.parquet(p), "chapter", "v") == [(1, "a"), (2, "c")]
    assert sinks.apply_chapters(e(("z", "B", 1)), ok, p) == []
    sinks.drop_chapter(spark.read.parquet(p), p, "B", 2)
    assert rows(spark.read.parquet(p), "chapter", "v") == [(1, "z")]
    with pytest.raises(ValueError, match="unknown"):
        sinks.append_decisions(spark.createDataFrame([("no",)], "type string"), str(tmp_path / "d"))


def test_streams(spark, rows, tmp_path):
    from scrollwork.streaming import timeline

    src = str(tmp_path / "in")
    df = spark.sql("select * from values (1, timestamp_ntz '2024-01-01 00:10:00', 'B', 1, 2.0, 'x'), (2, timestamp_ntz '2024-01-01 00:50:00', 'B', 2, 3.0, 'x') as t(id, ts, book, chapter, value, event_type)")
    df.write.parquet(src)
    s = timeline.read(spark, src, df.schema)
    timeline.apply(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "chapter") == [(1,), (2,)]
    q = timeline.windowed(s).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("w"), "n", "total") == [(2, 5.0)]


def test_lists_and_arcs(docs, rows, spark):
    d = docs("# 甲\n- 不算\n## 禁用清单\n- 一丝 [R001]\n- regex:总之[,，]\n* 不算\n## 乙\n- 不算")
    assert rows(files.ban_list(d), "pattern", "regex") == [("一丝", False), ("总之[,，]", True)]
    assert rows(files.plan_cast(docs("出场角色: 甲（重伤）、乙，丙")), "name") == [("丙",), ("乙",), ("甲",)]
    a = files.arcs(docs("第 1-10 章", "起止章: 11-30", "无"))
    assert rows(a) == [(0, 1, 10), (1, 11, 30)]
    assert one(files.arc_of(a, 12), "doc_id") == (1,) and one(files.arc_of(a, 99), "doc_id") == (1,)


def test_related_chapters_of_four_kinds(spark, rows):
    at = "timestamp'2024-01-01'"
    setup = {1: "灯灭了 -> 后承", 2: "门开着，没人守在那里等他回来 -> 后承", 20: "新线 -> 后承"}
    takes = {5: "第2章:门开着，没人守在那里等他", 6: "->无"}
    made = [(i, i, setup.get(i), takes.get(i), "他丢了铜钥匙。" if i in (3, 4, 25) else "无事。") for i in range(1, 30) if i != 9]
    a = spark.createDataFrame(made, "analysis_id long, chapter int, s string, d string, p string").selectExpr("analysis_id", "'B' as book", "chapter", f"{at} as submitted_at", "array(s) as sets_up", "array(d) as depends_on", "array(p) as plot_points")
    th = spark.createDataFrame([("F-1", "旧灯", 7), ("F-2", "不提", 8), ("F-3", "无析", 9)], "id string, title string, planted_chapter int").selectExpr("'B' as book", "id", "title", "'' as fp", "'planted' as status", "1 as tier", "'' as scope", "false as cross_volume", "1 as min_payoff_spacing", "1 as planned_chapter", "planted_chapter", "99 as deadline_chapter", "1 as last_touched", f"{at} as created_at", "cast(null as timestamp) as deleted_at")
    ch = spark.createDataFrame([("C-1", "甲", ["老甲"], 10, '["铜钥匙"]'), ("C-2", "乙", None, 28, None), ("C-3", "丙", None, 11, None)], "id string, name string, aliases array<string>, last_chapter int, held string")
    ch = ch.selectExpr("'B' as book", "id", "name", "aliases", "'major' as role", "map('possessions', held) as state", "cast(null as string) as relationships", "1 as first_chapter", "last_chapter", f"{at} as created_at", f"{at} as updated_at", "cast(null as timestamp) as deleted_at")
    books = spark.sql("select 'B' as book, 30 as current_chapter")
    plan = spark.sql("select 1L as doc_id, 'plan' as doc_kind, 'B' as book, 30 as chapter, '# 计划\\n出场角色: 老甲, 乙\\n旧灯复燃，F-3 与铜钥匙' as text")
    got = lookup.related(a, th, books, plan, ch)
    assert rows(got, "chapter", "reasons") == sorted([(10, "absent:C-1"), (7, "thread:F-1"), (4, "item:铜钥匙"), (1, "setup:" + setup[1])], key=repr)


def test_context_keeps_recent_summaries_and_condenses_far_ones(spark):
    at = "timestamp'2024-01-01'"
    none = "array(cast(null as struct<rule: string, name: string, value: string>)) as"
    a = spark.range(1, 301).selectExpr("id as analysis_id", "'B' as book", "cast(id as int) as chapter", f"{at} as submitted_at", "concat('题', id) as title", "concat(id, repeat('叙', 400)) as summary", f"{none} world_facts", f"{none} facts")
    a = a.unionByName(a.where("chapter <= 21").withColumn("book", F.lit("S")))
    books = spark.sql("select 'B' as book, 301 as current_chapter union all select 'S', 22")
    th = spark.sql(f"select book, 'F-1' as id, '' as title, '' as fp, 'paid' as status, 1 as tier, '' as scope, false as cross_volume, 1 as min_payoff_spacing, 1 as planned_chapter, 1 as planted_chapter, 9 as deadline_chapter, 1 as last_touched, {at} as created_at, cast(null as timestamp) as deleted_at from values ('B') t(book)")
    ch = spark.sql(f"select 'B' as book, 'C-1' as id, '甲' as name, 'major' as role, map('a', 'b') as state, '' as relationships, 1 as first_chapter, 1 as last_chapter, {at} as updated_at, cast(null as timestamp) as deleted_at")
    got = lookup.context(a, ch, th, books).collect()
    pick = lambda b, s: [r["text"] for r in sorted((r for r in got if r["book"] == b and r["section"] == s), key=lambda r: r["ord"])]
    assert pick("B", "recent") == [f"{i}" + "叙" * 400 for i in (300, 299, 298)]
    sk = pick("B", "skeleton")
    assert [t[:9] for t in sk[:10]] == [f"第 {i} 章《题" for i in range(300, 200, -10)] and sk[0] == "第 300 章《题300》:300" + "叙" * 117 + "…"
    assert len(sk) == 14 and sk[10].startswith("第 151-200 章:160叙") and sk[13].endswith("(章号 10,20,30,40,50)") and sk[13].count("、") == 4
    assert pick("S", "skeleton") == ["第 20 章《题20》:20" + "叙" * 118 + "…", "第 10 章《题10》:10" + "叙" * 118 + "…"]


def test_folding(spark, rows):
    from pyspark.sql import functions as F

    s = spark.createDataFrame([("B", "cast", i, "x" * 900) for i in range(4)] + [("B", "other", 0, "y" * 9000)], "book string, section string, ord long, text string")
    assert rows(lookup.folded(s, lookup.CAPS, F.lit(1.0)), "section", "ord") == [("cast", 0), ("cast", 1), ("other", 0)]
    assert rows(lookup.folded(s, lookup.CAPS, F.lit(0.3)), "section", "ord") == [("cast", 0), ("other", 0)]
