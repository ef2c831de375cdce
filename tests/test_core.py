"""The general operators against small cases worked out by hand, and against brute force."""

import datetime as dt
import random

import pytest

from scrollwork.operators import history, knowntime, ledger, references, sequence

TS = dt.datetime
SNAP = "snapshot_id long, book string, chapter int, taken_at timestamp_ntz, characters array<struct<id:string,name:string,role:string,state:map<string,string>,last_chapter:int>>, until int, value string"
CHAR = "book string, id string, name string, aliases array<string>, role string, state map<string,string>, relationships array<struct<with_id:string,type:string,note:string,as_of_chapter:int>>, first_chapter int, last_chapter int, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, chapter int"
ANA = "analysis_id long, book string, chapter int, submitted_at timestamp_ntz, title string, location string, summary string, type string, conflict int, hook string, hook_dna string, plot_points array<string>, characters array<struct<name:string,role:string,updates:map<string,string>,note:string>>, relationships array<struct<a:string,b:string,type:string,note:string>>, organizations array<struct<name:string,members:array<struct<character:string,role:string,action:string>>>>, foreshadow_ops array<struct<id:string,action:string,note:string>>, facts array<struct<name:string,value:string>>, gains array<string>, costs array<string>"
ORG = "book string, id string, members array<struct<character_id:string,role:string,since_chapter:int>>, updated_at timestamp_ntz"
FORE = "book string, id string, title string, created_at timestamp_ntz, deleted_at timestamp_ntz"


def day(n):
    return TS(2024, 1, 1) + dt.timedelta(days=n)


def snap(i, ch, at, chars, book="B"):
    return (i, book, ch, day(at), None if chars is None else [(c, c, None, s, ch) for c, s in chars], 7, "x")


def char(i, name, upd, state=None, last=None, aliases=None, rel=None, book="B", created=0, deleted=None):
    return (book, i, name, aliases, None, state, rel, 1, last, day(created), day(upd), None if deleted is None else day(deleted), 99)


def ana(spark, *items):
    names = [x.split(" ")[0] for x in ANA.split(", ")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in items], ANA)


def test_next_in_group_over_block_edges(spark, rows):
    data = [("a", i) for i in (1, 2, 255, 256, 900)] + [(None, 3), (None, 4)]
    got = rows(sequence.next_in_group(spark.createDataFrame(data, "k string, t int"), ["k"], "t", "nx"))
    assert got == sorted([("a", 1, 2), ("a", 2, 255), ("a", 255, 256), ("a", 256, 900), ("a", 900, None), (None, 3, 4), (None, 4, None)], key=repr)


@pytest.mark.parametrize("block", [2, 256])
def test_coalesce_intervals_against_brute_force(spark, rows, block):
    rnd = random.Random(3)
    data, want = [], []
    for k in range(6):
        at, cur = 0, None
        for _ in range(30):
            start, end, v = at, at + rnd.randint(1, 3), rnd.choice("ab")
            data.append((k, v, start, end))
            if cur and cur[3] == start and cur[1] == v:
                cur = (k, v, cur[2], end)
                want[-1] = cur
            else:
                cur = (k, v, start, end)
                want.append(cur)
            at = end + (rnd.random() < 0.2)
    df = spark.createDataFrame(data, "k int, v string, s int, e int")
    assert rows(sequence.coalesce_intervals(df, ["k"], "v", "s", "e", block), "k", "v", "s", "e") == sorted(want, key=repr)


def test_versions(spark, rows):
    s = [
        snap(1, 1, 1, [("C-1", {"loc": "x", "hp": "1"}), ("C-2", {"loc": "q"})]),
        snap(2, 1, 2, [("C-1", {"loc": "y", "hp": None})]),  # taken again: counts alone
        snap(3, 3, 3, [("C-1", {"loc": "y"})]),
        snap(4, 5, 4, []), snap(5, 6, 5, None),
        snap(6, 7, 6, [("C-1", {"loc": "z", "hp": "1"})]), snap(6, 7, 6, [("C-1", {"loc": "z", "hp": "1"})]),
    ]
    c = [char("C-1", "n", 1, {"loc": "old"}, 99), char("C-1", "n", 2, {"loc": "z"}, 9), char("C-9", "m", 1, {"loc": "k"}, 4), char("C-8", "m", 1, None, 4), char("C-7", "m", 1, {"loc": "k"}, None)]
    v = history.versions(spark.createDataFrame(s, SNAP), spark.createDataFrame(c, CHAR))
    assert rows(v, "character_id", "state_key", "value", "from_chapter", "to_chapter") == sorted([("C-1", "loc", "y", 1, 7), ("C-1", "loc", "z", 7, 0), ("C-1", "hp", "1", 7, 9), ("C-9", "loc", "k", 4, 0)], key=repr)
    both = history.combined(v, ["book", "character_id"])
    assert rows(both.where("character_id = 'C-1'"), "from_chapter", "to_chapter", "state") == sorted([(1, 7, '{"loc":"y"}'), (7, 9, '{"hp":"1","loc":"z"}'), (9, 0, '{"loc":"z"}')], key=repr)


def test_versions_of_empty_tables(spark):
    assert history.versions(spark.createDataFrame([], SNAP), spark.createDataFrame([], CHAR)).count() == 0


def test_references(spark, rows):
    a = ana(spark, *[{"analysis_id": i, "book": "B", "chapter": i, "submitted_at": at, "foreshadow_ops": ops} for i, at, ops in (
        (1, day(5), [(" f-1 ", None, None), (None, None, None), ("　", None, None), ("F-9", None, None)]), (2, day(1), [("F-1", None, None)]), (3, None, [("F-9", None, None)]), (4, day(40), [("F-1", None, None)]), (5, day(5), None))])
    f = spark.createDataFrame([("B", "F-1", "t", day(3), day(30)), ("C", "F-9", "t", day(0), None)], FORE)
    c = spark.createDataFrame([char("C-1", "n", 9, rel=[("C-2", None, None, 1), ("c-1\xa0", None, None, 1)])], CHAR)
    o = spark.createDataFrame([("B", "O-1", [("C-1", None, 1), ("", None, 1), ("C-5", None, 1)], day(3)), ("B", "O-1", [("C-5", None, 1)], day(3))], ORG)
    assert rows(references.found(a, c, o, f)) == sorted([
        ("analysis", "B", "1", "F-9", "missing", "2024-01"), ("analysis", "B", "2", "F-1", "late", "2024-01"), ("analysis", "B", "3", "F-9", "missing", None),
        ("analysis", "B", "4", "F-1", "deleted", "2024-02"), ("characters", "B", "C-1", "C-2", "missing", "2024-01"), ("organizations", "B", "O-1", "C-5", "missing", "2024-01")], key=repr)
    assert references.found(ana(spark), spark.createDataFrame([], CHAR), spark.createDataFrame([], ORG), spark.createDataFrame([], FORE)).count() == 0


def test_persistent_tree_against_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        facts = sorted((rnd.randint(0, 9), rnd.randint(1, 9), i) for i in range(rnd.randint(1, 20)))
        t = knowntime.PersistentTree(sorted({x[1] for x in facts}))
        for x in facts:
            t.insert(*x)
        for _ in range(10):
            known, below = rnd.randint(-1, 10), rnd.randint(0, 11)
            fit = [(v, k, p) for k, v, p in facts if k <= known and v < below]
            assert t.search(known, below) == (max(fit)[2] if fit else None)


@pytest.mark.parametrize("shard,largest", [(60_000, 400_000), (7, 5)])
def test_as_known_with_hot_entities(spark, rows, shard, largest):
    rnd = random.Random(4)
    facts = [(rnd.choice("aaab"), rnd.randint(1, 30), rnd.randint(0, 50), i) for i in range(60)] + [(None, 1, 1, 1), ("a", None, 1, 99)]
    events = [(rnd.choice("aab"), i, rnd.randint(0, 32), rnd.randint(0, 55)) for i in range(60)] + [("z", 999, 5, 5)]
    got = knowntime.as_known(spark.createDataFrame(facts, "entity string, valid int, known long, payload long"), spark.createDataFrame(events, "entity string, event_id long, valid int, known long"), shard, largest)
    want = []
    for e, i, v, k in events:
        fit = [(fv, fk, p) for fe, fv, fk, p in facts if fe == e and fv is not None and fv < v and fk <= k]
        if fit:
            want.append((e, i, max(fit)[2]))
    assert rows(got, "entity", "event_id", "payload") == sorted(want, key=repr)


def test_snapshots_as_known(spark, rows):
    c = spark.createDataFrame([char("C-1", "A", 1, aliases=["boss", None]), char("C-2", "B", 1, aliases=["boss"]), char("C-1", "Old A", 0)], CHAR)
    s = spark.createDataFrame([snap(1, 1, 1, [("C-1", {})]), snap(2, 3, 3, [("C-1", None), ("C-2", {})]), snap(3, 3, 9, [("C-1", {})]), snap(4, 5, 4, None)], SNAP)
    a = ana(spark, *[{"analysis_id": i, "book": "B", "chapter": ch, "submitted_at": at, "characters": None if ns is None else [(n, None, None, None) for n in ns]} for i, ch, at, ns in (
        (10, 4, day(5), ["A", "Old A", "boss", None, "nobody"]), (11, 4, day(20), ["A", "B"]), (12, 3, day(2), ["A"]), (13, 1, day(9), ["A"]), (14, 4, None, ["A"]), (15, 4, day(5), None))])
    assert rows(knowntime.snapshots_as_known(a, c, s)) == [(10, "C-1", 2), (11, "C-1", 3), (11, "C-2", 2), (12, "C-1", 1)]


def test_ledger_replay_is_idempotent_and_ordered(spark, rows):
    c = spark.createDataFrame([char("C-1", "A", 1, {"loc": "z"}), char("C-2", "B", 1)], CHAR)
    one = {"analysis_id": 1, "book": "B", "chapter": 1, "submitted_at": day(1), "characters": [("A", None, {"loc": "x", "hp": "9"}, None)], "relationships": [("A", "B", "ally", "n")]}
    two = {"analysis_id": 2, "book": "B", "chapter": 2, "submitted_at": day(2), "characters": [("A", None, {"loc": "y"}, None), ("?", None, {"loc": "q"}, None)], "relationships": [("B", "A", None, "later")]}
    again = one | {"analysis_id": 3, "submitted_at": day(9), "characters": [("A", None, {"loc": "w", "hp": None}, None)]}
    want = [("C-1", "hp", None), ("C-1", "loc", "y")]
    for order in ((one, two, again), (again, two, one, one)):
        assert rows(ledger.replay(ana(spark, *order), c), "character_id", "state_key", "value") == want
    a = ana(spark, one, two)
    assert rows(ledger.replay(a, c, 1), "state_key", "value") == [("hp", "9"), ("loc", "x")]
    assert rows(ledger.drift(a, c), "state_key", "expected", "actual", "kind") == [("hp", "9", None, "only_replay"), ("loc", "y", "z", "differs")]
    assert rows(ledger.relations(a, c), "character_id", "with_id", "type", "note", "as_of_chapter") == [("C-1", "C-2", "ally", "later", 2), ("C-2", "C-1", "ally", "later", 2)]


def test_threads_and_costs(spark, rows):
    ops = lambda *x: [(i, a, None) for i, a in x]
    a = ana(spark, *[{"analysis_id": n, "book": "B", "chapter": n, "submitted_at": day(n), "foreshadow_ops": o, "gains": g, "costs": k} for n, o, g, k in (
        (1, ops((" f-1", "plant"), ("F-1", "advance"), ("F-2", "payoff"), (None, "plant")), ['{"type":"item","name":"sword","major":true}', "plain"], None),
        (3, ops(("F-1", "payoff"), ("F-3", "dance")), ['{"name":"ring","major":true}'], None),
        (8, ops(("F-1", "payoff")), None, ["blood"]))])
    assert rows(ledger.thread_status(a), "thread", "status", "planted_chapter", "last_touched") == [("F-1", "resolved", 1, 8), ("F-2", "resolved", None, 1), ("F-3", "planned", None, 3)]
    assert rows(ledger.thread_faults(a), "thread", "chapter", "code") == [("F-1", 8, "double_payoff"), ("F-2", 1, "beat_before_plant"), ("F-3", 3, "beat_bad_action")]
    assert rows(ledger.unpaid_gains(a), "chapter", "name") == [(1, "sword")]
    assert rows(ledger.gain_only_streaks(a)) == []


def test_streaks_need_neighbouring_chapters(spark, rows):
    def at(chapters, kind="过渡", conflict=5):
        return ana(spark, *[{"analysis_id": n, "book": "B", "chapter": n, "submitted_at": day(n), "type": kind, "conflict": conflict} for n in chapters])

    assert ledger.type_streaks(at((1, 3, 5))).count() == 0
    assert rows(ledger.type_streaks(at((1, 2, 3, 4))), "chapter") == [(1,)]
    assert ledger.conflict_runs(at((1, 2, 4))).count() == 0
    assert rows(ledger.conflict_runs(at((2, 3, 4))), "chapter", "code") == [(2, "conflict_fatigue")]
    assert rows(ledger.no_climax(at(range(1, 11))), "chapter") == [(10,)]
    assert ledger.no_climax(at(range(1, 10))).count() == 0
    assert rows(ledger.gaps(at((2, 5))), "from_chapter", "to_chapter") == [(3, 4)]


def test_as_known_of_empty_tables(spark):
    f = spark.createDataFrame([], "entity string, valid int, known long, payload long")
    e = spark.createDataFrame([], "entity string, event_id long, valid int, known long")
    assert knowntime.as_known(f, e).count() == 0
