"""All pairs of set-valued records that overlap above a Jaccard threshold.

Prefix-filtered join: tokens are ordered by rarity, only the prefix that a threshold makes
necessary is indexed, lengths and positions are filtered, and the exact overlap is verified.
Records with equal sets form one class and meet the index once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rarity is counted in this many hash buckets, so the table that is broadcast has a fixed size (1 MB).
BUCKETS = 1 << 16


def pieces(c: Column, separators: str, least: int) -> Column:
    """The distinct pieces of `c` between any of `separators` (a character class), at least `least` long."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, f"[{separators}]"), lambda x: F.length(x) >= least)))


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, members) of records (id BIGINT, vals ARRAY<STRING>, sorted and distinct).

    sets: (sid, vals), one per different non-empty set, sid being its least id; members: (sid, id).
    """
    r = records.where("id is not null and size(vals) > 0").select("id", "vals", F.xxhash64("vals").alias("_h"))
    sets = r.groupBy("_h", "vals").agg(F.min("id").alias("sid"))
    return sets.select("sid", "vals"), r.select("_h", "vals", "id").distinct()


def _ranked(sets: DataFrame, df: DataFrame) -> DataFrame:
    """(sid, n, toks): each set's size and tokens as structs (df, t), rarest first. df is the count of the token's bucket."""
    t = sets.select("sid", F.size("vals").alias("n"), F.explode("vals").alias("t")).withColumn("_b", F.pmod(F.xxhash64("t"), F.lit(BUCKETS)))
    return t.join(F.broadcast(df), "_b").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("toks"))


def similar_sets(sets: DataFrame, num: int, den: int, rows_per_task: int = 20_000, other: DataFrame | None = None) -> DataFrame:
    """Pairs (sid_a, sid_b) of sets (sid, vals) with den * |common| >= num * |either|.

    Within one table a < b; with `other` sid_a is of `sets` and sid_b of `other`, equal sets included. Only ids, sizes,
    places and prefix tokens go through the join; the different candidates then meet their sets.
    A token in very many prefixes is split: its left rows are spread over as many tasks as the
    bucket count asks for and its right rows go to each of them. No pair is left out.
    """
    tokens = (sets if other is None else sets.select("vals").unionByName(other.select("vals"))).select(F.explode("vals").alias("t"))
    df = tokens.groupBy(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).alias("_b")).agg(F.count(F.lit(1)).alias("df"))

    def prefixes(s: DataFrame) -> DataFrame:
        p = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)).cast("int") + 1
        x = _ranked(s, df).select("sid", "n", F.posexplode(F.slice("toks", F.lit(1), p)).alias("pos", "k"))
        return x.select("sid", "n", "pos", F.col("k.t").alias("t"), (1 + F.floor(F.col("k.df") / F.lit(rows_per_task))).cast("int").alias("copies"))

    a = prefixes(sets)
    b = a if other is None else prefixes(other)
    a = a.withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("copies")).cast("int")).alias("a")
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).alias("b")
    la, lb = F.col("a.n"), F.col("b.n")
    # den * c >= num * (la + lb - c)  <=>  c * (den + num) >= num * (la + lb)
    need = F.lit(num) * (la + lb)
    on = (
        (F.col("a.t") == F.col("b.t"))
        & (F.col("a.salt") == F.col("b.salt"))
        & (F.least(la, lb) * F.lit(den) >= F.greatest(la, lb) * F.lit(num))
        & (F.least(la - F.col("a.pos"), lb - F.col("b.pos")) * F.lit(den + num) >= need)
    )
    if other is None:
        on = on & (F.col("a.sid") < F.col("b.sid"))
    found = a.join(b, on).select(F.col("a.sid").alias("sid_a"), F.col("b.sid").alias("sid_b")).distinct()
    va = sets.select(F.col("sid").alias("sid_a"), F.col("vals").alias("va"))
    vb = (sets if other is None else other).select(F.col("sid").alias("sid_b"), F.col("vals").alias("vb"))
    met = found.join(va, "sid_a").join(vb, "sid_b")
    return met.where(F.size(F.array_intersect("va", "vb")) * F.lit(den + num) >= F.lit(num) * (F.size("va") + F.size("vb"))).select("sid_a", "sid_b")


def _parted(members: DataFrame, per_part: int) -> tuple[DataFrame, DataFrame]:
    """(members with `part`, the classes of several parts with their number): each part holds about `per_part` members."""
    big = members.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_part).select("sid", F.ceil(F.col("n") / F.lit(per_part)).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0))
    return members.join(big, "sid", "left").select("sid", "id", part.alias("part")), big


def _expanded(found: DataFrame, left: DataFrame, right: DataFrame | None, per_part: int) -> DataFrame:
    """(id_a, id_b) of the members of the class pairs (sid_a, sid_b): every part of one class with every part of the other, each
    such meeting a key of its own, so that no task holds more than the product of two parts at once."""
    ma, na = _parted(left, per_part)
    mb, nb = (ma, na) if right is None else _parted(right, per_part)
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
    t = found.join(na.select(F.col("sid").alias("sid_a"), F.col("parts").alias("pa")), "sid_a", "left").join(nb.select(F.col("sid").alias("sid_b"), F.col("parts").alias("pb")), "sid_b", "left")
    t = t.select("sid_a", "sid_b", "pb", numbers("pa").alias("i")).select("sid_a", "sid_b", "i", numbers("pb").alias("j"))
    if right is None:
        t = t.where("sid_a <> sid_b or i <= j")
    on = ["sid_a", "sid_b", "i", "j"]
    x = t.join(ma.select(F.col("sid").alias("sid_a"), F.col("part").alias("i"), F.col("id").alias("x")), ["sid_a", "i"])
    y = t.join(mb.select(F.col("sid").alias("sid_b"), F.col("part").alias("j"), F.col("id").alias("y")), ["sid_b", "j"])
    both = x.select(*on, "x").join(y.select(*on, "y"), on)
    if right is not None:
        return both.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return both.where("sid_a <> sid_b or i < j or x < y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_classes(records: DataFrame, num: int = 3, den: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members (sid, id), pairs (sid_a < sid_b) of similar classes): the result without writing out the pairs within
    classes. Records with equal sets are one class, named by its least id."""
    from scrollwork.session import checkpointed

    sets, rows = classes(records)
    sets = checkpointed(sets)
    key = sets.select("sid", "vals", F.xxhash64("vals").alias("_h"))
    members = checkpointed(rows.join(key, ["_h", "vals"]).select("sid", "id"))
    return members, similar_sets(sets, num, den)


def similar_links(records: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """One row per record with a set: (id, sid, n_links), its class and how many other records are similar to it."""
    from scrollwork.session import checkpointed

    members, near = similar_classes(records, num, den)
    near = checkpointed(near)
    size = members.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    ways = near.unionByName(near.select(F.col("sid_b").alias("sid_a"), F.col("sid_a").alias("sid_b")))
    beside = ways.join(size.withColumnRenamed("sid", "sid_b"), "sid_b").groupBy(F.col("sid_a").alias("sid")).agg(F.sum("n").alias("m"))
    n = size.join(beside, "sid", "left").select("sid", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).cast("bigint").alias("n_links"))
    return members.join(n, "sid").select("id", "sid", "n_links")


def similar_records(records: DataFrame, num: int = 3, den: int = 5, other: DataFrame | None = None, per_part: int = 1_000) -> DataFrame:
    """Pairs (id_a, id_b) of records (id, vals) with den * |common| >= num * |either|.

    Within one table id_a < id_b; with `other` the pairs are of a record of `records` and one of `other`, whose ids
    may be the same. Null and empty sets have no pairs; repeated records count once; an empty table gives no rows.
    """
    from scrollwork.session import checkpointed

    if other is None:
        members, near = similar_classes(records, num, den)
        # Only classes of more than one member meet themselves.
        own = members.where("id <> sid").select(F.col("sid").alias("sid_a"), F.col("sid").alias("sid_b")).distinct()
        return _expanded(checkpointed(near.unionByName(own)), members, None, per_part)
    found = []
    for r in (records, other):
        sets, rows = classes(r)
        sets = checkpointed(sets)
        found.append((sets, checkpointed(rows.join(sets.select("sid", "vals", F.xxhash64("vals").alias("_h")), ["_h", "vals"]).select("sid", "id"))))
    near = similar_sets(found[0][0], num, den, other=found[1][0])
    return _expanded(checkpointed(near), found[0][1], found[1][1], per_part)
