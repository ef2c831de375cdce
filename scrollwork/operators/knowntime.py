"""Attributes as known at event time.

Of each entity a persistent search tree over valid time is kept, one root per known time; an
insertion copies the path from the root to its leaf. An event picks the newest root that was
known at its time and searches it for the greatest valid time below its own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PersistentTree:
    """Versions of a search tree over the sorted valid times `keys`; node = (left, right, payload)."""

    def __init__(self, keys: list[int]):
        self.keys = keys
        self.size = 1
        while self.size < len(keys):
            self.size *= 2
        self.left, self.right, self.payload = [0], [0], [None]
        self.times: list[int] = []
        self.roots: list[int] = []

    def insert(self, known: int, key: int, payload: int) -> None:
        """Insertions come in order of known time; a later one for the same key replaces the earlier."""
        at, lo, width = bisect_left(self.keys, key), 0, self.size
        old = self.roots[-1] if self.roots else 0
        root = len(self.left)
        while True:
            new = len(self.left)
            self.left.append(self.left[old])
            self.right.append(self.right[old])
            self.payload.append(payload)
            if width == 1:
                break
            width //= 2
            if at < lo + width:
                self.left[new] = new + 1
                old = self.left[old]
            else:
                self.right[new] = new + 1
                old, lo = self.right[old], lo + width
        self.times.append(known)
        self.roots.append(root)

    def search(self, known: int, below: int) -> int | None:
        """The payload at the greatest key < below in the newest version not after `known`."""
        v = bisect_right(self.times, known) - 1
        end = bisect_left(self.keys, below)
        if v < 0 or end == 0:
            return None
        node, lo, width, best = self.roots[v], 0, self.size, 0
        if end >= self.size:
            best = node
        else:
            while node and width > 1:
                width //= 2
                if end <= lo + width:
                    node = self.left[node]
                    if end == lo + width:
                        best = node or best
                        break
                else:
                    best = self.left[node] or best
                    node, lo = self.right[node], lo + width
        while best and (self.left[best] or self.right[best]):
            best = self.right[best] or self.left[best]
        return self.payload[best] if best else None


_HIT = {"entity": object, "event_id": "int64", "payload": "int64", "valid": "int64", "known": "int64"}


def _search_shard(key: tuple, facts: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    if len(facts) and len(events):
        by: dict[str, list] = {}
        facts = facts.sort_values(["known", "payload"], kind="stable")
        for e, *row in zip(facts["entity"].tolist(), facts["known"].tolist(), facts["valid"].tolist(), facts["payload"].tolist()):
            by.setdefault(e, []).append(row)
        trees: dict[str, PersistentTree] = {}
        for e, i, k, v in zip(events["entity"].tolist(), events["event_id"].tolist(), events["known"].tolist(), events["valid"].tolist()):
            rows = by.get(e)
            if rows is None:
                continue
            t = trees.get(e)
            if t is None:
                t = trees[e] = PersistentTree(sorted({r[1] for r in rows}))
                for n, r in enumerate(rows):
                    t.insert(r[0], r[1], n)
            n = t.search(k, v)
            if n is not None:
                out.append((e, i, rows[n][2], rows[n][1], rows[n][0]))
    cols = zip(*out) if out else ([] for _ in _HIT)
    return pd.DataFrame({c: pd.Series(x, dtype=d) for (c, d), x in zip(_HIT.items(), cols)})


def _searched(facts: DataFrame, events: DataFrame, shards: int) -> DataFrame:
    """(entity, event_id, payload, valid, known) of what the shards' trees find; both sides have `shard`."""
    # A stated number of partitions: by their few bytes the shards would be put together into one task.
    f = facts.select("shard", "entity", "valid", "known", "payload").repartition(shards, "shard")
    e = events.select("shard", "entity", "event_id", "valid", "known").repartition(shards, "shard")
    return f.groupBy("shard").cogroup(e.groupBy("shard")).applyInPandas(_search_shard, "entity string, event_id long, payload long, valid long, known long")


def as_known(facts: DataFrame, events: DataFrame, rows_per_shard: int = 60_000, largest: int = 400_000) -> DataFrame:
    """For each event the payload of the entity's fact with the greatest valid time below the event's,
    among the facts known not after the event; of several at that valid time the one known last.

    facts: (entity STRING, valid INT, known BIGINT, payload BIGINT); events: (entity, event_id, valid, known),
    where (entity, event_id) names an event. Returns (entity, event_id, payload); events without such a fact
    have no row; rows with nulls in these columns take no part.

    There are as many shards as give each about `rows_per_shard` rows, and entities share them. An entity
    with more than `largest` facts is cut, in order of valid and known time, into ranges of like size with
    a tree each. An event goes to the range just below its valid time and to the highest range under
    that which had a fact by then; which one that is, the same search over the ranges' earliest known times
    tells, so that no event goes to more than two. An entity with more events than `rows_per_shard` gets several
    shards, each with its trees. So no task holds an unbounded entity.
    """
    facts = facts.select("entity", "valid", "known", "payload").dropna()
    events = events.select("entity", "event_id", "valid", "known").dropna()
    n_f = facts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_f"), F.min("known").alias("k0"), F.max("known").alias("k1"))
    n_e = events.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    sized = n_f.join(n_e, "entity").withColumns({"copies": F.ceil(F.col("n_e") / F.lit(rows_per_shard)).cast("int"), "cuts": F.ceil(F.col("n_f") / F.lit(largest)).cast("int")})
    rows, copies, cuts = sized.agg(F.coalesce(F.sum(F.col("n_f") * F.col("copies") + F.col("n_e")), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0)), F.coalesce(F.max("cuts"), F.lit(0))).first()
    shards = max(2 * facts.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_shard))
    if copies <= 1 and cuts <= 1:
        shard = F.pmod(F.xxhash64("entity"), F.lit(shards))
        return _searched(facts.withColumn("shard", shard), events.withColumn("shard", shard), shards).select("entity", "event_id", "payload")

    special = sized.where("copies > 1 or cuts > 1").select("entity", "copies", "cuts", "k0", "k1")
    place = F.col("valid") + (F.col("known") - F.col("k0")) / (F.col("k1") - F.col("k0") + 1)
    ranges = [i / cuts for i in range(1, cuts)] or [0.5]
    bounds = facts.join(special.where("cuts > 1"), "entity").groupBy("entity").agg(F.array_distinct(F.percentile_approx(place, F.array(*map(F.lit, ranges)), F.lit(max(10_000, 20 * cuts)))).alias("bounds"))
    special = special.join(bounds, "entity", "left")
    f = facts.join(special, "entity", "left").withColumn("cut", F.coalesce(F.size(F.filter("bounds", lambda b: b <= place)), F.lit(0)))
    e = events.join(special, "entity", "left").withColumn("cut", F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("valid"))), F.lit(0)))
    if cuts > 1:
        firsts = f.where("cuts > 1").groupBy("entity", "cut").agg(F.min("known").alias("known")).select("entity", F.col("cut").alias("valid"), "known", F.col("cut").cast("bigint").alias("payload"))
        hot = e.where("cuts > 1")
        under = as_known(firsts, hot.select("entity", "event_id", F.col("cut").alias("valid"), "known"), rows_per_shard, largest).select("entity", "event_id", F.col("payload").cast("int").alias("cut"))
        e = e.unionByName(hot.drop("cut").join(under, ["entity", "event_id"]))
    part = F.pmod(F.xxhash64("event_id"), F.col("copies")).cast("int")
    f = f.withColumn("copy", F.explode(F.when(F.col("copies").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))))
    e = e.withColumn("copy", F.coalesce(part, F.lit(0)))
    # A cut or copied entity has shards of its own, named by the whole hash.
    shard = F.when(F.col("copies").isNull(), F.pmod(F.xxhash64("entity"), F.lit(shards))).otherwise(F.xxhash64("entity", F.col("cut").cast("long"), F.col("copy").cast("long")))
    hits = _searched(f.withColumn("shard", shard), e.withColumn("shard", shard), shards)
    return hits.groupBy("entity", "event_id").agg(F.max_by("payload", F.struct("valid", "known", "payload")).alias("payload"))


def mentions(analysis: DataFrame, characters: DataFrame, salts: int = 8) -> DataFrame:
    """Rows (analysis_id, book, chapter, submitted_at, character_id): mentions by a name or alias of exactly one id.

    A name that a third of all rows mention is spread over `salts` tasks.
    """
    names = characters.select("book", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).dropna()
    owner = names.groupBy("book", "name").agg(F.min("id").alias("character_id"), F.max("id").alias("_other")).where("character_id = _other").drop("_other")
    said = analysis.select("analysis_id", "book", "chapter", "submitted_at", F.explode(F.array_distinct("characters.name")).alias("name")).where("name is not null")
    said = said.withColumn("_salt", F.pmod(F.xxhash64("analysis_id"), F.lit(salts)))
    owner = owner.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return said.join(owner, ["book", "name", "_salt"]).select("analysis_id", "book", "chapter", "submitted_at", "character_id")


def snapshots_as_known(analysis: DataFrame, characters: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows (analysis_id, character_id, snapshot_id): the snapshot that held a mentioned character's state as
    known at submission. Null arrays, null times and null chapters give no row; repeated rows count once."""
    entity = F.concat_ws("\x01", "book", "character_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    facts = (
        snapshots.select("book", "chapter", "taken_at", "snapshot_id", F.explode(F.array_distinct("characters.id")).alias("character_id"))
        .where("character_id is not null and book is not null")
        .select(entity.alias("entity"), F.col("chapter").alias("valid"), micros("taken_at").alias("known"), F.col("snapshot_id").alias("payload"))
    )
    m = mentions(analysis, characters)
    events = m.select(entity.alias("entity"), F.col("analysis_id").alias("event_id"), F.col("chapter").alias("valid"), micros("submitted_at").alias("known"))
    hits = as_known(facts, events)
    return hits.select(F.col("event_id").alias("analysis_id"), F.substring_index("entity", "\x01", -1).alias("character_id"), F.col("payload").alias("snapshot_id")).distinct()
