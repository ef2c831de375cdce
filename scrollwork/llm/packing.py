"""Filling packs of fixed capacity with documents.

Sizes are whole tokens, so an instance is a histogram with at most `capacity` entries, however
many documents there are. On it small sets that dominate every other choice for their largest
member are fixed first (Martello and Toth's reduction, many equal bins at a time); best fit in
order of decreasing size fills the rest. The plan names for each size which ranks go to which
packs; the documents, numbered within their size, are then joined with it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrollwork.llm import bpe
from scrollwork.session import checkpointed

#: A bin class: how many bins, and how many items of each size every one of them holds.
BinClass = tuple[int, tuple[tuple[int, int], ...]]


def dominant_sets(counts: np.ndarray, capacity: int) -> list[BinClass]:
    """Fix sets {j}, {j, k}, {j, k, b} that dominate all feasible sets with j; `counts` (by size) is reduced in place.

    Let k be the largest that fits beside j. {j, k} dominates if it fills the bin, if no two others
    fit beside j, or if at most two do and no such pair sums to more than k: whatever j is packed
    with elsewhere can then change places with k. If at most two fit, let b be the largest that fits beside j and k: {j, k, b}
    dominates if every other pair either has its smaller part at most b or goes into k's place as a whole.
    """
    out: list[BinClass] = []
    size = capacity
    while size > 0:
        n = int(counts[size])
        if n == 0:
            size = int(np.flatnonzero(counts[:size])[-1]) if counts[1:size].any() else 0
            continue
        room = capacity - size
        own = 1 if room >= size else 0  # another j may be the partner
        beside = counts[: room + 1].copy()
        if own:
            beside[size] -= 1
        have = np.flatnonzero(beside[1:]) + 1
        if not len(have):
            out.append((n if not own else 1, ((size, 1),)))
            counts[size] -= out[-1][0]
            continue
        k = int(have[-1])
        fixed, trio = k == room, 0
        if not fixed:
            least = int(have[0])
            two = 2 * least if beside[least] > 1 else (least + int(have[1]) if len(have) > 1 else capacity + 1)
            if two > room:
                fixed = True
            else:
                three = int(np.repeat(have[:3], np.minimum(beside[have[:3]], 3))[:3].sum()) if beside[have].sum() >= 3 else capacity + 1
                if three > room:
                    at = np.searchsorted(have, room - have, side="right") - 1
                    same = (at >= 0) & (have[at] == have) & (beside[have] < 2)
                    at = np.where(same, at - 1, at)
                    sums = np.where(at >= 0, have + have[at], 0)
                    fixed = bool(sums.max() <= k)
                    fits = have[(have <= room - k) & ((have != k) | (beside[k] > 1))]
                    if not fixed and len(fits):
                        b = int(fits[-1])
                        if not ((have > b) & (at >= 0) & (have[at] >= have) & (sums > k)).any():
                            fixed, trio = True, b
        if not fixed:
            size = int(np.flatnonzero(counts[:size])[-1]) if counts[1:size].any() else 0
            continue
        if trio:
            what = Counter((size, k, trio))
            m = min(int(counts[x]) // q for x, q in what.items())
            out.append((m, tuple(what.items())))
            for x, q in what.items():
                counts[x] -= m * q
        elif k == size:
            out.append((n // 2, ((size, 2),)))
            counts[size] -= 2 * (n // 2)
        else:
            m = min(n, int(counts[k]))
            out.append((m, ((size, 1), (k, 1))))
            counts[size] -= m
            counts[k] -= m
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[BinClass]:
    """Best fit by decreasing size, all bins with the same contents at a time."""
    open_: list[tuple[int, int, int]] = []  # (residual, serial, bins), by residual
    inside: dict[int, tuple[tuple[int, int], ...]] = {}
    serial = 0
    done: list[BinClass] = []

    def put(residual: int, bins: int, what: tuple[tuple[int, int], ...], least: int) -> None:
        nonlocal serial
        if bins and residual < least:
            done.append((bins, what))
        elif bins:
            serial += 1
            inside[serial] = what
            insort(open_, (residual, serial, bins))

    sizes = np.flatnonzero(counts[1:]) + 1
    least = int(sizes[0]) if len(sizes) else 0
    for s in sizes[::-1].tolist():
        n = int(counts[s])
        while n:
            at = bisect_left(open_, (s, 0, 0))
            if at < len(open_):
                residual, key, bins = open_.pop(at)
                what = inside.pop(key)
            else:
                residual, what = capacity, ()
                bins = -(-n // (capacity // s))
            q = residual // s
            full = min(bins, n // q)
            rest = min(n - full * q, q - 1) if full < bins else 0
            put(residual - q * s, full, (*what, (s, q)), least)
            if rest:
                put(residual - rest * s, 1, (*what, (s, rest)), least)
            left = bins - full - (1 if rest else 0)
            if left:
                put(residual, left, what, least)
            n -= full * q + rest
    return done + [(b, inside[k]) for _, k, b in open_]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, first rank, end rank, first pack, items of that size in a pack); ranks and packs count from 0."""
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        counts[s] = n
    bins = dominant_sets(counts, capacity) + best_fit(counts, capacity)
    rank: dict[int, int] = {}
    out, pack = [], 0
    for n, what in bins:
        for s, q in what:
            r = rank.get(s, 0)
            out.append((s, r, r + n * q, pack, q))
            rank[s] = r + n * q
        pack += n
    return out


def ranked(items: DataFrame, parts: DataFrame, by: str, key: str) -> DataFrame:
    """`items` with `rank`, from 0 within each value of `by`; parts (_by, parts) tells in how many parts a value is numbered."""
    x = items.join(F.broadcast(parts), F.col(by) == F.col("_by")).withColumn("_part", F.pmod(F.xxhash64(key), F.col("parts"))).drop("_by", "parts")
    n = x.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(F.col(by).alias("_by"), F.col("_part").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_part").orderBy(key)) - 1)
    return x.join(n, (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_s"))).withColumn("rank", F.col("_r") + F.col("_start")).drop("_by", "_s", "_part", "_r", "_start")


def packed(sizes: DataFrame, capacity: int, per_part: int = 20_000) -> DataFrame:
    """Rows (doc_id, part, n_tokens, pack_id) of sizes (doc_id, n_tokens).

    The plan has at most a row for every pair of sizes that share a pack, and the number of parts a row for every size, both
    bounded by the capacity, whatever the corpus. A size that most items have is numbered in parts of about `per_part`.

    A text longer than the capacity is cut into full parts and one rest; every other text stays whole
    as part 1. Texts without tokens take no room and go to pack 0. Ties and repeated sizes are
    numbered by doc_id within their size; an empty table gives no rows.
    """
    spark: SparkSession = sizes.sparkSession
    c = F.lit(capacity)
    parts = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / c)).cast("int"))).alias("part"))
    items = parts.select("doc_id", "part", F.least(c, F.col("n_tokens") - (F.col("part") - 1) * c).cast("int").alias("n_tokens"))
    items = items.withColumn("_key", F.concat_ws("/", "doc_id", "part"))
    counted = {r[0]: r[1] for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    schema = T.StructType([T.StructField("size", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("r0", "r1", "pack", "q"))])
    rows = spark.createDataFrame(plan(counted, capacity), schema)
    parts = spark.createDataFrame([(s, 1 + n // per_part) for s, n in counted.items()], "_by int, parts long")
    x = ranked(items.where("n_tokens > 0"), parts, "n_tokens", "_key")
    x = x.join(rows, (F.col("n_tokens") == F.col("size")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    x = x.select("doc_id", "part", "n_tokens", (F.col("pack") + F.floor((F.col("rank") - F.col("r0")) / F.col("q"))).cast("bigint").alias("pack_id"))
    none = items.where("n_tokens = 0").select("doc_id", "part", "n_tokens", F.lit(0).cast("bigint").alias("pack_id"))
    return x.unionByName(none)


def packs(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows (pack_kind, pack_id, doc_id, part, n_tokens): the documents in packs of every kind of `budgets`.

    Repeated rows of a document count once.
    """
    kinds = [tuple(r) for r in budgets.select("pack_kind", "tokenizer", "capacity").distinct().orderBy("pack_kind").collect()]  # a fixed table of a few rows
    measured = {t: checkpointed(bpe.sizes(docs, path=bpe.default_vocabulary(t)).distinct()) for t in {k[1] for k in kinds}}
    out = None
    for kind, tokenizer, capacity in kinds:
        x = packed(measured[tokenizer], capacity).select(F.lit(kind).alias("pack_kind"), "pack_id", "doc_id", "part", "n_tokens")
        out = x if out is None else out.unionByName(x)
    return out
