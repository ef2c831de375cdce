"""Chunks of texts and their ranking by BM25."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import strip_ws, tokens
from scrollwork.session import checkpointed

_WORDS, _RUNS = re.compile("[A-Za-z0-9]+"), re.compile(f"[{packs.HAN}]+")


def chunks(docs: DataFrame, limit: int = 300) -> DataFrame:
    """(doc_id, chunk, body): paragraphs packed in order into chunks of about `limit` characters.

    A paragraph starts a new chunk if it would make the current one longer than `limit`; one that is longer by
    itself is a chunk of its own. Packing is a fold over the paragraphs of a row and shuffles nothing.
    """
    body = F.regexp_replace("text", "\\A[ \\t]*#[^\\n]*(?:\\n|\\z)", "")
    paras = F.filter(F.transform(F.split(body, "\\n\\s*\\n"), strip_ws), lambda p: p != "")
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(a, p):  # noqa: ANN001, ANN202
        full = (a["buf"] != "") & (F.length(a["buf"]) + F.length(p) > limit)
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"]).alias("done"), F.when(full | (a["buf"] == ""), p).otherwise(F.concat(a["buf"], F.lit("\n"), p)).alias("buf"))

    packed = F.aggregate(paras, init, step, lambda a: F.when(a["buf"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["buf"]))))
    return docs.where("text is not null").select("doc_id", F.posexplode(packed).alias("chunk", "body"))


def _local_tokens(s: str) -> list[str]:
    """`functions.text.tokens` of a Python string."""
    runs = _RUNS.findall(s)
    return [w.lower() for w in _WORDS.findall(s)] + [g for r in runs for g in r] + [r[i : i + 2] for r in runs for i in range(len(r) - 1)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, n) of the partition: the chunks each token is in; at null the chunks, at the empty token their tokens."""
    df: Counter[str] = Counter()
    n = size = 0
    for b in batches:
        for body in b.column(0).to_pylist():
            toks = _local_tokens(body)
            n, size = n + 1, size + len(toks)
            df.update(set(toks))
    yield pa.RecordBatch.from_arrays([pa.array([None, "", *df], pa.string()), pa.array([n, size, *df.values()], pa.int64())], names=["t", "n"])


def _score(parts: pd.DataFrame, queries: pd.DataFrame, avg: float, top: int, k1: float, b: float, at_once: int) -> Iterator[pd.DataFrame]:
    """Of each query the chunks among `parts` that can be in its `top`, scored unrounded.

    queries: (query_id, s, idf) with a query's text, or with a token in place of the text where idf isn't null.
    """
    known = queries["idf"].notna()
    tokens_, queries = queries[known], queries[~known]
    ids = {t: i for i, t in enumerate(tokens_["s"])}
    idf = tokens_["idf"].to_numpy(np.float64)
    asked = [sorted({ids[t] for t in _local_tokens(q) if t in ids}) for q in queries["s"]]
    parts = parts.sort_values(["doc_id", "chunk"])
    for lo in range(0, len(parts), at_once):
        some = parts.iloc[lo : lo + at_once]
        term, chunk, tf = [], [], []
        dl = np.zeros(len(some))
        for i, body in enumerate(some["body"]):
            toks = _local_tokens(body)
            dl[i] = len(toks)
            mine = Counter(ids[t] for t in toks if t in ids)
            term += mine.keys()
            tf += mine.values()
            chunk += [i] * len(mine)
        term, chunk, tf = np.array(term, np.int64), np.array(chunk, np.int64), np.array(tf, np.float64)
        order = np.argsort(term, kind="stable")
        chunk, tf = chunk[order], tf[order]
        ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(ids)))))
        part = idf[term[order]] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[chunk] / avg))
        where, what, scores = [], [], []
        for k, q in enumerate(asked):
            lists = [slice(ends[t], ends[t + 1]) for t in q]
            found = np.concatenate([chunk[x] for x in lists]) if lists else chunk[:0]
            if not len(found):
                continue
            s = np.bincount(found, np.concatenate([part[x] for x in lists]), len(some))
            # Scores equal once rounded are a tie, so those just below the last place stay.
            least = np.partition(s, -top)[-top] - 2e-6 if len(s) > top else 0.0
            hits = np.flatnonzero((s > 0) & (s >= least))
            where += [k] * len(hits)
            what.append(hits)
            scores.append(s[hits])
        if where:
            rows = some.iloc[np.concatenate(what)]
            yield pd.DataFrame({"query_id": queries["query_id"].to_numpy()[where], "doc_id": rows["doc_id"].to_numpy(), "chunk": rows["chunk"].to_numpy(), "score": np.concatenate(scores)})


def bm25(parts: DataFrame, queries: DataFrame, top: int = 8, k1: float = 1.5, b: float = 0.75, tokens_per_task: int = 16_000_000, queries_per_task: int = 20_000, at_once: int = 4_000) -> DataFrame:
    """The `top` chunks of every query: (query_id, doc_id, chunk, score, rank).

    parts: (doc_id, chunk, body); queries: (query_id, query). A query has no length limit, so its terms with
    the chunks that hold them would be most of the corpus for each query and are never rows: blocks of
    chunks meet blocks of queries, and only what can be among a query's `top` leaves a block. Ties go to
    the later chunk. Queries without a known term have no row.
    """
    spark = parts.sparkSession
    parts = parts.select("doc_id", "chunk", "body").where("body is not null")
    queries = queries.select("query_id", F.col("query").alias("s")).where("query is not null").distinct()
    counts = checkpointed(parts.select("body").mapInArrow(_frequencies, "t string, n long").groupBy("t").agg(F.sum("n").alias("df")))
    n, size = (counts.where(c).agg(F.coalesce(F.max("df"), F.lit(0))).first()[0] for c in ("t is null", "t = ''"))
    n_q = queries.count()
    q_blocks, c_blocks = max(1, -(-n_q // queries_per_task)), max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // tokens_per_task))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    block = F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")
    terms = queries.select(block.alias("qb"), F.explode(tokens(F.col("s"))).alias("t")).distinct().join(counts, "t")
    terms = terms.select("qb", F.lit(None).cast("string").alias("query_id"), F.col("t").alias("s"), idf.alias("idf"))
    asked = queries.select(block.alias("qb"), F.col("query_id").cast("string").alias("query_id"), "s", F.lit(None).cast("double").alias("idf")).unionByName(terms)
    avg = max(1.0, size / n) if n else 1.0
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = parts.withColumn("cb", F.pmod(F.xxhash64("doc_id"), F.lit(c_blocks)).cast("int")).withColumn("qb", all_of(q_blocks))
    right = asked.withColumn("cb", all_of(c_blocks))
    # A stated number of partitions: by their few bytes the blocks would be put together into one task.
    left, right = (y.repartition(q_blocks * c_blocks, "qb", "cb") for y in (left, right))
    types = {"query_id": "string"} | {c: parts.schema[c].dataType.simpleString() for c in ("doc_id", "chunk")}
    empty = {k: pd.Series(dtype=object) for k in (*types, "score")}

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        got = list(_score(mine, theirs, avg, top, k1, b, at_once)) if len(mine) and len(theirs) else []
        return pd.concat(got) if got else pd.DataFrame(empty)

    scored = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(run, ", ".join(f"{k} {v}" for k, v in types.items()) + ", score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"), F.desc("chunk")))
    scored = scored.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType)).withColumn("score", F.round("score", 6))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def snippets(parts: DataFrame, limit: int = 150) -> DataFrame:
    return parts.select("doc_id", "chunk", F.substring(strip_ws(F.regexp_replace("body", "\\s+", " ")), 1, limit).alias("snippet"))
