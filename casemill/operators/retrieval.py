"""Batch retrieval: dense and lexical top-k, rank fusion, strength gate.

Every operator takes a set of queries. Queries are a stated set and travel in blocks of bounded
size; the corpus is scanned once a block and never crossed with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as T

K, CANDIDATES = 60, 50
QUERY_BLOCK = 4096
K1, B, EPSILON = 1.5, 0.75, 0.25
STRONG, MIXED, SUPPORT, MARGIN = 0.62, 0.45, 0.40, 0.04


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def dense_topk(
    corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES, exclude_self: bool = True, group: str | None = None, among: DataFrame | None = None
) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` by inner product of ``(id, vector)`` rows.

    Each Arrow batch is one matrix product with a block of queries and keeps its own best k, so
    only k rows a query and batch are shuffled. What is not to come back is left out before the
    best are taken, so k come back where there are k: the query itself, documents of its ``group``
    (a column of both; null is no group), and those whose id is not in ``among``.
    """
    spark, parts, block = corpus.sparkSession, [], []
    if among is not None:
        corpus = corpus.join(among.select("id").distinct(), "id", "left_semi")
    extra = [F.col(group).cast("string").alias("gid")] if group else []

    def search(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([q[0] for q in block]), np.array([q[1] for q in block], np.float64), [q[2] for q in block] if group else None))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix, gids = sent.value
            for pdf in frames:
                docs = pdf["id"].to_numpy()
                scores = np.stack(pdf["vector"].to_numpy()).astype(np.float64) @ matrix.T
                if exclude_self:
                    scores[docs[:, None] == ids[None, :]] = -np.inf
                if group:
                    number = {g: i for i, g in enumerate(set(gids) - {None})}
                    ours = np.array([number.get(g, -1) for g in pdf["gid"]])
                    theirs = np.array([-2 if g is None else number[g] for g in gids])
                    scores[ours[:, None] == theirs[None, :]] = -np.inf
                # ties at the edge: by doc_id, as in the final order
                order = np.lexsort((np.broadcast_to(docs[:, None], scores.shape), -np.round(scores, 6)), axis=0)[:k]
                q = np.broadcast_to(np.arange(len(ids)), order.shape)
                best = scores[order, q]
                keep = np.isfinite(best)
                yield pd.DataFrame({"query_id": ids[q][keep], "doc_id": docs[order][keep], "score": best[keep]})

        return corpus.select("id", "vector", *extra).mapInPandas(run, "query_id long, doc_id long, score double")

    for row in queries.select("id", "vector", *extra).toLocalIterator():
        block.append(tuple(row))
        if len(block) == QUERY_BLOCK:
            parts.append(search(block))
            block = []
    if block or not parts:
        parts.append(search(block) if block else corpus.select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(0.0).alias("score")).limit(0))
    hits = reduce(DataFrame.unionAll, parts).withColumn("score", F.round("score", 6))
    return _ranked(hits, k)


def postings(docs: DataFrame, technical: bool = True) -> DataFrame:
    """``(doc_id, term, tf, dl)`` of ``(id, text)`` rows."""
    tokens = docs.select(F.col("id").alias("doc_id"), T.lexical_tokens(F.col("text"), technical).alias("tokens"))
    spread = tokens.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return spread.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def write_postings(docs: DataFrame, path: str, technical: bool = True) -> None:
    """The lexical index as tables: postings in files by term, and the sizes of all documents, those without a term too."""
    postings(docs, technical).repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    lengths(docs, technical).write.mode("overwrite").parquet(f"{path}/lengths")


def read_postings(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def lengths(docs: DataFrame, technical: bool = True) -> DataFrame:
    return docs.select(F.col("id").alias("doc_id"), F.size(T.lexical_tokens(F.col("text"), technical)).alias("dl"))


def bm25_topk(
    docs: DataFrame | None, queries: DataFrame, k: int = CANDIDATES, technical: bool = True, index: tuple[DataFrame, DataFrame] | None = None, among: DataFrame | None = None
) -> DataFrame:
    """BM25 (Okapi) with the usual floor for frequent terms; repeated query words count again.

    Corpus statistics cover all documents; scores are summed over the postings of query terms only.
    ``index``: stored postings and lengths, instead of ``docs``. Documents whose id is not in
    ``among`` are left out before the best are taken.
    """
    index, sized = index or (postings(docs, technical), lengths(docs, technical))
    sizes = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = frequency.crossJoin(F.broadcast(sizes)).select("term", "avgdl", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    floored = idf.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))).drop("mean_idf")
    asked = queries.select(F.col("id").alias("query_id"), F.explode(T.lexical_tokens(F.col("text"), technical)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = asked.join(floored, "term").join(index, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score")).filter("score > 0")
    if among is not None:
        hits = hits.join(among.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return _ranked(hits, k)


def fused(dense: DataFrame, lexical: DataFrame, top_k: int = 10, k: int = K, boost: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion; ties go to the better dense rank, then the better lexical one.

    ``boost``: ``(query_id, doc_id, n_facets)``; a quarter of the best step for each shared facet.
    """
    both = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("lexical_rank")).unionAll(
        lexical.select("query_id", "doc_id", F.lit(None).cast("int"), F.col("rank"))
    )
    ranks = both.groupBy("query_id", "doc_id").agg(F.max("dense_rank").alias("dense_rank"), F.max("lexical_rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    score = part("dense_rank") + part("lexical_rank")
    if boost is not None:
        ranks = ranks.join(boost, ["query_id", "doc_id"], "left")
        score = score + F.coalesce(F.col("n_facets"), F.lit(0)) * 0.25 / (k + 1)
    order = [F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), F.col("doc_id")]
    out = ranks.withColumn("score", F.round(score, 8)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out.filter(F.col("rank") <= top_k).select("query_id", "doc_id", "dense_rank", "lexical_rank", "score", "rank")


def exclude_group(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """Hits without the query itself and without its template siblings; ``groups``: ``(id, gid)``."""
    own, theirs = groups.select(F.col("id").alias("query_id"), F.col("gid").alias("_q")), groups.select(F.col("id").alias("doc_id"), F.col("gid").alias("_d"))
    joined = hits.join(own, "query_id", "left").join(theirs, "doc_id", "left")
    return joined.filter((F.col("query_id") != F.col("doc_id")) & F.coalesce(F.col("_q") != F.col("_d"), F.lit(True))).drop("_q", "_d")


def attach(hits: DataFrame, cases: DataFrame, key: str = "doc_id") -> DataFrame:
    """Outcome fields of each hit, joined after ranking."""
    return hits.join(cases, key, "left")


def strength(dense: DataFrame, lexical: DataFrame | None = None, strong: float = STRONG, mixed: float = MIXED, support: float = SUPPORT, margin: float = MARGIN) -> DataFrame:
    """How far the evidence of each query carries: from raw cosines and rank agreement only."""
    top = dense.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"),
        F.min(F.when(F.col("rank") <= 3, F.col("score"))).alias("top3"),
        F.count_if(F.col("score") >= support).alias("n_support"),
        F.count_if(F.col("score") >= strong).alias("n_strong"),
    )
    if lexical is None:
        top = top.withColumn("agreement", F.lit(0).cast("long"))
    else:
        shared = dense.filter("rank <= 10").join(lexical.filter("rank <= 10").select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("agreement"))
        top = top.join(shared, "query_id", "left").withColumn("agreement", F.coalesce("agreement", F.lit(0)))
    gap = F.col("top1") - F.col("top3")
    apart, agree, several = gap >= margin, F.col("agreement") >= 1, F.col("n_strong") >= 3
    label = F.when((F.col("top1") >= strong) & (F.col("n_support") >= 2) & (apart | agree | several), "strong").when((F.col("top1") >= mixed) & (F.col("n_support") >= 1), "mixed").otherwise("weak")
    said = lambda when, what: F.when(when, F.lit(what))
    is_ = lambda name: F.col("strength") == name
    reasons = F.array_compact(
        F.array(
            said(is_("strong"), f"best cosine is {strong} or more"), said(is_("strong") & apart, "the best stands apart from the third"), said(is_("strong") & agree, "both rankings agree on a candidate"),
            said(is_("strong") & several, "several cases are strong"), said(is_("mixed"), f"best cosine is below {strong} or alone"), said(is_("mixed") & ~apart, "the best does not stand apart"),
            said(is_("mixed") & ~agree, "the rankings agree on no candidate"), said(is_("weak"), f"best cosine is below {mixed}, or no candidate has support"),
        )
    )
    out = top.withColumn("strength", label).withColumn("reasons", F.array_join(reasons, "; "))
    return out.select("query_id", F.round("top1", 4).alias("top1"), F.round(gap, 4).alias("margin"), "n_support", "agreement", "strength", "reasons")


MODES = ("hybrid", "dense", "lexical")


def search(dense: DataFrame | None, lexical: DataFrame | None, mode: str = "hybrid", top_k: int = 10, boost: DataFrame | None = None) -> DataFrame:
    """The fused ranking of a mode, with what it was made of: ``(query_id, doc_id, dense_rank, lexical_rank, score, rank, mode)``."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if (mode != "lexical" and dense is None) or (mode != "dense" and lexical is None):
        raise ValueError(f"{mode} needs a ranking that is not given")
    one = dense if mode == "dense" else lexical if mode == "lexical" else None
    ranked = fused(dense, lexical, top_k, boost=boost) if one is None else fused(*((one, one.limit(0)) if mode == "dense" else (one.limit(0), one)), top_k, boost=boost)
    return ranked.withColumn("mode", F.lit(mode))


def facets_shared(queries: DataFrame, docs: DataFrame, hits: DataFrame, names: list[str]) -> DataFrame:
    """``(query_id, doc_id, n_facets)`` of the hits; a facet without a value is never shared."""
    q = queries.select(F.col("id").alias("query_id"), *(F.col(n).alias(f"_q_{n}") for n in names))
    d = docs.select(F.col("id").alias("doc_id"), *(F.col(n).alias(f"_d_{n}") for n in names))
    equal: Column = reduce(lambda a, b: a + b, (F.coalesce((F.col(f"_q_{n}") == F.col(f"_d_{n}")).cast("int"), F.lit(0)) for n in names))
    return hits.select("query_id", "doc_id").distinct().join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", equal.alias("n_facets"))
