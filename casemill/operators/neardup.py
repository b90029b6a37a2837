"""Template groups: texts that are the same or nearly so.

Equal normalised texts collapse first. Distinct ones get MinHash signatures in one Arrow pass;
band keys meet by equality. Each band group links its members to its least one; then, so that no
link that a band offers is lost, all its pairs that are still in different components are compared
too. A pair stands only if the exact Jaccard similarity of shingles confirms it. So there are two
rounds of comparisons, whatever the groups look like. With ``BANDS`` bands of ``ROWS`` rows a pair of
similarity 0.8 meets with probability 0.94, one of 0.85 with 0.997.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as T
from casemill.operators.components import connected_components
from casemill.plans.cut import checkpointed

BANDS, ROWS, MIN_CHARS, THRESHOLD = 20, 9, 20, 0.8
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _grams(text: str, n: int = 5) -> np.ndarray:
    """Hashes of the distinct character n-grams."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    h = np.zeros(max(1, len(code) - n + 1), np.uint64)
    for k in range(min(n, len(code))):
        h = (h ^ code[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(rep, band, key)`` of each text: the least hashes of its n-grams, hashed band by band."""
    for pdf in frames:
        low = np.full((len(pdf), BANDS * ROWS), 2**64 - 1, np.uint64)
        for i, text in enumerate(pdf["norm"]):
            g = _grams(text)
            for k in range(0, len(g), 4096):
                low[i] = np.minimum(low[i], ((g[k : k + 4096, None] * _A + _B) >> np.uint64(8)).min(0))
        low = low.reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), low.shape[:2]).copy()
        for row in range(ROWS):
            key = (key ^ low[:, :, row]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        yield pd.DataFrame({"rep": np.repeat(pdf["rep"].to_numpy(), BANDS), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(pdf)), "key": key.ravel().view(np.int64)})


def _similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        keep = []
        for x, y in zip(pdf["x"], pdf["y"], strict=True):
            a, b = _grams(x), _grams(y)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= THRESHOLD * (len(a) + len(b) - both))
        yield pdf.loc[keep, ["a", "b"]]


def links(distinct: DataFrame) -> DataFrame:
    """Verified links between distinct texts ``(rep, norm)``."""
    members = checkpointed(distinct.mapInPandas(_bands, "rep long, band int, key long"))
    texts = distinct.select("rep", "norm")
    x, y = (texts.select(F.col("rep").alias(k), F.col("norm").alias(t)) for k, t in (("a", "x"), ("b", "y")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return checkpointed(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(_similar, "a long, b long"))

    heads = members.groupBy("band", "key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = confirmed(members.join(heads, ["band", "key"]).filter("rep > a").select("a", F.col("rep").alias("b")).distinct())
    # what a head did not confirm may be linked to another member
    member = connected_components(found, "a", "b")
    placed = members.join(member, F.col("rep") == F.col("node"), "left").select("rep", "band", "key", F.coalesce("component", "rep").alias("c"))
    split = placed.groupBy("band", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("band", "key")
    open_ = checkpointed(placed.join(split, ["band", "key"]))
    one, other = (open_.select(F.col("rep").alias(k), "band", "key", F.col("c").alias(f"c_{k}")) for k in ("a", "b"))
    across = one.join(other, ["band", "key"]).filter("a < b AND c_a <> c_b").select("a", "b").distinct()
    return found.union(confirmed(across))


def template_groups(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, template_group_id)``: the least id of the group; short texts stand alone."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), T.dedup_normalised(F.col(text_column)).alias("norm"))
    distinct = checkpointed(rows.filter(F.length("norm") >= MIN_CHARS).groupBy("norm").agg(F.min("id").alias("rep")))
    member = connected_components(links(distinct), "a", "b")
    group = distinct.join(member, F.col("rep") == F.col("node"), "left").select("norm", F.coalesce("component", "rep").alias("gid"))
    return rows.join(group, "norm", "left").select("id", F.coalesce("gid", "id").alias("template_group_id"))


def exact_groups(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, group_id, group_size)`` of equal normalised texts."""
    rows = df.select(F.col(id_column).alias("id"), F.md5(T.dedup_normalised(F.col(text_column))).alias("digest"))
    groups = rows.groupBy("digest").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "digest").select("id", "group_id", "group_size")


def group_stats(groups: DataFrame) -> DataFrame:
    """Groups, those with several members and the share of rows in them."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    many = F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("size") > 1).alias("n_multi"), F.coalesce(many, F.lit(0)).alias("rows_in_multi"),
        F.round(F.coalesce(F.try_divide(100.0 * many, F.sum("size")), F.lit(0.0)), 2).alias("pct_in_multi"), F.max("size").alias("largest"),
    )


def largest_groups(groups: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest groups with their share of all rows."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("_total"))
    return sizes.crossJoin(F.broadcast(total)).select("group_id", "size", F.round(100.0 * F.col("size") / F.col("_total"), 2).alias("pct")).orderBy(F.col("size").desc(), "group_id").limit(k)
