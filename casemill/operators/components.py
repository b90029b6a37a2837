"""Connected components of a distributed edge list.

First every task replaces its edges, some at a time, by stars of the same components: of a dense
graph little more is left than its nodes. A graph of at most ``BOUND`` edges is then finished by
one task, whose size the bound fixes whatever the input. A larger one goes through alternating
large-star and small-star rounds (Kiveris et al., 2014): each round is two aggregations and two
joins on node ids, the number of rounds grows with the logarithm of the component size, until
the graph is small or a round changes nothing. Neither nodes nor edges ever reach the driver.
``min`` is combined on the map side, and the join back to the edges is an ordinary equi-join that
adaptive execution splits when one node has very many neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType, StringType, StructField, StructType

from casemill.plans.cut import dropped, stored

#: Edges that a task holds at a time.
BOUND = 1 << 17


def _stars(kind: DataType, bound: int, roots: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel: ``(a, b)``, each node beside the least of its component, for at most ``bound`` edges at a time.

    Components are those of the edges held together. The least node itself has a row if ``roots``.
    """
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        held = 0

        def find(x):
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        def made() -> Iterator[pa.RecordBatch]:
            rows = [(x, r) for x in up if (r := find(x)) != x or roots]
            for at in range(0, len(rows), 10_000):
                nodes, least = zip(*rows[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array(least, arrow)], names=["a", "b"])
            up.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, bound):
                batch = whole.slice(at, bound)
                if held and held + batch.num_rows > bound:
                    yield from made()
                    held = 0
                held += batch.num_rows
                for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    up.setdefault(a, a)
                    up.setdefault(b, b)
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
        yield from made()

    return run


def _mark(edges: DataFrame) -> tuple[int, int]:
    """A count and an order-free digest, to see when a round changes nothing."""
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60, bound: int = BOUND) -> DataFrame:
    """``(node, component)`` for each node that has an edge; the component is its least node.

    Null ends and loops are ignored; an empty edge list gives an empty result. Nodes without an
    edge are the caller's to add. Nodes that are neither whole numbers nor strings go through
    rounds only. The rounds stop when one changes nothing; ``max_rounds`` only guards against an
    error, and running into it raises.
    """
    now = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    kind = now.schema["a"].dataType
    if not isinstance(kind, IntegralType | StringType) or kind != now.schema["b"].dataType:
        bound = 0
    names = StructType([StructField("a", kind), StructField("b", kind)])
    now = stored(now.mapInArrow(_stars(kind, bound, False), names) if bound else now, "edges")
    mark = _mark(now)
    if mark[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        if mark[0] <= bound:
            named = now.coalesce(1).mapInArrow(_stars(kind, bound, True), names)
            return named.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, now = now, stored(_small_star(_large_star(now)), "edges")
        dropped(before)
        if (new := _mark(now)) == mark:
            roots = now.select(F.col("b").alias("a"), "b").distinct()
            return now.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = new
    raise RuntimeError("connected components did not settle")
