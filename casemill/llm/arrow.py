"""Kernels over Arrow batches, shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def as_bytes(name: str = "text"):
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that only those are held as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def arrow_map(df: DataFrame, kernel: Callable[..., Iterable[tuple]], schema: str, rows: int = 2048) -> DataFrame:
    """Rows of ``kernel(*columns)`` for parts of at most ``rows`` rows of each Arrow batch of ``df``.

    The kernel gets the batch's columns as Python lists and yields one tuple for each row it
    makes. A batch holds at most spark.sql.execution.arrow.maxBytesPerBatch bytes, so memory
    does not depend on the size of a partition.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            if batch.num_rows:
                made = list(kernel(*(c.to_pylist() for c in batch.columns)))
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, type=f.type) for x, f in zip(zip(*made), arrow, strict=True)], schema=arrow
                    )

    return df.mapInArrow(run, schema)


def rewrite(df: DataFrame, decide: Callable[[list[str]], tuple[list[bool] | None, list[str] | None]], rows: int = 512, more: str | None = None) -> DataFrame:
    """``df`` with rows dropped and texts changed by one pass that never shuffles.

    ``decide`` gets the texts of at most ``rows`` rows (null as empty) and returns which rows stay (None: all) and
    the new texts (None: unchanged; an entry of None leaves its row as it is, null included).
    It also gets the values of the column ``more``, where one is named.
    n_chars follows a changed text where there is such a column. Other columns pass untouched,
    whatever their names and types.
    """
    schema, names = df.schema, df.columns
    text_at, count_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            old = batch.column(text_at).to_pylist()
            keep, new = decide([t or "" for t in old], *([batch.column(names.index(more)).to_pylist()] if more else []))
            columns = list(batch.columns)
            if new is not None:
                changed = [t is not None for t in new]
                columns[text_at] = pa.array([t if t is not None else o for t, o in zip(new, old, strict=True)], columns[text_at].type)
                if count_at is not None:
                    counts = columns[count_at].to_pylist()
                    columns[count_at] = pa.array(
                        [len(t) if c else n for t, c, n in zip(new, changed, counts, strict=True)], columns[count_at].type
                    )
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch if keep is None else batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, schema)


def beside(df: DataFrame, kernel: Callable[[list[bytes]], list], field: StructField, rows: int = 512) -> DataFrame:
    """``df`` with one more column, made from the texts (UTF-8, null as empty) of some rows at a time."""
    schema, text_at = StructType([*df.schema.fields, field]), df.columns.index("text")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            made = kernel([(t or "").encode() for t in batch.column(text_at).to_pylist()])
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, arrow[-1].type)], schema=arrow)

    return df.mapInArrow(run, schema)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, behind as many underscores as it takes to clash with no column."""
    while name in df.columns:
        name = f"_{name}"
    return name
