"""Shared helpers of the text operators: Arrow batches, stable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ordered import shared_folder

#: Text that one step of a Python task holds beside the Arrow batch, in characters.
STEP_CHARS = 4_000_000


#: What the worker keeps from task to task.
_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returned for ``key`` in an earlier task of this worker, or returns now.

    A worker serves one operator after the other, so it keeps the last one's table alone.
    """
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Let go of what is kept, and of Arrow's free memory."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to ``spark.checkpoint.dir`` and cut its lineage there.

    The folder is the session's own.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def steps(texts: list, limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` characters together; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns whose names, in any case, are among ``names``."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_text(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable], fields: list[T.StructField]) -> DataFrame:
    """Append ``fields`` computed from whole texts to the columns ``keep``.

    ``make()`` runs once in each task and returns a function from a list of texts (None for null)
    to one list or array per field. A kept column whose name clashes with a new field gives way.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in keep if c.lower() not in new]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(fresh(df, "__text")[0]))
    schema = T.StructType([rows.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(T.StructType(fields))
    types = [f.type for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(len(kept))
            for at in range(0, batch.num_rows, 2048):
                part = texts.slice(at, 2048).to_pylist()
                for a, b in steps(part):
                    made = work(part[a:b])
                    columns = [batch.column(i).slice(at + a, b - a) for i in range(len(kept))]
                    columns += [x if isinstance(x, pa.Array) else pa.array(x, type=t, from_pandas=True) for x, t in zip(made, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
