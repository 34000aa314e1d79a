"""The node table: one row per JSON node, so that ordinary Spark operators apply to what is inside documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import JsonError, dumps, loads, type_name
from ..path.evaluate import I64_MAX, I64_MIN, is_number, located
from ..path.rewrite import compile_path

#: Column: (DDL type, Arrow type, value of a node from (value, path, place in document order)).
COLUMNS: dict[str, tuple[str, pa.DataType, Callable[[Any, tuple, int], Any]]] = {
    "path": ("array<string>", pa.list_(pa.string()), lambda v, at, n: [str(x) for x in at]),
    "depth": ("int", pa.int32(), lambda v, at, n: len(at)),
    "ordinal": ("int", pa.int32(), lambda v, at, n: n),
    "parent": ("array<string>", pa.list_(pa.string()), lambda v, at, n: [str(x) for x in at[:-1]] if at else None),
    "name": ("string", pa.string(), lambda v, at, n: at[-1] if at and isinstance(at[-1], str) else None),
    "idx": ("int", pa.int32(), lambda v, at, n: at[-1] if at and isinstance(at[-1], int) else None),
    "type": ("string", pa.string(), lambda v, at, n: type_name(v)),
    "json": ("string", pa.string(), lambda v, at, n: dumps(v)),
    "long": ("bigint", pa.int64(), lambda v, at, n: v if isinstance(v, int) and not isinstance(v, bool) and I64_MIN <= v <= I64_MAX else None),
    "dbl": ("double", pa.float64(), lambda v, at, n: float(v) if is_number(v) else None),
    "str": ("string", pa.string(), lambda v, at, n: v if isinstance(v, str) else None),
    "bool": ("boolean", pa.bool_(), lambda v, at, n: v if isinstance(v, bool) else None),
    "size": ("int", pa.int32(), lambda v, at, n: len(v) if isinstance(v, (list, dict)) else None),
}
#: Nodes of an emitted batch, about.
BATCH = 50_000


def nodes(df: DataFrame, key: str = "key", doc: str = "doc", path: str = "$..*", root: bool = True, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """(key, columns) of every node that ``path`` finds, in document order; ``root``: the document itself too.

    Only the ``columns`` asked for are made. A null or invalid document has no nodes.
    """
    compiled = compile_path(path)
    if compiled.projection:
        raise ValueError("a projection has no nodes")
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            cells: list[list] = [[] for _ in columns]
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    value = None if text is None else loads(text)
                except JsonError:
                    continue
                if text is None:
                    continue
                found = ([(value, ())] if root else []) + located(compiled, value)
                keys += [i] * len(found)
                for cell, c in zip(cells, columns, strict=True):
                    get = COLUMNS[c][2]
                    cell += [get(v, at, n) for n, (v, at) in enumerate(found)]
                if len(keys) > BATCH:
                    yield emit(batch, keys, cells)
                    keys, cells = [], [[] for _ in columns]
            if keys:
                yield emit(batch, keys, cells)

    def emit(batch: pa.RecordBatch, keys: list[int], cells: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *(pa.array(x, COLUMNS[c][1]) for x, c in zip(cells, columns, strict=True))], names=["key", *columns])

    schema = ", ".join([f"key {kind}", *(f"{c} {COLUMNS[c][0]}" for c in columns)])
    return df.select(F.col(key).alias("key"), F.col(doc).alias("doc")).mapInArrow(run, schema).withColumnRenamed("key", key)
