"""Problem 6: nested records as related flat tables, by Arrow buffers.

A list column is its offsets and its values: the offsets give the parent index and the
position of each element, the values are the child table. Keys go down by vectorised
take. No row of typed columns is parsed. JSON text is parsed once per text into the
same Arrow layout and then takes the same kernels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT = "child_table string, record_id bigint, pos_path string, parent_pos string, element string"


def _children(values: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent index, position and value of each element of a list array."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(values), 0), np.int64)
    starts = np.cumsum(lengths) - lengths
    parents = np.repeat(np.arange(len(values)), lengths)
    return parents, np.arange(int(lengths.sum())) - np.repeat(starts, lengths), values.flatten()


def walk(values: pa.Array, path: str, ids: pa.Array, at: pa.Array | None) -> Iterator[tuple[str, pa.Array, pa.Array, pa.Array, pa.Array]]:
    """(table, record ids, pos_path, parent's pos_path, elements) of every array below."""
    kind = values.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        parents, pos, elements = _children(values)
        text = pa.array(pos).cast(pa.string())
        up = pa.array(np.full(len(pos), ""), pa.string()) if at is None else at.take(pa.array(parents))
        own = text if at is None else pc.binary_join_element_wise(up, text, ".")
        child_ids = ids.take(pa.array(parents))
        keep = pc.is_valid(elements)
        yield path, child_ids.filter(keep), own.filter(keep), up.filter(keep), elements.filter(keep)
        if pa.types.is_nested(elements.type):
            yield from walk(elements, path, child_ids, own)
    elif pa.types.is_struct(kind):
        for k in range(kind.num_fields):
            field = kind.field(k)
            if pa.types.is_nested(field.type):
                yield from walk(pc.struct_field(values, [k]), f"{path}.{field.name}", ids, at)


def _combined(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _rows(parts: Iterator[tuple], elements: bool) -> Iterator[pa.RecordBatch]:
    for table, ids, pos, up, values in parts:
        if len(ids):
            text = pa.array([json.dumps(v, ensure_ascii=False, default=str) for v in values.to_pylist()], pa.string()) if elements else pa.nulls(len(ids), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), table), pa.string()), ids, pos, up, text], ["child_table", "record_id", "pos_path", "parent_pos", "element"])


def flatten_arrays(df: DataFrame, id_col: str, columns: list[str], elements: bool = False) -> DataFrame:
    """One row per non-null element of each array at or below ``columns``.

    ``child_table`` is the array's path, ``pos_path`` the positions from the outermost
    array, ``parent_pos`` the pos_path of the parent element (empty for a child of the
    record). Null elements keep their position and give no row; null and empty arrays
    and null structs give none. ``elements`` adds the element as JSON. Other columns of
    ``df`` are ignored, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, name in enumerate(columns, 1):
                yield from _rows(walk(_combined(b.column(k)), name, b.column(0), None), elements)

    return df.select(F.col(id_col).cast("bigint").alias("id"), *columns).mapInArrow(run, OUT)


def _json(value: object) -> object:
    """Text that itself holds JSON stands for that JSON, however often it is wrapped."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _shaped(value: object, shape: object) -> object:
    """``value`` in the layout of ``shape``: {key: shape} an object, [shape] an array, None any text."""
    value = _json(value)
    if isinstance(shape, list):
        items = value if isinstance(value, list) else [value] if isinstance(value, dict) else None
        return None if items is None else [_shaped(x, shape[0]) for x in items]
    if isinstance(shape, dict):
        if value is None:
            return None
        own = value if isinstance(value, dict) else {}
        return {"_json": json.dumps(value, ensure_ascii=False)} | {k: _shaped(own.get(k), s) for k, s in shape.items()}
    return None if value is None else json.dumps(value, ensure_ascii=False)


def _type(shape: object) -> pa.DataType:
    if isinstance(shape, list):
        return pa.list_(_type(shape[0]))
    if isinstance(shape, dict):
        return pa.struct([("_json", pa.string()), *((k, _type(s)) for k, s in shape.items())])
    return pa.string()


#: The arrays of a knowledge graph: nodes with the references of their metadata, and edges.
GRAPH = {"nodes": [{"metadata": {"refs": [None]}}], "edges": [None]}


def flatten_json(df: DataFrame, id_col: str, column: str, shape: dict = GRAPH, elements: bool = False) -> DataFrame:
    """As ``flatten_arrays`` for a column of JSON text.

    ``shape`` names the objects and arrays to follow. An object in place of an array is
    its only element; text that holds JSON stands for that JSON; text that is no JSON,
    blank text and scalars in place of arrays hold no elements.
    """
    kind = _type(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([_shaped(t, shape) for t in b.column(1).to_pylist()], kind)
            yield from _rows(walk(values, column, b.column(0), None), elements)

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(column)).mapInArrow(run, OUT)


def child_table(df: DataFrame, id_col: str, column: str, table: str) -> DataFrame:
    """The flat table of one array: record_id, pos_path, parent_pos and the element's scalar fields."""
    kind: T.DataType = df.schema[column].dataType
    for part in table.split(".")[1:]:
        kind = (kind.elementType if isinstance(kind, T.ArrayType) else kind)[part].dataType
    element = kind.elementType
    rows = flatten_arrays(df, id_col, [column], elements=True).where(F.col("child_table") == table)
    parsed = F.from_json("element", element) if isinstance(element, T.StructType) else F.from_json(F.concat(F.lit('{"value":'), "element", F.lit("}")), T.StructType([T.StructField("value", element)]))
    fields = [f.name for f in element.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType))] if isinstance(element, T.StructType) else ["value"]
    return rows.withColumn("_e", parsed).select("record_id", "pos_path", "parent_pos", *(F.col("_e").getField(f).alias(f) for f in fields))
