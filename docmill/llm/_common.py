"""What the operators of this subpackage share: input rows, tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.plans.stored import discard, scratch, stored, stored_at  # noqa: F401  for the other modules
from docmill.plans.stored import new_place as new_path  # noqa: F401

#: The ids of a document and of a vector are longs; a row without an id takes no part in matching.
ID = "doc_id"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a local one where it is unset and driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="docmill-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def looked_up(ids: DataFrame) -> DataFrame:
    """A stored table of ids that wide rows are joined with. Where it is too large to be broadcast, it is hashed part by part: a merge would sort the wide rows,
    and write them to disk once more."""
    size = int(str(ids._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = ids.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return ids if size <= most else ids.hint("shuffle_hash")


def orderable(df: DataFrame, column: str) -> Column:
    """The column, as its JSON text where it holds a type without an order (map, variant)."""

    def ordered(kind) -> bool:
        if isinstance(kind, T.StructType):
            return all(ordered(f.dataType) for f in kind.fields)
        return ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))

    return F.col(column) if ordered(df.schema[column].dataType) else F.to_json(F.struct(column))


def unique_rows(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The key (as a long) and the named columns only, one row for each key.

    Rows that repeat a key stand for one document: of those the greatest (column by column, nulls smallest; maps and variants as JSON) is taken. Rows with a null key are
    left out here. The check for repeats reads the key column alone; only if it finds some are the rows themselves grouped.
    """
    rows = df.select(F.col(key).cast("long").alias(key), *columns).filter(F.col(key).isNotNull())
    repeated = rows.groupBy(key).count().filter("count > 1")
    if repeated.isEmpty():
        return rows
    greatest = F.struct(*[orderable(rows, c).alias(f"o{k}") for k, c in enumerate(columns)])
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), greatest).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def keyless_rows(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The rows without a key, which every operator returns with the result of a document that matches nothing."""
    return df.select(F.col(key).cast("long").alias(key), *columns).filter(F.col(key).isNull())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its values (nulls: empty), without a copy where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, … for each pair of a start and a length, concatenated."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1], dtype=np.int64)


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: 256 fixed random words, by rule.
BYTE_WORDS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal tuples starts in columns that are sorted together."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def merge_spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions [start, end) intervals of equal keys that overlap or touch."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    group = np.cumsum(runs(key)) - 1
    # Ends rise within a key once each key's ends are lifted above all earlier keys'.
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(key), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] + lift[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], reach[last] - lift[last]
