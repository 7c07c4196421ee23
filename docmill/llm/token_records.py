"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index for shuffled reads.

A record: payload length (u64), masked CRC-32 of those eight bytes (u32), payload, masked CRC-32 of the payload (u32), one line feed; all numbers
little-endian. The payload: doc_id (i64), width of an id in bytes (u8: 2 or 4; 128 more if the document has no doc_id), ids. Files hold records in
ascending doc_id, those without one first, and the files' ranges of doc_id follow each other. A file has at most FILE_BYTES, or one record: records without payload, which
readers pass over, fill a file up to the number of rows at which the writer begins the next. Spark's own text writer writes the frames as they are (a frame is a row, the line feed its separator), so commits, retries
and stores are Spark's: nothing is written outside its commit protocol, and any file system that Spark writes can hold the files.

The index is a Parquet table beside them, built from the files: doc_id, file, offset, length, n_tokens, ids_crc32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm._common import ID, keyless_rows, new_path, unique_rows
from docmill.llm._tokens import tokenizer_path, word_coder

VOCABULARY = "word_bpe_49k.json"
END = 1  # appended to each document
RECORDS_PER_FILE = 4096
FILE_BYTES = 1 << 26  # a file is read as one value, so it is kept far below 2 GB
NO_ID = 128

INDEX = "doc_id long, file string, offset long, length long, n_tokens long, ids_crc32 long"
_HEAD = struct.Struct("<QI")


def masked(crc: int) -> int:
    """A checksum that may be stored beside its own data: rotated by 15 bits, plus a constant."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """A record without its line feed."""
    payload = struct.pack("<qB", doc_id or 0, width | (NO_ID if doc_id is None else 0)) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(zlib.crc32(length))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def filling() -> bytes:
    """A record without payload, and without its line feed."""
    return struct.pack("<QII", 0, masked(zlib.crc32(bytes(8))), masked(0))


def parse(data: bytes) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """(doc_id, offset, length of the frame, ids) of every record; a wrong length or checksum is an error that names the offset."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if at + _HEAD.size > len(data):
            raise ValueError(f"a record is cut off at byte {at}")
        size, check = _HEAD.unpack_from(view, at)
        if masked(zlib.crc32(view[at : at + 8])) != check or at + size + 17 > len(data):
            raise ValueError(f"the length of the record at byte {at} is damaged")
        payload = view[at + 12 : at + 12 + size]
        if masked(zlib.crc32(payload)) != struct.unpack_from("<I", view, at + 12 + size)[0] or data[at + size + 16] != 10:
            raise ValueError(f"the record at byte {at} is damaged")
        if size:
            doc_id, width = struct.unpack_from("<qB", payload)
            yield None if width & NO_ID else doc_id, at, size + 16, np.frombuffer(payload[9:], "<u2" if width & ~NO_ID == 2 else "<u4")
        at += size + 17


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


def _frames(batches: Iterator[pa.RecordBatch], path: str, end: int, records_per_file: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    coder = word_coder(path)
    width = 2 if coder.library.get_vocab_size() <= 1 << 16 else 4
    rows = size = 0  # in the file that is being written
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, ids, off in coder.encode(batch.column(1)):
            frames = []
            for k in range(len(off) - 1):
                data = frame(doc_ids[first + k], np.append(ids[off[k] : off[k + 1]], np.uint32(end)), width)
                if rows == records_per_file:
                    rows = size = 0
                if rows and size + len(data) + 1 > file_bytes:
                    frames += [filling()] * (records_per_file - rows)
                    rows = size = 0
                frames.append(data)
                rows, size = rows + 1, size + len(data) + 1
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])


def write_records(documents: DataFrame, path: str, vocabulary: str, end: int = END, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of every text, end appended, to path/records, and the index to path/index.

    A null text has the end id only. Rows that repeat a doc_id are one document (its greatest text); rows without a doc_id stand before all others, in
    the order of their texts. Other columns are ignored. An empty table makes an empty index.
    """
    docs = unique_rows(documents, ID, "text").unionByName(keyless_rows(documents, ID, "text"))
    frames = partial(_frames, path=vocabulary, end=end, records_per_file=records_per_file, file_bytes=file_bytes)
    order = (F.col(ID), F.when(F.col(ID).isNull(), F.col("text")))
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(frames, "frame binary")
    rows.select(F.col("frame").cast("string")).write.option("maxRecordsPerFile", records_per_file).text(f"{path}/records")
    build_index(documents.sparkSession, path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = [(d, file, at, n, len(ids), ids_crc32(ids)) for d, at, n, ids in parse(content.as_py())]
            for k in range(0, len(rows), 10_000):
                columns = list(zip(*rows[k : k + 10_000], strict=True))
                kinds = (pa.int64(), pa.string(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "file", "offset", "length", "n_tokens", "ids_crc32"])


def build_index(spark: SparkSession, path: str) -> None:
    """Reads the files, checks every checksum and writes the index."""
    _files(spark, path).mapInArrow(_entries, INDEX).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with start: the number of ids in all records before each."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    files = index.groupBy("file").agg(F.min(ID).alias("first"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.asc_nulls_first("first"), F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    own = index.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return own.join(files, "file").select(ID, (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length")


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, asked in zip(batch.column(0), batch.column(1), strict=True):
            data = content.as_py()
            rows = [next(parse(data[x["offset"] : x["offset"] + x["length"] + 1])) for x in asked.as_py()]
            columns = [[r[0] for r in rows], [r[3].tolist() for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents whose doc_id is in wanted: the index leads to the bytes, in any order."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    places = index.join(wanted.select(ID).distinct(), ID, "left_semi").groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("asked"))
    return _files(spark, path).join(places, "file").select("content", "asked").mapInArrow(_picked, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_token_records: documents written and read back."""
    path = new_path(spark, "records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path(VOCABULARY))
    return read_index(spark, path)
