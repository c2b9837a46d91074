"""Token-id files: whole texts as ids, coded by the adaptive range coder, in ascending order of ids.

A file table holds containers (see range_coder) in Parquet rows: part and number of the container in
it, ids before it in its part, the documents it holds with their id counts, and the coded bytes. Parts
follow the order of document ids; a document never spans containers. Reading checks every
checksum (head, model, index, each block) and gives back the ids.

Defined results: a null or empty text is just its end id; null document ids come first; rows that
share an id are ordered by text and stay separate; a very long text is coded whole, over as many
blocks as it takes; other columns, whatever their names, are not read; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import range_coder, tokens
from kinspark.llm.shared import map_arrow, slices

#: Ids that one container holds at least, unless its part ends.
CONTAINER_IDS = 6 << 20
#: Text bytes encoded at once, and chunks that a Python worker remembers: coding takes more memory than either.
SLICE_BYTES, KNOWN_CHUNKS = 4 << 20, 600_000
_SCHEMA = "part int, number int, before long, docs array<bigint>, counts array<bigint>, coded binary"


def _write(path: str, end_id: int, container_ids: int):
    fields = [("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("coded", pa.binary())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, KNOWN_CHUNKS)
        part_id, number, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[list] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            row = [[part_id], [number], [before], [[d for x in docs for d in x]], [np.concatenate(counts)], [range_coder.encode(np.concatenate(ids))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(row, fields, strict=True)], [n for n, _ in fields])

        for part in slices(batches, "text", SLICE_BYTES):
            flat, at = enc.encode(part.column("text"))
            full = np.full(len(flat) + part.num_rows, end_id, np.uint32)
            inside = np.ones(len(full), bool)
            inside[at[1:] + np.arange(part.num_rows)] = False
            full[inside] = flat
            docs.append(part.column("doc_id").to_pylist())
            ids.append(full)
            counts.append(np.diff(at) + 1)
            held += len(full)
            if held >= container_ids:
                yield close()
                number, before, held, docs, ids, counts = number + 1, before + held, 0, [], [], []
        if docs:
            yield close()

    return kernel


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, container_ids: int = CONTAINER_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    map_arrow(dealt, _write(tokenizer_path, end_id, container_ids), _SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, before, docs, counts, coded), one row per container."""
    return spark.read.schema(_SCHEMA).parquet(path)


def document_index(files: DataFrame) -> DataFrame:
    """Decode all files: (doc_id, start, n_tokens, ids_crc32) of every document, in whole-corpus positions."""
    parts = files.groupBy("part").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("ids"), F.min(F.array_min("docs")).alias("lo"), F.max(F.array_max("docs")).alias("hi")
    )
    first, total, top = {}, 0, None
    for row in parts.orderBy("part").collect():  # one row per part: as many as write tasks
        if top is not None and row["lo"] is not None and row["lo"] < top:
            raise ValueError(f"part {row['part']} is out of order")
        first[row["part"]] = total
        total += row["ids"]
        top = row["hi"] if row["hi"] is not None else top

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = range_coder.decode(row.column("coded")[0].as_buffer().to_pybytes()).astype("<u4")
                counts = row.column("counts").flatten().to_numpy().astype(np.int64)
                ends = np.cumsum(counts)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a container's ids and its index differ")
                raw = memoryview(ids.tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)), np.int64, len(counts))
                start = first[row.column("part")[0].as_py()] + row.column("before")[0].as_py() + ends - counts
                yield pa.RecordBatch.from_arrays([row.column("docs").flatten(), pa.array(start), pa.array(counts), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(files.select("part", "before", "docs", "counts", "coded"), kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")
