"""Token ids in Parquet list columns, with controlled encodings, row groups and page indexes.

Documents are dealt by ranges of doc_id; each range becomes one file in which rows ascend. Ids are
dictionary-coded, keys and lengths delta-coded, a row group ends at a number of ids, and page
indexes let a reader fetch single documents or only keys and lengths. A task writes to a name of
its own and the manifest lists the files of tasks that succeeded, so that repeated tasks are harmless.

Defined cases: null and empty texts hold the end id alone; a null doc_id comes first; rows of equal
doc_id follow one another in the order of a hash of their texts and are all kept, so that results do not depend on the
layout of the input; texts of any length are encoded whole; an empty table gives no files and an empty
result; further columns, whatever their names, are left aside.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from echoledger.llm.bpe import Encoder, byte_letters, text_steps
from echoledger.llm.shared import Tables, documents_of, parts

#: Ids in a row group, and bytes in a data page.
GROUP_IDS, PAGE_BYTES = 1 << 19, 1 << 16

FILE_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32()))),
])
MANIFEST = "part int, file string, docs bigint, tokens bigint"
_opened: dict[str, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    """Ids of each distinct word by the tokenizers library; one instance in a worker process."""
    if path not in _opened:
        import json
        import re

        from tokenizers import Tokenizer

        model, letters = Tokenizer.from_file(path).model, dict(enumerate(byte_letters()))
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}

        def word_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            rows = [[t.id for t in model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))] for word in words]
            return np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows], np.int64)

        _opened[path] = Encoder(special, re.compile("|".join(map(re.escape, special))) if special else None, word_ids)
    return _opened[path]


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class TokenFile:
    """Writes one file; rows are held until a row group is full."""

    def __init__(self, uri: str, group_ids: int):
        fs, path = file_system(uri)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            fs.create_dir(os.path.dirname(path), recursive=True)
        self.sink = fs.open_output_stream(path)
        self.writer = pq.ParquetWriter(
            self.sink, FILE_SCHEMA, compression="zstd", use_dictionary=["ids.list.element"], write_page_index=True,
            data_page_size=PAGE_BYTES, column_encoding={c: "DELTA_BINARY_PACKED" for c in ("doc_id", "start", "n_tokens")},
        )
        self.group_ids, self.waiting, self.held, self.docs, self.tokens = group_ids, [], 0, 0, 0

    def add(self, doc_ids: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> None:
        """Rows go to the open row group, which ends with the document that fills it."""
        i = 0
        while i < len(doc_ids):
            j = min(len(doc_ids), int(np.searchsorted(offsets, offsets[i] + self.group_ids - self.held)))
            j = max(j, i + 1)
            self._add(doc_ids.slice(i, j - i), offsets[i : j + 1] - offsets[i], ids[offsets[i] : offsets[j]])
            i = j

    def _add(self, doc_ids: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> None:
        n = np.diff(offsets)
        self.waiting.append(pa.RecordBatch.from_arrays([
            doc_ids, pa.array(self.tokens + offsets[:-1]), pa.array(n),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
        ], schema=FILE_SCHEMA))
        self.docs, self.tokens, self.held = self.docs + len(n), self.tokens + len(ids), self.held + len(ids)
        if self.held >= self.group_ids:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            table = pa.Table.from_batches(self.waiting)
            self.writer.write_table(table, row_group_size=max(1, table.num_rows))
            self.waiting, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.sink.close()


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, group_ids: int = GROUP_IDS, files: int | None = None) -> DataFrame:
    """Writes the ids of all documents below `folder`; the manifest: one row for each file, in order."""
    spark = docs.sparkSession
    tables = Tables(spark, "token-manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, uri, part = library_encoder(path), None, "", TaskContext.get().partitionId()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in text_steps(texts):
                if file is None:
                    uri = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.parquet"
                    file = TokenFile(uri, group_ids)
                offsets, ids = encoder.encode(texts[i:j])
                whole = np.insert(ids, offsets[1:], end_id)
                file.add(b.column(0).slice(i, j - i).cast(pa.int64()), offsets + np.arange(len(offsets)), whole)
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((part, pa.int32()), (uri, pa.string()), (file.docs, pa.int64()), (file.tokens, pa.int64()))],
                ["part", "file", "docs", "tokens"])

    # Rows of one doc_id are told apart by a hash of their texts, so that a doc_id of very many rows is split too.
    order = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))]
    ranged = documents_of(docs, "doc_id", "text").repartitionByRange(files or parts(spark), *order).sortWithinPartitions(*order, "text")
    return tables.keep(ranged.mapInArrow(run, MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame, *columns: str) -> DataFrame:
    """The named columns of all files (all of them by default), `start` counted over all files.

    Only the pages of these columns are read; a condition on doc_id skips row groups and pages.
    """
    rows = manifest.orderBy("part").collect()  # one row for each file
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids array<int>").select(*columns or ("*",))
    before, offsets = 0, []
    for r in rows:
        offsets.append((r["file"].rsplit("/", 1)[-1], before))
        before += r["tokens"]
    firsts = spark.createDataFrame(offsets, "file_name string, before bigint")
    stored = spark.read.schema("doc_id bigint, start bigint, n_tokens bigint, ids array<int>").parquet(*[r["file"] for r in rows])
    if columns and "start" not in columns:
        return stored.select(*columns)
    named = stored.withColumn("file_name", F.col("_metadata.file_name")).join(F.broadcast(firsts), "file_name")
    return named.select(*[(F.col("before") + F.col("start")).alias("start") if c == "start" else F.col(c) for c in columns or FILE_SCHEMA.names])


def checksums(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    tables = Tables(spark, "token-files")
    manifest = write(docs, path, tables.root, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            at = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            sums = [zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, manifest, "doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
