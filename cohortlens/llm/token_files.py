"""Token ids in Arrow files of equal-length sequences, and random access to them without copies.

Documents are put in ascending order by a range partitioning; each task encodes its range as a stream and writes two
Arrow files: ``part-N.ids.arrow`` holds record batches of two fixed-size lists, the ids of a sequence and its mask
(false where the last sequence of a file is padded); ``part-N.docs.arrow`` holds the id, first position and number of ids of every
document in the file. Every list of a batch has the same length, so sequence ``k`` lies at a place known without
reading; a memory-mapped file gives its ids as a view of the mapped pages.

A file is written under the name of its attempt and moved when complete, so a task that is run again leaves the same
file. The driver sees one row per file (its name and number of ids), never one per document.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortlens.llm.spark_util import staged, texts
from cohortlens.llm.token_counts import default_vocabulary
from cohortlens.llm.token_ids import encode_texts
from cohortlens.sources.materialize import shared_folder

SEQUENCE = 2048
#: Sequences per record batch.
BATCH_SEQUENCES = 256
DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, path string, n_docs long, n_tokens long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes a stream of ids as an Arrow file of fixed-size lists."""

    def __init__(self, sink, id_type: pa.DataType, length: int = SEQUENCE, batch: int = BATCH_SEQUENCES):
        self.length, self.full = length, length * batch
        self.id_type = id_type
        self.schema = pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def write(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.id_type.to_pandas_dtype()))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.full:
            flat = np.concatenate(self.waiting)
            for at in range(0, len(flat) - self.full + 1, self.full):
                self._batch(flat[at:at + self.full], self.full)
            rest = len(flat) % self.full
            self.waiting, self.n_waiting = [flat[len(flat) - rest:]], rest

    def _batch(self, ids: np.ndarray, used: int) -> None:
        mask = np.arange(len(ids)) < used
        self.writer.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids, self.id_type), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ], schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, flat.dtype)
            padded[:len(flat)] = flat
            self._batch(padded, len(flat))
        self.writer.close()


class SequenceReader:
    """Random access to the sequences of a file; arrays are views of the file's memory where it can be mapped."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        local = isinstance(system, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._ids, self._batch_ids = -1, None, 0
        if self.file.num_record_batches:
            self._batch_ids = len(self._load(0))

    def _load(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._ids = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self._ids

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``k``."""
        per_batch = self._batch_ids // self.length
        batch = self.file.get_batch(k // per_batch)
        row = k % per_batch
        return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values

    def span(self, start: int, size: int) -> Iterator[np.ndarray]:
        """The ids at ``start..start + size - 1``, as one view per record batch they lie in."""
        while size > 0:
            ids = self._load(start // self._batch_ids)
            offset = start % self._batch_ids
            view = ids[offset:offset + size]
            yield view
            start, size = start + len(view), size - len(view)

    def close(self) -> None:
        self.source.close()


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, id_type: pa.DataType, length: int):
    """Encode and write one partition; yields its manifest row, or none if it has no document."""
    context = TaskContext.get()
    part, attempt = context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    names = {kind: f"{root}/part-{part:06d}.{kind}.arrow" for kind in ("ids", "docs")}
    n_docs = n_tokens = 0
    ids_sink = docs_sink = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if ids_sink is None:
            ids_sink = system.open_output_stream(f"{names['ids']}.{attempt}")
            docs_sink = system.open_output_stream(f"{names['docs']}.{attempt}")
            writer = SequenceWriter(ids_sink, id_type, length)
            docs_writer = pa.ipc.new_file(docs_sink, DOCS_SCHEMA)
        for first, ids, counts in encode_texts(batch.column(1), path, end_id):
            writer.write(ids)
            starts = n_tokens + np.cumsum(counts) - counts
            docs_writer.write_batch(pa.record_batch(
                [batch.column(0).slice(first, len(counts)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                schema=DOCS_SCHEMA,
            ))
            n_docs, n_tokens = n_docs + len(counts), n_tokens + len(ids)
    if ids_sink is None:
        return
    writer.close()
    docs_writer.close()
    for kind, sink in (("ids", ids_sink), ("docs", docs_sink)):
        sink.close()
        system.move(f"{names[kind]}.{attempt}", names[kind])
    yield pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}"]), pa.array([n_docs], pa.int64()),
         pa.array([n_tokens], pa.int64())], names=["part", "path", "n_docs", "n_tokens"],
    )


def write_token_files(
    docs: DataFrame, folder: str, end_id: int = 2, vocabulary: str | None = None, length: int = SEQUENCE,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Write the ids of all documents in ascending id order; returns the manifest, one row per file.

    Rows that share an id are ordered by text; null ids come first. A null text is an empty one and has the end id
    only. An empty table writes no file.
    """
    path = vocabulary or default_vocabulary()
    id_type = pa.uint16() if _vocabulary_size(path) <= 1 << 16 else pa.uint32()
    ordered = texts(docs, text, doc_id).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(lambda it: _write_part(it, folder, path, end_id, id_type, length), MANIFEST))


def _vocabulary_size(path: str) -> int:
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``."""
    spark = manifest.sparkSession
    before, files = 0, []
    for row in manifest.orderBy("part").collect():  # one row per file
        files.append((row["path"], before))
        before += row["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = SequenceReader(f"{path}.ids.arrow")
                system, local = _open(f"{path}.docs.arrow")
                with system.open_input_file(local) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        crcs = [span_crc(reader, s, n) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [docs.column(0), pa.array(starts + base, pa.int64()), docs.column(2), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                reader.close()

    frame = spark.createDataFrame(files, "path string, base long")
    return frame.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def span_crc(reader: SequenceReader, start: int, size: int) -> int:
    crc = 0
    for view in reader.span(start, size):
        crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
    return crc


def token_digests(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the files (into a new folder of the shared one unless ``folder`` is given) and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{_as_uri(shared_folder(spark))}/tokens-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, **options))


def _as_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
