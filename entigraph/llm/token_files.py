"""Token ids in binary files of patched frame-of-reference blocks, in ascending order of document ids."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from ._batches import LARGE_CHUNK_BYTES, map_arrow, slices
from ._store import materialize, new_folder
from ._tokens import default_path, encoder

END_ID = 0
#: Ids after which a file is closed.
FILE_IDS = 2 << 20


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents' ids below ``folder`` (a URI that all executors share) and return the manifest.

    Documents are ordered by id (null first; equal ids by a hash of their text) over ranges, so file names sort as the
    documents do. A file is written under another name and then renamed, so a task that runs again leaves no halves.

    Returns file, n_docs, n_ids.
    """
    path = tokenizer_path or default_path()

    def run(batches):
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        encode = encoder(path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        task, made = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, ids, held, made
            name = f"{task:06d}-{made:06d}.pfor"
            counts = [len(x) // 4 for x in ids]
            part = f"{root}/_{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(pfor.pack_file(doc_ids, counts, np.frombuffer(b"".join(ids), dtype="<u4")))
            files.move(part, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([held], pa.int64())], names=["file", "n_docs", "n_ids"])
            doc_ids, ids, held, made = [], [], 0, made + 1
            return row

        for part in slices(batches, "text", LARGE_CHUNK_BYTES):
            texts = [x or "" for x in part.column("text").to_pylist()]
            for doc_id, own in zip(part.column("doc_id").to_pylist(), encode(texts)):
                doc_ids.append(doc_id)
                ids.append(own + end)
                held += len(own) // 4 + 1
                if held >= file_ids:
                    yield close()
        if doc_ids:
            yield close()

    # The text's hash is part of the range, so that rows with one id or none are dealt out, too.
    lot = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", lot).sortWithinPartitions("doc_id", lot)
    return materialize(map_arrow(ordered, run, "file string, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of these files: doc_id, start (ids before it in all files), n_tokens, ids (little-endian)."""
    return _read(manifest, folder, "ids binary", lambda own: own)


def _read(manifest: DataFrame, folder: str, column: str, of) -> DataFrame:
    # Two levels of sums: only one row for each writing task is ordered as a whole.
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", F.substring_index("file", "-", 1).alias("task"), "n_ids")
    tasks = files.groupBy("task").agg(F.sum("n_ids").alias("n_ids")).select("task", before(Window.orderBy("task")).alias("earlier"))
    placed = files.select("task", "file", before(Window.partitionBy("task").orderBy("file")).alias("within")).join(tasks, "task")
    placed = placed.select("file", (F.col("earlier") + F.col("within")).alias("first"))
    kind = pa.binary() if column.endswith("binary") else pa.int64()

    def run(batches):
        files, root = _open(folder)
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("first").to_pylist()):
                with files.open_input_stream(f"{root}/{name}") as src:
                    doc_ids, counts, values = pfor.unpack_file(src.read())
                starts = np.cumsum(counts) - counts
                raw = memoryview(values.astype("<u4").tobytes())
                got = [of(bytes(raw[4 * s : 4 * (s + n)])) for s, n in zip(starts.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + first), pa.array(counts), pa.array(got, kind)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    spread = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def token_files(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write token files and read them back as a digest of each document.

    A null text is an empty one (just the end id). Rows that share a document id are all written, in a fixed order;
    null ids come first and stay null. No documents: no files, no rows. Further columns are not carried.

    Returns doc_id, start, n_tokens, ids_crc32, all from the files.
    """
    folder = folder or new_folder(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer_path, end_id)
    return _read(manifest, folder, "ids_crc32 long", zlib.crc32)
