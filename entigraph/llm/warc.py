"""WARC archives: written with an index, read back by coalesced byte ranges of the selected records.

Files are ``.warc.gz``: each record is a gzip member of its own, so a byte range of the index holds whole records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import map_arrow, slices
from ._store import materialize, new_folder

#: Payloads of fewer bytes are never replaced by revisits.
LEAST_REVISIT_BYTES = 1000
#: Bytes after which an archive file is closed.
FILE_BYTES = 64 << 20
#: Byte ranges of a file with a gap of at most so many bytes are read at once, up to so many bytes in all.
GAP_BYTES = 256 << 10
RANGE_BYTES = 8 << 20
#: Bytes of records that one task reads back, about.
TASK_BYTES = 128 << 20

_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: records carry no capture time, so that equal inputs give equal archives.
_DATE = "1970-01-01T00:00:00Z"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _record_id(page_id: int | None, place: str = "") -> str:
    """A page without an id goes by its record's place, so that record ids differ."""
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page-at:{place}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """One record, compressed. A revisit carries headers only; line ends within a URL are escaped."""
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        _VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, place)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_PROFILE}", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse(raw: bytes | memoryview) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record that these bytes hold."""
    raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != _VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def _page(record_id: str) -> int | None:
    return int(record_id.removeprefix("<urn:page:").removesuffix(">")) if record_id.startswith("<urn:page:") else None


_INDEX = "page_id long, url string, digest string, file string, at long, size long"


def plan_records(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Pages with their payload's digest and size, and the page that each repeated payload refers to.

    Of equal payloads of ``least_bytes`` or more, the one with the largest id is the response; the digests of payloads
    that occur once never leave the aggregation. Those that repeat are a table of their own, so that the join is a plain
    one: small, they are broadcast; large, a common payload's pages can be dealt to many tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    large = rows.where(F.col("bytes") >= least_bytes)
    first = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("asked"), "response")
    # A smaller payload asks for no digest, but for a value of its own that none has.
    asked = F.when(F.col("bytes") >= least_bytes, F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    return rows.withColumn("asked", asked).join(materialize(first, "repeated"), "asked", "left").drop("asked")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record of every page below ``folder`` (a URI that all executors share) and return the index.

    Each task writes files of its own, under another name until they are complete. The index has page_id, url, digest,
    file, at (byte offset) and size.
    """
    planned = plan_records(pages, least_bytes)
    revisit: Column = F.col("response").isNotNull() & (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response"))
    rows = planned.select("page_id", "url", "html", "digest", F.when(revisit, F.col("response")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def run(batches):
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        task, made, out, part, name, at = TaskContext.get().partitionId(), 0, None, "", "", 0
        index: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal out, index
            out.close()
            out = None
            files.move(part, f"{root}/{name}")
            columns = list(zip(*index))
            index = []
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "url", "digest", "file", "at", "size"])

        for batch in slices(batches, "html"):
            for page in batch.to_pylist():
                if out is None:
                    name = f"{task:06d}-{made:06d}.warc.gz"
                    part, made, at = f"{root}/_{name}.{uuid.uuid4().hex}", made + 1, 0
                    out = files.open_output_stream(part)
                raw = record(page["page_id"], page["url"], (page["html"] or "").encode(), page["digest"], page["refers_to"], page["revisit"], f"{name}:{at}")
                out.write(raw)
                index.append((page["page_id"], page["url"], page["digest"], name, at, len(raw)))
                at += len(raw)
                if at >= file_bytes:
                    yield close()
        if out is not None:
            yield close()

    return materialize(map_arrow(rows, run, _INDEX), "warc-index")


def coalesce_ranges(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> list[tuple[int, int, list[int]]]:
    """Sorted (at, size) rows as reads (from, to, rows): neighbours within ``gap`` bytes share a read of ``most`` bytes."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (at, size) in enumerate(rows):
        if reads and at - reads[-1][1] <= gap and at + size - reads[-1][0] <= most:
            begin, end, own = reads[-1]
            own.append(i)
            reads[-1] = (begin, max(end, at + size), own)
        else:
            reads.append((at, at + size, [i]))
    return reads


_READ = "page_id long, url string, record_type string, digest string, refers_to long, payload_bytes long"


def read_archives(selected: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Read the records of these index rows: sorted by place, in few byte ranges, each checked against its digest.

    Returns page_id, url, record_type, digest, refers_to, payload_bytes (of the full payload), and payload if wanted.
    """
    # Index rows are dealt by ranges of places, so that a task's rows are neighbours and a large file is shared; the
    # number of tasks follows the bytes that they will read, not those of the index.
    size = selected.agg(F.sum("size")).first()[0] or 0
    tasks = max(-(-size // TASK_BYTES), int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = selected.select("file", "at", "size").repartitionByRange(int(tasks), "file", "at").sortWithinPartitions("file", "at")
    schema = _READ + (", payload binary" if with_payload else "")

    def run(batches):
        files, root = _open(folder)
        for batch in batches:
            names, at, size = (batch.column(c).to_pylist() for c in ("file", "at", "size"))
            for name in dict.fromkeys(names):
                own = [(a, s) for n, a, s in zip(names, at, size) if n == name]
                with files.open_input_file(f"{root}/{name}") as src:
                    for begin, end, rows in coalesce_ranges(own):
                        view = memoryview(src.read_at(end - begin, begin))
                        out = []
                        for i in rows:
                            a, s = own[i]
                            fields, payload = parse(view[a - begin : a - begin + s])
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            kind = fields["WARC-Type"]
                            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"a payload in {name} at {a} does not match its digest")
                            url = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                            refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                            n = int(fields.get("X-Payload-Length", len(payload)))
                            out.append((_page(fields["WARC-Record-ID"]), url, kind, digest, refers, n, payload)[: 6 + with_payload])
                        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return map_arrow(ordered, run, schema)


def warc_round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write all pages as WARC records and read every one back through the index.

    A null html is an empty payload, a null url an empty one. Pages with a null id come back with a null id; among equal
    payloads they are revisits, or responses if no id is set at all. Rows that share the largest id are all responses.
    No pages: no files, no rows. Further columns are not carried.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    found = read_archives(write_archives(pages, folder, least_bytes), folder)
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
