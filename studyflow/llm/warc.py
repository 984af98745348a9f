"""WARC records in seekable Zstandard bundles.

Each bundle is a ``.warc.zst`` file: groups of records are compressed into frames of their own, and a skippable frame
at the end holds the seek table (compressed and plain size of every frame), so a reader finds any frame without the
ones before it.  An index, written as Parquet, maps a page to its bundle, frame, place and length within the frame.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the largest page id is the response and
the others are revisits that refer to it.  Which it is follows from an aggregate by digest (combined before the
shuffle) joined back to the pages; each task of that join writes its own bundles, so pages move once, and Spark splits
a task of many equal payloads.

Bundles are written by the tasks through pyarrow's file systems below the cluster's shared folder (``s3a`` is known to
pyarrow as ``s3``; its region and credentials come from the tasks' environment).  A file's name
holds the hash of its content, and only the index of successful tasks names files, so a task that runs again or twice
writes the same file again, or one that nothing refers to.  A task holds the plain records of a frame, and the compressed
frames of a bundle (``BUNDLE_BYTES`` and a frame at most, since its name needs its content), besides its input batch.

Defined results: null html has an empty payload; null urls are written as empty; records with a null page id are
written, but are never chosen as response before one with an id; if none has one, all are responses; repeated rows of
the largest id are all responses; an empty table gives an empty index and no bundle.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir

MIN_REVISIT = 1000
#: Plain bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Plain bytes that a task reads back, as a goal and at least; neighbouring frames that go to one task.
READ_BYTES, READ_LEAST, GROUP_FRAMES = 256 << 20, 1 << 20, 8
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
_SKIPPABLE, _FOOTER = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id bigint, bundle string, frame int, at bigint, length bigint"


def record_kinds(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, n_bytes, digest, refers_to): ``refers_to`` is null for responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("n_bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    winners = rows.where(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("winner"))
    joined = rows.join(winners.select(F.col("digest").alias("d"), "winner"), (F.col("digest") == F.col("d")) & (F.col("n_bytes") >= min_revisit), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    return joined.select("page_id", "url", "html", "n_bytes", "digest", refers.alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, html: str, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit has the response's HTTP head but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append("WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is None:
        block += html.encode()
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> dict[str, object]:
    """A record's fields; raises ValueError if its lengths or its payload's digest do not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("record of a wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(http.decode().rsplit("Content-Length: ", 1)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload": payload, "payload_bytes": n_bytes, "payload_digest": digest, "refers_to": _page(refers) if refers else None}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with the frames' compressed and plain sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, _FOOTER)
    return struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int]]:
    """(offset, compressed size) of every frame of a bundle, from the end of the file."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _FOOTER or flags:
        raise ValueError("not a seekable bundle")
    file.seek(size - 9 - 8 * n)
    sizes = struct.iter_unpack("<II", file.read(8 * n))
    out, at = [], 0
    for packed, _ in sizes:
        out.append((at, packed))
        at += packed
    return out


#: Names by which Spark knows stores that pyarrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_uri(uri: str) -> str:
    """The URI of a folder, as pyarrow has it."""
    scheme, sign, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme.lower(), scheme)}{sign}{rest}"


class _Writer:
    """Frames and bundles of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(arrow_uri(folder))
        self.fs.create_dir(self.folder, recursive=True)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.plain, self.pending = bytearray(), []
        self.frames: list[tuple[int, int]] = []
        self.body: list[bytes] = []
        self.held, self.rows = 0, []

    def add(self, page_id: int | None, record: bytes) -> Iterator[list[tuple]]:
        self.pending.append((page_id, len(self.frames), len(self.plain), len(record)))
        self.plain += record
        if len(self.plain) >= FRAME_BYTES:
            self._frame()
            if self.held >= BUNDLE_BYTES:
                yield self.close()

    def _frame(self) -> None:
        if self.plain:
            packed = self.packer.compress(bytes(self.plain))
            self.frames.append((len(packed), len(self.plain)))
            self.body.append(packed)
            self.held += len(packed)
            self.rows += self.pending
            self.plain, self.pending = bytearray(), []

    def close(self) -> list[tuple]:
        """Write the bundle and give its index rows."""
        self._frame()
        if not self.rows:
            return []
        parts = [*self.body, seek_table(self.frames)]
        digest = hashlib.sha256()
        for part in parts:
            digest.update(part)
        name = f"{digest.hexdigest()[:40]}.warc.zst"
        with self.fs.open_output_stream(f"{self.folder}/{name}", compression=None) as out:
            for part in parts:
                out.write(part)
        rows = [(page, name, frame, at, n) for page, frame, at, n in self.rows]
        self.frames, self.body, self.held, self.rows = [], [], 0, []
        return rows


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "bundle", "frame", "at", "length"])


def write_warc(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the pages' records into bundles below ``folder`` and return their index (page_id, bundle, frame, at, length)."""
    spark = pages.sparkSession
    kinds = record_kinds(pages, min_revisit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            writer = writer or _Writer(f"{folder}/bundles")
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    for rows in writer.add(row[0], make_record(*row)):
                        yield _index_batch(rows)
        if writer is not None and (rows := writer.close()):
            yield _index_batch(rows)

    kinds.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_warc(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records that the index names, read by seeking to their frames: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked."""
    # A row of the index stands for a record to decompress, so the tasks follow the records' bytes, not the index's.
    total = index.agg(F.sum("length")).first()[0] or 0
    least = min(2 * index.sparkSession.sparkContext.defaultParallelism, -(-total // READ_LEAST))
    dealt = index.repartition(max(1, least, -(-total // READ_BYTES)), F.col("bundle"), F.floor(F.col("frame") / GROUP_FRAMES)).sortWithinPartitions("bundle", "frame", "at")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(arrow_uri(f"{folder}/bundles"))
        opened: tuple = (None, None, None)
        frame_at: tuple = (None, None, b"")
        with contextlib.ExitStack() as files:
            for batch in batches:
                out = []
                for bundle, frame, at, n in zip(*(c.to_pylist() for c in batch.columns[1:])):
                    if opened[0] != bundle:
                        files.close()  # the bundle before
                        file = files.enter_context(fs.open_input_file(f"{top}/{bundle}"))
                        opened = bundle, file, read_seek_table(file)
                    if frame_at[:2] != (bundle, frame):
                        start, size = opened[2][frame]
                        opened[1].seek(start)
                        frame_at = bundle, frame, zstandard.ZstdDecompressor().decompress(opened[1].read(size))
                    record = read_record(frame_at[2][at : at + n])
                    out.append([record[c] for c in names])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    return dealt.mapInArrow(run, schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page written to bundles and read back."""
    folder = shared_dir(spark)
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN winner IS NOT NULL AND page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM p LEFT JOIN w ON p.d = w.d AND p.n >= 1000
"""
