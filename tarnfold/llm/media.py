"""Media columns: content-addressed payloads in tar shards."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.common import new_path, settle
from tarnfold.tables import table

#: Bytes in a row of the image, so that a payload is whole rows; bytes after which a task begins a new shard.
WIDTH, SHARD_BYTES = 192, 128 << 20
LEVEL = 4
#: Bytes of the header that give an image's size, and of a tar block.
HEADER, BLOCK = 33, 512
#: Fixed value: the signature of the image format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _filesystem(uri: str):
    """A file system that Python on any machine can write to, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def to_image(payload: bytes) -> bytes:
    """The payload as a grey image of 8-bit samples, WIDTH wide, losslessly compressed."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def image_size(header: bytes) -> tuple[int, int]:
    if header[:8] != SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">II", header[16:24])


def from_image(media: bytes) -> bytes:
    width, rows = image_size(media[:HEADER])
    at, data = 8, b""
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("an image's checksum is wrong")
        if media[at + 4 : at + 8] == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes, width: int, rows: int) -> str:
    """Size, mean, deviation and a histogram over eight bands of the samples, in whole numbers."""
    samples = np.frombuffer(payload, np.uint8)
    total = int(samples.sum(dtype=np.int64))
    squares = int((samples.astype(np.int64) ** 2).sum())
    n = len(samples)
    bands = np.bincount(samples >> 5, minlength=8)
    return f"{width}x{rows};{1000 * total // n};{1000 * (n * squares - total * total) // (n * n)};" + ",".join(map(str, bands.tolist()))


def stored(docs: DataFrame, folder: str) -> DataFrame:
    """Write every whole text's payload to tar shards in `folder`: (doc_id, n_bytes, digest, shard, offset, length).

    Payloads are named by the digest of their bytes and stored once a task. A task's shards have names of their own,
    so one that runs again never overwrites another's, and rows point only to shards of tasks that ended; shards of
    lost tasks are never read. A null text is an empty one. `folder` is a URI that Python can write to everywhere.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        seen: dict[bytes, tuple[str, int, int]] = {}
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for text in batch.column("text"):
                    payload = payload_of(text := text.as_py())
                    digest = hashlib.sha256(payload).digest()
                    if digest not in seen:
                        media = to_image(payload)
                        if out is None or at > SHARD_BYTES:
                            if out is not None:
                                out.write(bytes(2 * BLOCK))
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.tar", 0
                            files.create_dir(root, recursive=True)
                            out = files.open_output_stream(f"{root}/{name}")
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(media)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % BLOCK))
                        seen[digest] = (name, at + BLOCK, len(media))
                        at += BLOCK + len(media) + -len(media) % BLOCK
                    rows.append((len((text or "").encode("utf-8", "surrogatepass")), digest, *seen[digest]))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols, kinds)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(bytes(2 * BLOCK))
                out.close()

    return docs.select("doc_id", "text").mapInArrow(write, f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long")


def headers(objects: DataFrame, folder: str) -> DataFrame:
    """`objects` (digest, shard, offset, length) plus width and height, from range reads of the headers alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        name, f = None, None
        for batch in batches:
            sizes = []
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                if shard != name:
                    name, f = shard, files.open_input_file(f"{root}/{shard}")
                sizes.append(image_size(f.read_at(HEADER, offset)))
            cols = list(zip(*sizes, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("digest", "shard", "offset", "length")), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32())], names=["digest", "shard", "offset", "length", "width", "height"])

    return objects.select("digest", "shard", "offset", "length").mapInArrow(read, "digest binary, shard string, offset long, length long, width int, height int")


READ = "digest binary, shard string, offset long, length long, payload_bytes long, tail_crc32 long, media_bytes long, media_digest binary, feature string, width int, height int"


def features(objects: DataFrame, folder: str) -> DataFrame:
    """Payloads of `objects` (with width and height) read back, and what is computed from them; one object is held at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        name, f = None, None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["shard"] != name:
                    name, f = x["shard"], files.open_input_file(f"{root}/{x['shard']}")
                media = f.read_at(x["length"], x["offset"])
                payload = from_image(media)
                if hashlib.sha256(payload).digest() != x["digest"]:
                    raise ValueError(f"{name} at {x['offset']} is not what its name says")
                rows.append((x["digest"], x["shard"], x["offset"], x["length"], len(payload), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).digest(), feature_of(payload, x["width"], x["height"]), x["width"], x["height"]))
            kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int32())
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols, kinds)), names=[c.split()[0] for c in READ.split(", ")])

    return objects.mapInArrow(read, READ)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store, index, read back: one row a document with its reference and what was read from the store.

    Rows of equal texts point to one object, the first by shard and offset, whichever task stored it. Objects are
    read a shard at a time. Null and empty texts are a row of blanks; repeated rows stay; no rows give none.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "media")
    rows = settle(stored(docs, folder), "refs")
    place = F.min(F.struct("shard", "offset", "length"))
    objects = rows.groupBy("digest").agg(place.alias("at")).select("digest", "at.*")
    objects = objects.repartition("shard").sortWithinPartitions("shard", "offset")
    read = settle(features(headers(objects, folder), folder), "read")
    out = rows.select("doc_id", "n_bytes", "digest").join(read, "digest")
    text = lambda c: F.lower(F.hex(c))
    return out.withColumns({"payload_sha256": text("digest"), "media_sha256": text("media_digest")}).drop("digest", "media_digest")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height")
