"""Media columns: content-addressed payloads in tar shards.

A payload is stored once, as an 8-bit grey PNG named by its SHA-256, in a tar shard in the shared folder. Rows carry digest,
shard, offset and length; header-only range reads (33 bytes) fill width, height and bit depth; whole reads give the samples.

Payloads whose digest is in one row alone are stored by the task that reads them, without a shuffle. A bit table of fixed
size, filled from the digests that repeat, tells them apart; a false hit only sends a payload through the other
path, where copies meet by partial aggregation before the shuffle, so a payload of a third of all rows is no single task.

A shard's name holds its task's attempt, and the index, a written table, holds only rows of attempts that Spark committed: a
task that runs twice never meets the other's file, and files that no index row names are left over and unread.

Defined results: a null or empty text is 64 zero bytes; equal texts share one stored payload and get equal values; repeated
rows stay repeated; an empty table writes no shard. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_table, in_table, scratch, table, written

WIDTH = 64
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and IHDR


def png_encode(samples: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """An 8-bit grey PNG with ``width`` samples in a row; losslessly the bytes given."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)  # filter 0 before each row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first bytes of a PNG."""
    if data[:8] != PNG_SIGNATURE or data[12:16] != b"IHDR" or struct.unpack(">I", data[29:33])[0] != zlib.crc32(data[12:29]):
        raise ValueError("no PNG header")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return width, height, depth


def png_decode(data: bytes) -> bytes:
    """The samples of a PNG that ``png_encode`` wrote; checksums are verified."""
    width, height, _ = png_header(data)
    at, packed = 33, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are written here")
    return lines[:, 1:].tobytes()


def padded(text: Column) -> Column:
    """The UTF-8 bytes of a text and zero bytes up to a positive multiple of the width."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.length(data)
    fill = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(data, F.encode(F.repeat(F.lit("\0"), fill), "UTF-8"))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def store(keyed: DataFrame, path: str, digests: DataFrame | None = None) -> DataFrame:
    """Every distinct (digest, payload) of ``keyed`` in tar shards under ``path``; the index. ``digests``: the digest of every
    row, where a narrower table than ``keyed`` has it."""
    repeated = (keyed if digests is None else digests).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = bit_table(repeated.select(F.xxhash64("digest").alias("h")), "h")
    rows = keyed.select("digest", "payload", F.xxhash64("digest").alias("h"))

    def part(hit: bool) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                keep = in_table(bits.value, batch.column(2).to_numpy()) == hit
                yield pa.record_batch([batch.column(0), batch.column(1)], ["digest", "payload"]).filter(pa.array(keep))

        return rows.mapInArrow(run, "digest binary, payload binary")

    alone = write_shards(part(False), path, "single")
    shared = write_shards(part(True).groupBy("digest").agg(F.first("payload").alias("payload")), path, "shared")
    return alone.unionByName(shared)


def write_shards(payloads: DataFrame, path: str, prefix: str = "shard") -> DataFrame:
    """One tar shard per partition of (digest, payload); the index digest, shard, offset, length as a written table."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        system, root = _filesystem(path)
        task = TaskContext.get()
        name = f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}.tar"
        sink = None
        at = 0
        for batch in batches:
            rows = []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sink is None:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(f"{root}/{name}")
                data = png_encode(payload)
                info = tarfile.TarInfo(digest.hex() + ".png")
                info.size = len(data)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                sink.write(head + data + b"\0" * (-len(data) % 512))
                rows.append((digest, name, at + len(head), len(data)))
                at += len(head) + len(data) + (-len(data) % 512)
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["digest", "shard", "offset", "length"])
        if sink is not None:
            sink.write(b"\0" * 1024)
            sink.close()

    index = payloads.mapInArrow(run, "digest binary, shard string, offset long, length long")
    return written(index, "media-index")


def _reader(path: str):
    """A function of (shard, offset, length) to bytes, with the last shard held open."""
    system, root = _filesystem(path)
    held: dict[str, object] = {}

    def read(shard: str, offset: int, length: int) -> bytes:
        if shard not in held:
            for f in held.values():
                f.close()
            held.clear()
            held[shard] = system.open_input_file(f"{root}/{shard}")
        return held[shard].read_at(length, offset)

    return read


def header_columns(index: DataFrame, path: str) -> DataFrame:
    """width, height and bit_depth for every index row, from range reads of the header bytes alone."""

    def run(batches: Iterator) -> Iterator:
        read = _reader(path)
        for rows in batches:
            found = [png_header(read(s, o, HEADER_BYTES)) for s, o in zip(rows["shard"], rows["offset"], strict=True)]
            w, h, d = zip(*found, strict=True) if found else ((), (), ())
            yield rows.assign(width=list(w), height=list(h), bit_depth=list(d))

    return index.sortWithinPartitions("shard", "offset").mapInPandas(run, "digest binary, shard string, offset long, length long, width long, height long, bit_depth int")


def feature(samples: bytes) -> str:
    """Sample count, mean in millionths, and a 16-bin histogram, in whole numbers."""
    x = np.frombuffer(samples, np.uint8)
    return f"n={len(x)};mean_e6={int(x.sum(dtype=np.int64)) * 1_000_000 // len(x)};hist16={','.join(map(str, np.bincount(x >> 4, minlength=16).tolist()))}"


def stored_features(indexed: DataFrame, path: str) -> DataFrame:
    """What the stored bytes say, per digest: lengths, hashes and the feature; the digest is verified."""

    def run(batches):
        import pyarrow as pa

        read = _reader(path)
        for batch in batches:
            rows = []
            for digest, shard, offset, length, width, height in zip(*[batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "width", "height")], strict=True):
                data = read(shard, offset, length)
                samples = png_decode(data)
                if hashlib.sha256(samples).digest() != digest or len(samples) != width * height:
                    raise ValueError(f"{shard} at {offset} differs from its digest or header")
                rows.append((digest, len(samples), digest.hex(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return indexed.mapInArrow(run, "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select("doc_id", F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("n_bytes"), padded(F.col("text")).alias("payload"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    rows = written(keyed.select("doc_id", "n_bytes", "digest"), "media-rows")
    path = scratch(spark, "media")
    index = store(keyed, path, rows)
    found = stored_features(header_columns(index, path), path)
    return rows.join(found, "digest").drop("digest")
