"""Binary vector matrices (.vecs) as a data source, read and written by ranges of rows.

Layout, little-endian: 8 bytes of magic, u32 version, u32 dimension, u64 count, u32 flags (bit 0: ids follow), u32 CRC-32
of the 28 bytes before; count * dimension floats by rows; then count u64 ids if flagged.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import CorruptionError, InvalidArgumentError, UnsupportedVersionError
from ..plans.options import MAX_DIMENSION

# fixed values of the format
MAGIC, VERSION, HEADER, HAS_IDS = b"VDBDATA\0", 1, 32, 1
#: Bytes of one partition of a read.
PART_BYTES = 64 << 20


class Header(NamedTuple):
    dimension: int
    count: int
    has_ids: bool

    @property
    def size(self) -> int:
        return HEADER + self.count * (4 * self.dimension + 8 * self.has_ids)

    def pack(self) -> bytes:
        head = struct.pack("<8sIIQI", MAGIC, VERSION, self.dimension, self.count, HAS_IDS if self.has_ids else 0)
        return head + struct.pack("<I", zlib.crc32(head))


def local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def read_header(path: str) -> Header:
    """The header, checked against itself and against the size of the file; no vector is read."""
    path = local(path)
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        raw = f.read(HEADER)
    if len(raw) < HEADER:
        raise CorruptionError(f"{path} has {size} bytes, fewer than a header")
    magic, version, dimension, count, flags, crc = struct.unpack("<8sIIQII", raw)
    if magic != MAGIC:
        raise CorruptionError(f"{path} begins with {magic!r}; is it a .vecs file?")
    if version != VERSION:
        raise UnsupportedVersionError(path, version, VERSION)
    if crc != zlib.crc32(raw[:-4]):
        raise CorruptionError(f"{path}: the header does not match its checksum")
    if not 1 <= dimension <= MAX_DIMENSION:
        raise CorruptionError(f"{path}: dimension {dimension} is not in [1, {MAX_DIMENSION}]")
    out = Header(dimension, count, bool(flags & HAS_IDS))
    if out.size != size:
        raise CorruptionError(f"{path} has {size} bytes, its header describes {out.size}: " + ("it is truncated" if size < out.size else "data follow its end"))
    return out


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class VecsReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = local(path), part_bytes
        self.header = read_header(self.path)

    def partitions(self) -> list[_Range]:
        rows = max(1, self.part_bytes // (4 * self.header.dimension))
        return [_Range(i, min(i + rows, self.header.count)) for i in range(0, self.header.count, rows)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        h, step = self.header, max(1, (4 << 20) // (4 * self.header.dimension))
        with open(self.path, "rb") as f:
            for i in range(partition.first, partition.last, step):
                n = min(step, partition.last - i)
                f.seek(HEADER + 4 * h.dimension * i)
                data = np.fromfile(f, "<f4", n * h.dimension)
                ids = pa.nulls(n, pa.int64())
                if h.has_ids:
                    f.seek(HEADER + 4 * h.dimension * h.count + 8 * i)
                    raw = np.fromfile(f, "<u8", n)
                    if len(raw) and raw.max() >= 1 << 63:
                        raise CorruptionError(f"{self.path}: id {raw.max()} is beyond 2**63")
                    ids = pa.array(raw.astype(np.int64))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * h.dimension)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n)), ids, pa.ListArray.from_arrays(offsets, pa.array(data))], ["ordinal", "id", "embedding"])


class VecsSource(DataSource):
    """spark.read.format("vecs").load(path): ordinal, id (null if the file has none), embedding."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return "ordinal long, id long, embedding array<float>"

    def reader(self, schema) -> VecsReader:
        return VecsReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))


def read_vecs(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(VecsSource)
    return spark.read.format("vecs").load(path)


def write_vecs(df: DataFrame, path: str, ids: bool = True) -> None:
    """Write df (id, embedding) in the order of id. The file appears whole or not at all. One file is one stream, so
    rows pass the driver a partition at a time."""
    path = local(path)
    info = df.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count("id").alias("ids")).first()
    if info["n"] and info["low"] != info["high"]:
        raise InvalidArgumentError(f"vectors have dimensions {info['low']} to {info['high']}")
    if ids and info["ids"] != info["n"]:
        raise InvalidArgumentError(f"{info['n']} vectors but {info['ids']} ids")
    header = Header(info["high"] or 1, info["n"], ids)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(part, "wb") as f, open(part + ".ids", "w+b") as g:
            f.write(header.pack())
            for row in df.select("id", "embedding").orderBy("id").toLocalIterator():
                f.write(np.asarray(row["embedding"], "<f4").tobytes())
                if ids:
                    g.write(struct.pack("<Q", row["id"]))
            g.seek(0)
            while chunk := g.read(1 << 20):
                f.write(chunk)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        for p in (part, part + ".ids"):
            if os.path.exists(p):
                os.remove(p)
