"""Media columns: archives of media members, read by byte ranges through a custom source.

Writing: every task streams its rows into ZIP archives (members stored as they are, at most
``archive_bytes`` each) in a folder; a manifest names the archives of the attempts that
succeeded. Reading: the data source ``caravel_archive`` plans byte ranges over those archives from
their sizes alone. A task reads the directory at the end of its archive, takes the members that
begin within its range, and streams them as Arrow batches. Each member is read by its own
offset and checked by its CRC; a failure is retried for that member, on a fresh
handle, without the ones before it.

Nothing is shuffled or collected; planning holds one entry per archive, and a task the
directory of one archive and one batch.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_path

BLOCK = 576
PNG = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest"
_LOCAL = struct.Struct("<4s5H3L2H")
MEMBER = T.StructType([T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("name", T.StringType()), T.StructField("key", T.StringType()), T.StructField("payload", T.BinaryType())])
_MEMBER = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("key", pa.string()), ("payload", pa.binary())])


# --- lossless 8-bit samples -------------------------------------------------------------


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """``data`` with bytes 255 behind it, up to a positive multiple of ``block``."""
    return data + b"\xff" * (max(block, -(-len(data) // block) * block) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">L", len(body)) + kind + body + struct.pack(">L", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int, width: int = BLOCK, level: int = 4) -> bytes:
    """An 8-bit grey image whose samples are the payload, row by row; ``n_bytes`` is noted in a text chunk."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    rows = np.zeros((len(samples), width + 1), np.uint8)  # filter 0 in front of each row
    rows[:, 1:] = samples
    head = struct.pack(">LLBBBBB", width, len(samples), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """(payload, n_bytes) of an image that ``to_png`` made; every chunk is checked."""
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    at, width, parts, n_bytes = 8, 0, [], -1
    while at < len(data):
        (n,) = struct.unpack_from(">L", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">L", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width, _, depth, color, *rest = struct.unpack(">LLBBBBB", body)
            if (depth, color, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("only plain 8-bit grey images are supported")
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are supported")
    return rows[:, 1:].tobytes(), n_bytes


def features(payload: bytes) -> str:
    """Mean, deviation, entropy (thousandths) and share of each sixteenth of the sample range (per mille)."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    bands = counts.reshape(16, 16).sum(axis=1) * 1000 // len(samples)
    numbers = [round(float(samples.mean()) * 1000), round(float(samples.std()) * 1000), round(float(-(p * np.log2(p)).sum()) * 1000), *bands.tolist()]
    return ":".join(map(str, numbers))


# --- archives ------------------------------------------------------------------------------


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_archives(df: DataFrame, folder: str, key_col: str, bytes_col: str, name_suffix: str = "", archive_bytes: int = 64 << 20) -> None:
    """Writes one member per row; the key travels as text in the member's comment (null: none).

    Archives of failed or repeated attempts aren't in the manifest, so they are never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        done: list[tuple[str, int, int]] = []
        held: tuple | None = None
        row = 0

        def close() -> None:
            nonlocal held
            name, out, archive, n = held
            archive.close()
            size = out.tell()
            out.close()
            done.append((name, size, n))
            held = None

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(f"{root}/{name}")
                    held = (name, out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True), 0)
                info = zipfile.ZipInfo(f"{row:09d}{name_suffix}", (1980, 1, 1, 0, 0, 0))
                info.comment = b"" if key is None else b"=" + key.encode()
                held[2].writestr(info, data)
                held = (*held[:3], held[3] + 1)
                row += 1
                if held[1].tell() >= archive_bytes:
                    close()
        if held is not None:
            close()
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["archive", "bytes", "members"])

    rows = df.select(F.col(f"`{key_col}`").cast("string"), F.col(f"`{bytes_col}`"))
    rows.mapInArrow(write, "archive string, bytes long, members long").write.parquet(f"{folder}/{MANIFEST}")


def read_member(fs: pafs.FileSystem, path: str, info: zipfile.ZipInfo, attempts: int = 3, pause: float = 0.2) -> bytes:
    """The bytes of one stored member by its offset; a failed read is tried again on a fresh handle."""
    for attempt in range(attempts):
        try:
            with fs.open_input_file(path) as f:
                f.seek(info.header_offset)
                head = f.read(_LOCAL.size)
                mark, *_, name_bytes, extra_bytes = _LOCAL.unpack(head)
                if mark != b"PK\x03\x04" or info.compress_type != zipfile.ZIP_STORED:
                    raise OSError(f"no stored member at {info.header_offset} of {path}")
                f.seek(info.header_offset + _LOCAL.size + name_bytes + extra_bytes)
                data = f.read(info.file_size)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise OSError(f"damaged member at {info.header_offset} of {path}")
            return data
        except (OSError, struct.error) as e:
            if attempt == attempts - 1:
                raise OSError(f"{info.filename} at {info.header_offset} of {path}: {e}") from e
            time.sleep(pause * 2**attempt)
    raise AssertionError


class ByteRange(InputPartition):
    """Members of ``archive`` whose header begins in [low, high)."""

    def __init__(self, archive: str, low: int, high: int) -> None:
        self.archive, self.low, self.high = archive, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 8 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[ByteRange]:
        import pyarrow.dataset as ds

        fs, root = _open(self.folder)
        found: list[tuple[str, int]] = []
        listed = fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True))
        if listed:
            files = [x.path for x in listed if x.is_file and x.path.endswith(".parquet")]
            if files:
                table = ds.dataset(files, filesystem=fs, format="parquet").to_table(["archive", "bytes"])
                found = list(zip(table["archive"].to_pylist(), table["bytes"].to_pylist(), strict=True))
        else:
            found = [(x.base_name, x.size) for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.is_file and x.base_name.endswith(".zip")]
        ranges = [ByteRange(name, low, min(low + self.range_bytes, size)) for name, size in sorted(found) for low in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = _open(self.folder)
        path = f"{root}/{partition.archive}"
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.low <= m.header_offset < partition.high]
        rows: list[tuple] = []
        held = 0
        for m in members:
            data = read_member(fs, path, m, self.attempts)
            rows.append((partition.archive, m.header_offset, m.filename, m.comment[1:].decode() if m.comment else None, data))
            held += len(data)
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MEMBER)], schema=_MEMBER)


class ArchiveSource(DataSource):
    """``spark.read.format("caravel_archive").load(folder)``; options rangeBytes, batchBytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return "caravel_archive"

    def schema(self) -> T.StructType:
        return MEMBER

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Members of the archives in ``folder``: archive, offset, name, key, payload. None: an empty table."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("caravel_archive").options(**options).load(folder)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> str:
    """Stores every text as a PNG member (null as empty) and returns the folder."""
    folder = folder or fresh_path(df.sparkSession, "media")

    @F.arrow_udf(T.BinaryType())
    def image(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            data = (t or "").encode("utf-8", "surrogatepass")
            out.append(to_png(padded(data), len(data)))
        return pa.array(out, pa.binary())

    rows = df.select(F.col(f"`{id_col}`").alias("k"), image(F.col(f"`{text_col}`").cast("string")).alias("b"))
    write_archives(rows, folder, "k", "b", ".png")
    return folder


FACTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def facts_of(media: bytes) -> tuple:
    payload, n_bytes = from_png(media)
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)


def media_facts(members: DataFrame, out: str = "facts") -> DataFrame:
    """Adds what the stored bytes of each member hold, all computed from the bytes read back."""

    @F.arrow_udf(FACTS)
    def facts(batch: pa.Array) -> pa.Array:
        rows = [facts_of(m) for m in batch.to_pylist()]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], FACTS.names)

    return members.withColumn(out, facts("payload"))


def media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents`` stored as images, read back by byte ranges."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    members = read_archives(spark, store_texts(docs))
    return media_facts(members.select("key", "payload")).select(F.col("key").cast(kind).alias("doc_id"), "facts.*")


def scrap(data: bytes) -> list[str]:
    """Member names of an archive given as bytes (for tests)."""
    return zipfile.ZipFile(io.BytesIO(data)).namelist()
