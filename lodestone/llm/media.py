"""Media columns: documents as lossless images in archives, and a data source that reads archives by byte ranges."""

from __future__ import annotations

import hashlib
import re
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.session import durable, new_path

WIDTH, PAD = 576, 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """UTF-8 bytes, filled with 255 (which no UTF-8 text has) to whole rows of pixels, one at least."""
    return text + bytes([PAD]) * (-len(text) % WIDTH if text else WIDTH)


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of ``WIDTH`` pixels a row, without row filters: one sample a byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote; its checksums must hold."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("row filters aren't read")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy and mean step between neighbours of the samples, from whole-number sums."""
    x = np.frombuffer(payload, np.uint8)
    n, counts = len(x), np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = int(counts @ values) / n
    spread = (int(counts @ values**2) / n - mean**2) ** 0.5
    p = counts[counts > 0] / n
    step = int(np.abs(np.diff(x.astype(np.int16))).sum()) / n
    return f"mean={mean:.4f};deviation={spread:.4f};entropy={-(p * np.log2(p)).sum():.6f};step={step:.4f}"


def filesystem(path: str):
    """The Arrow file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", roll: int = 64 << 20) -> tuple[int, int, str]:
    """Writes each row as a member of an archive below ``path``; returns members, archives and a manifest.

    A task rolls to a new archive after ``roll`` bytes. An archive gets its name, the attempt in
    it, only once it is whole; the manifest (a table) names the archives of the attempts that
    count. So whatever an attempt that was lost or repeated has left is never read. Members
    aren't compressed again. Null texts count as empty, very long ones are one member, repeated
    rows are members of their own; a null id has no place in its member's name.
    """

    def batches(frames):
        store, root = filesystem(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        names, archive, out, seq = [], None, None, 0

        def name():
            return f"part-{part:06d}-{attempt}-{len(names):04d}.zip"

        def close():
            nonlocal archive
            archive.close()
            out.close()
            store.move(f"{root}/.{name()}.open", f"{root}/{name()}")
            names.append(name())
            archive = None

        for batch in frames:
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                if archive is None:
                    out = store.open_output_stream(f"{root}/.{name()}.open")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                member = zipfile.ZipInfo(f"{seq}-{doc.as_py()}.png" if doc.is_valid else f"{seq}.png")
                archive.writestr(member, to_png(payload_of(text.as_py() or b"")))
                seq += 1
                if out.tell() >= roll:
                    close()
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([names], pa.list_(pa.string()))], ["members", "names"])

    done = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(batches, "members long, names array<string>")
    kept: list[str] = []
    row = durable(done, "manifest", kept).agg(F.coalesce(F.sum("members"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.size("names")), F.lit(0)).alias("a")).first()
    return row["m"], row["a"], kept[0]


def manifest_names(path: str) -> list[list[str]]:
    """The lists of archives that the writing tasks have left."""
    import pyarrow.dataset as ds

    store, root = filesystem(path)
    return ds.dataset(root, filesystem=store, format="parquet").to_table(columns=["names"])["names"].to_pylist()


class ByteRange(InputPartition):
    """Members of one archive whose headers begin in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    """Plans byte ranges over a directory's archives; streams members as Arrow batches."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 8 << 20)))
        self.batch = int(options.get("batchbytes", options.get("batchBytes", 4 << 20)))
        self.attempts = int(options.get("attempts", 3))
        self.manifest = options.get("manifest")

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        store, root = filesystem(self.root)
        files = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        found = sorted((f.path, f.size) for f in files if f.path.endswith(".zip"))
        if self.manifest:
            # as many names as archives: what the listing has anyway
            listed = {n for names in manifest_names(self.manifest) for n in names}
            found = [(p, n) for p, n in found if p.rpartition("/")[2] in listed]
            if len(found) != len(listed):
                raise FileNotFoundError(f"{len(listed) - len(found)} archives of the manifest are missing in {root}")
        return [ByteRange(p, at, min(at + self.split, n)) for p, n in found for at in range(0, n, self.split)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = filesystem(self.root)
        rows, held = [], 0
        with store.open_input_file(part.path) as file, zipfile.ZipFile(file) as archive:
            members = sorted((m for m in archive.infolist() if part.start <= m.header_offset < part.end), key=lambda m: m.header_offset)
        file = None
        for m in members:
            data, file = self.member(store, part.path, m, file)
            rows.append((part.path, m.header_offset, m.filename, data))
            held += len(data)
            if held >= self.batch:
                yield self.frame(rows)
                rows, held = [], 0
        if rows:
            yield self.frame(rows)

    def member(self, store, path: str, m, file):
        """One member by its offset. A failed read opens the archive anew and takes this member alone again."""
        for attempt in range(self.attempts):
            try:
                file = file or store.open_input_file(path)
                file.seek(m.header_offset)
                head = file.read(30)
                if head[:4] != b"PK\x03\x04" or m.compress_type != zipfile.ZIP_STORED:
                    raise zipfile.BadZipFile(f"no stored member at {m.header_offset}")
                names, extra = struct.unpack("<HH", head[26:30])
                file.seek(m.header_offset + 30 + names + extra)
                data = file.read(m.compress_size)
                if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
                    raise zipfile.BadZipFile(f"the member at {m.header_offset} is damaged")
                return data, file
            except (OSError, zipfile.BadZipFile):
                file = None
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise ValueError("attempts must be at least 1")

    @staticmethod
    def frame(rows: list) -> pa.RecordBatch:
        path, offset, name, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(offset, pa.int64()), pa.array(name), pa.array(data, pa.binary())], ["archive", "offset", "name", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("archives").load(directory)``: archive, offset, name, media.

    Options: splitBytes (bytes of an archive for each task), batchBytes (payload for each
    Arrow batch), attempts (reads of one member before the task fails), manifest (a table of
    ``write_archives``: only its archives are read, and all of them must be there). A member that stays
    damaged fails its task rather than going missing; an empty or absent directory has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").options(**options).load(path)


def media_features(members: DataFrame, id_type: str = "long") -> DataFrame:
    """Digests and features of stored members, computed from the bytes read back."""

    def batches(frames):
        for batch in frames:
            rows = []
            for name, media in zip(batch.column(0), batch.column(1), strict=True):
                stored = media.as_py()
                payload = from_png(stored)
                sha = lambda b: hashlib.sha256(b).hexdigest()
                _, named, doc = name.as_py().removesuffix(".png").partition("-")
                rows.append((doc if named else None, len(payload.rstrip(bytes([PAD]))), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(stored), sha(stored), feature(payload)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return members.select("name", "media").mapInArrow(batches, schema).withColumn("id", F.col("id").cast(id_type))


def store_and_describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as media archives in the shared folder and describes what is read back.

    A row for each row, in no order: null texts as empty ones, null ids as null, long texts whole,
    repeated rows each; an empty table gives no row. An archive that goes missing fails the read.
    """
    spark = docs.sparkSession
    path = new_path(spark, "archives")
    _, _, manifest = write_archives(docs, path, id_col, text_col)
    return media_features(read_archives(spark, path, manifest=manifest), dict(docs.dtypes)[id_col]).withColumnRenamed("id", id_col)
