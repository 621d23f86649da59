"""Archives that split: zip members and npz arrays as data sources, read by seeking.

The driver reads the directories of the archives, as Spark lists files; each task then opens an archive itself, seeks to
what its partition holds, and reads nothing else. So an archive may have any size and is read by as many tasks as it has
ranges, and members are chosen before any of their bytes is read. Paths are local or URIs that pyarrow's file systems open.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES, PART_BYTES, ROWS = 64 << 20, 256 << 20, 1 << 18


def opened(path: str):
    """A file that can seek."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def listed(path: str, suffix: str) -> list[str]:
    """The file, or the files below a folder that end in ``suffix``, in order; paths are separated by line feeds."""
    from pyarrow import fs

    out: list[str] = []
    for one in path.split("\n"):
        system, inner = fs.FileSystem.from_uri(one) if "://" in one or one.startswith("file:") else (fs.LocalFileSystem(), one)
        head = one[: len(one) - len(inner)] if one.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(inner, recursive=True))
            out += sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))
        elif info.type == fs.FileType.File:
            out.append(one)
        else:
            raise FileNotFoundError(one)
    return out


@dataclass
class Member:
    """What the directory of an archive says of a file in it."""

    name: str
    at: int
    packed: int
    size: int
    method: int
    crc: int


def members(path: str) -> list[Member]:
    """The files of an archive, from its directory alone."""
    with opened(path) as f, zipfile.ZipFile(f) as z:
        return [Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in z.infolist() if not i.is_dir()]


def data_at(f, member: Member) -> int:
    """Where the bytes of a member begin: behind its own header, whose length the directory does not tell."""
    f.seek(member.at)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name}: no header at {member.at}")
    return member.at + 30 + sum(struct.unpack("<HH", head[26:30]))


def streamed(f, member: Member, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a member in pieces, checked against its checksum at the end."""
    if member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{member.name}: compression method {member.method}")
    f.seek(data_at(f, member))
    left, crc = member.packed, 0
    inflate = zlib.decompressobj(-15) if member.method == zipfile.ZIP_DEFLATED else None
    while left:
        data = f.read(min(step, left))
        if not data:
            raise EOFError(member.name)
        left -= len(data)
        while data:
            out = inflate.decompress(data, step) if inflate else data
            data = inflate.unconsumed_tail if inflate else b""
            crc = zlib.crc32(out, crc)
            if out:
                yield out
    if inflate and (out := inflate.flush()):
        crc = zlib.crc32(out, crc)
        yield out
    if crc != member.crc:
        raise ValueError(f"{member.name}: its checksum differs")


@dataclass
class ZipRange(InputPartition):
    archive: str
    held: list[Member]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = listed(options["path"], ".zip")
        self.suffixes = tuple(s for s in options.get("suffixes", "").split("\n") if s)
        self.contains = [s for s in options.get("contains", "").split("\n") if s]
        self.range_bytes, self.part_bytes = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("partBytes", PART_BYTES))
        self.content = options.get("content", "true") == "true"

    def chosen(self, name: str) -> bool:
        return (not self.suffixes or name.lower().endswith(self.suffixes)) and (not self.contains or any(c in name for c in self.contains))

    def partitions(self) -> list[ZipRange]:
        out = []
        for archive in self.paths:
            held, size = [], 0
            for m in sorted((m for m in members(archive) if self.chosen(m.name)), key=lambda m: m.at):
                if held and size + m.packed > self.range_bytes:
                    out.append(ZipRange(archive, held))
                    held, size = [], 0
                held.append(m)
                size += m.packed
            if held:
                out.append(ZipRange(archive, held))
        return out

    def read(self, partition: ZipRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("length", pa.int64()), ("part", pa.int32()), ("content", pa.binary())])
        rows: list[tuple] = []
        size = 0

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        with opened(partition.archive) as f:
            for m in partition.held:
                part, waiting, held = 0, [], 0
                for data in streamed(f, m) if self.content else ():
                    waiting.append(data)
                    held += len(data)
                    if held >= self.part_bytes:
                        whole = b"".join(waiting)
                        for at in range(0, held - held % self.part_bytes, self.part_bytes):
                            rows.append((partition.archive, m.name, m.size, part, whole[at : at + self.part_bytes]))
                            yield taken()
                            rows, size, part = [], 0, part + 1
                        waiting, held = [whole[held - held % self.part_bytes :]], held % self.part_bytes
                if held or part == 0:
                    rows.append((partition.archive, m.name, m.size, part, b"".join(waiting) if self.content else None))
                    size += held + 64
                if size >= self.range_bytes:
                    yield taken()
                    rows, size = [], 0
        if rows:
            yield taken()


class ZipSource(DataSource):
    """Format ``zip_members``; options path, suffixes and contains (separated by line feeds), content, rangeBytes, partBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, length long, part int, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


@dataclass
class NpzRange(InputPartition):
    archive: str
    cond: str
    arrays: dict[str, Member]
    start: int
    stop: int


def _header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape and type of an array, and the length of its header, from its first bytes."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if dtype.hasobject or fortran and len(shape) > 1:
        raise ValueError("an array of objects, or by columns")
    return shape, dtype, f.tell()


def sliced(f, member: Member, start: int, stop: int) -> np.ndarray:
    """Elements of a one-dimensional array. Of a stored member only their bytes are read, a packed one is unpacked up to them."""
    import io

    if member.method == zipfile.ZIP_STORED:
        begin = data_at(f, member)
        f.seek(begin)
        _, dtype, head = _header(io.BytesIO(f.read(min(member.size, 1 << 12))))
        f.seek(begin + head + start * dtype.itemsize)
        return np.frombuffer(f.read((stop - start) * dtype.itemsize), dtype)
    got, dtype, head, need = bytearray(), None, 0, 1 << 62
    for data in streamed(f, member):
        got += data
        if dtype is None and len(got) >= min(member.size, 1 << 12):
            _, dtype, head = _header(io.BytesIO(bytes(got[: 1 << 12])))
            need = head + stop * dtype.itemsize
        if len(got) >= need:
            break
    return np.frombuffer(bytes(got[head + start * dtype.itemsize : head + stop * dtype.itemsize]), dtype)


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.prefix = listed(options["path"], ".npz"), options.get("prefix", "score_")
        self.conditions = {c for c in options.get("conditions", "").split("\n") if c}
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> list[NpzRange]:
        import io

        out = []
        for archive in self.paths:
            held = {m.name.removesuffix(".npy"): m for m in members(archive)}
            with opened(archive) as f:
                head = next(streamed(f, held["labels"], 1 << 12))
            n = _header(io.BytesIO(head))[0][0]
            side = {k: held[k] for k in ("labels", "paths", "generators") if k in held}
            for name in sorted(k for k in held if k.startswith(self.prefix)):
                cond = name[len(self.prefix) :]
                if not self.conditions or cond in self.conditions:
                    step = self.rows if held[name].method == zipfile.ZIP_STORED else max(n, 1)
                    out += [NpzRange(archive, cond, side | {"score": held[name]}, at, min(n, at + step)) for at in range(0, n, step)]
        return out

    def read(self, p: NpzRange) -> Iterator[pa.RecordBatch]:
        with opened(p.archive) as f:
            for at in range(p.start, p.stop, 65536):
                stop = min(p.stop, at + 65536)
                got = {k: sliced(f, m, at, stop) for k, m in p.arrays.items()}
                text = lambda k: pa.array(got[k].astype(str).tolist() if k in got else [""] * (stop - at), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.archive] * (stop - at)), pa.array(np.arange(at, stop)), text("paths"), pa.array(got["labels"].astype(np.int32)), text("generators"), pa.array([p.cond] * (stop - at)), pa.array(got["score"].astype(float))],
                    ["archive", "row", "path", "label", "generator", "cond", "score"],
                )


class NpzSource(DataSource):
    """Format ``npz_scores``; options path, prefix, conditions (separated by line feeds) and rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "npz_scores"

    def schema(self) -> str:
        return "archive string, row long, path string, label int, generator string, cond string, score double"

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)


def _joined(paths: str | list[str]) -> str:
    return paths if isinstance(paths, str) else "\n".join(paths)


def read_zip(spark: SparkSession, paths: str | list[str], suffixes: tuple[str, ...] = (), contains: tuple[str, ...] = (), content: bool = True, **options: int) -> DataFrame:
    """archive, member, length, part and content of the files in archives whose names end and read as asked.

    A member of more than ``partBytes`` has several rows, numbered by part; others have one, part 0.
    """
    spark.dataSource.register(ZipSource)
    reader = spark.read.format("zip_members").option("path", _joined(paths)).option("suffixes", "\n".join(suffixes)).option("contains", "\n".join(contains)).option("content", str(content).lower())
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def read_scores(spark: SparkSession, paths: str | list[str], prefix: str = "score_", conditions: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Score archives (npz with labels, score_<condition> and, if there, paths and generators) to rows
    (archive, row, path, label, generator, cond, score); conditions that are not asked for are not read."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz_scores").option("path", _joined(paths)).option("prefix", prefix).option("conditions", "\n".join(conditions)).option("rows", str(rows)).load()


def wanted(members: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members that a manifest (path) names, and the paths that no archive has."""
    names = members.withColumnRenamed("member", "path")
    return names.join(manifest.select("path").distinct(), "path", "left_semi"), manifest.select("path").distinct().join(names, "path", "left_anti")


def not_yet(members: DataFrame, done: DataFrame) -> DataFrame:
    """Members that a table of extracted ones (archive, member) does not have: a rerun skips the others."""
    return members.join(done.select("archive", "member").distinct(), ["archive", "member"], "left_anti")
