"""ZIP archives as a data source: ``spark.read.format("zip_members")`` and ``spark.readStream.format("zip_members")``.

    archives.register(spark)
    spark.read.format("zip_members").option("path", "file:///exports").load().where("member like '%.json'")

A partition is a range of one archive's central directory, or several small archives together, so one large archive is
many tasks. Planning reads each archive's last bytes only (the number of its members); tasks read the directory, seek to the
members they need and stream them. Conditions on the suffix of members or on the archive are pushed into the reader
(``spark.sql.python.filterPushdown.enabled``, which ``register`` sets), so other members aren't opened.

In a stream an offset is the newest archives seen, by time of writing and name; a batch is the archives after it.

Options: ``path`` (a folder, or a file), ``contents`` (true: bytes in ``content``, else null), ``members`` (of a partition, 2,000).
Rows: archive, member, header_offset, size, crc, source_size, mtime_ns, content. Folders in an archive, and names that lead out of
it, are left out. An archive that changes between planning and reading, or while it is read, is an error; so is a broken one.
"""

from __future__ import annotations

import struct
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringEndsWith

SCHEMA = "archive string, member string, header_offset long, size long, crc long, source_size long, mtime_ns long, content binary"
MEMBERS, ARCHIVES = 2000, 64


@dataclass(frozen=True)
class Piece:
    """Members ``first`` to ``last`` of an archive as it was when it was planned."""

    path: str
    size: int
    mtime_ns: int
    first: int
    last: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _listed(path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of writing) of the archives in a folder, or of one archive; by time, then name."""
    from pyarrow import fs

    system, inner = _system(path)
    root = path.removesuffix(inner)
    found = system.get_file_info(inner)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True)) if found.type == fs.FileType.Directory else [found]
    return sorted(((root + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip")), key=lambda f: (f[2], f[0]))


def _count(path: str, size: int) -> int:
    """The number of an archive's members, from its last bytes."""
    system, inner = _system(path)
    with system.open_input_file(inner) as file:
        file.seek(max(0, size - 65_557))
        tail = file.read()
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError(f"{path} has no directory")
    n = struct.unpack("<H", tail[at + 10 : at + 12])[0]
    wide = tail.rfind(b"PK\x06\x06", 0, at)
    return struct.unpack("<Q", tail[wide + 32 : wide + 40])[0] if n == 0xFFFF and wide >= 0 else n


def _planned(found: list[tuple[str, int, int]], members: int) -> list[Pieces]:
    out, small, held = [], [], 0
    for path, size, mtime in found:
        n = _count(path, size)
        if n == 0:
            continue
        if n > members:
            out += [Pieces([Piece(path, size, mtime, a, min(n, a + members))]) for a in range(0, n, members)]
            continue
        if small and (held + n > members or len(small) == ARCHIVES):
            out.append(Pieces(small))
            small, held = [], 0
        small.append(Piece(path, size, mtime, 0, n))
        held += n
    return [*out, Pieces(small)] if small else out


def _same(piece: Piece) -> None:
    system, inner = _system(piece.path)
    now = system.get_file_info(inner)
    if (now.size, now.mtime_ns or 0) != (piece.size, piece.mtime_ns):
        raise RuntimeError(f"{piece.path} changed while it was read")


def _read(pieces: Pieces, suffixes: list[str], contents: bool) -> Iterator[tuple]:
    for piece in pieces.pieces:
        _same(piece)
        system, inner = _system(piece.path)
        with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
            for m in archive.infolist()[piece.first : piece.last]:
                if not m.is_dir() and ".." not in m.filename.split("/") and all(m.filename.endswith(s) for s in suffixes):
                    yield piece.path, m.filename, m.header_offset, m.file_size, m.CRC, piece.size, piece.mtime_ns, archive.read(m) if contents else None
        _same(piece)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.contents, self.members = options["path"], str(options.get("contents", "false")).lower() == "true", int(options.get("members", MEMBERS))
        self.suffixes: list[str] = []
        self.archives: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringEndsWith) and f.attribute == ("member",):
                self.suffixes.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("archive",):
                self.archives = ({f.value} if self.archives is None else self.archives & {f.value})
            else:
                yield f

    def partitions(self) -> list[Pieces]:
        found = [f for f in _listed(self.path) if self.archives is None or f[0] in self.archives]
        return _planned(found, self.members) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        return _read(partition, self.suffixes, self.contents)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.contents, self.members = options["path"], str(options.get("contents", "false")).lower() == "true", int(options.get("members", MEMBERS))

    def initialOffset(self) -> dict:
        return {"mtime_ns": -1, "paths": []}

    def latestOffset(self) -> dict:
        found = _listed(self.path)
        newest = found[-1][2] if found else -1
        return {"mtime_ns": newest, "paths": [p for p, _, t in found if t == newest]}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        after = lambda p, t: t > start["mtime_ns"] or (t == start["mtime_ns"] and p not in start["paths"])
        until = lambda p, t: t < end["mtime_ns"] or (t == end["mtime_ns"] and p in end["paths"])
        return _planned([f for f in _listed(self.path) if after(f[0], f[2]) and until(f[0], f[2])], self.members)

    def read(self, partition: Pieces) -> Iterator[tuple]:
        return _read(partition, [], self.contents)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known; its code travels with it, so no worker needs this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)


def write_archives(rows, folder: str, count: int, name: str = "name", content: str = "content", prefix: str = "part") -> None:
    """Writes rows (name, content) as members of ``count`` archives under a folder, each by one task and moved to its place when whole."""
    from pyspark.sql import functions as F

    def pack(batches):
        import uuid

        import pandas as pd

        open_: dict[int, tuple] = {}
        for batch in batches:
            for at, member, data in zip(batch["at"], batch["name"], batch["content"], strict=True):
                if at not in open_:
                    system, inner = _system(folder)
                    system.create_dir(inner, recursive=True)
                    beside = f"{inner}/.{uuid.uuid4().hex}"
                    stream = system.open_output_stream(beside)
                    open_[at] = (system, beside, f"{inner}/{prefix}-{at:05d}.zip", stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED))
                open_[at][4].writestr(zipfile.ZipInfo(member), data, zipfile.ZIP_DEFLATED)
        for at, (system, beside, target, stream, archive) in open_.items():
            archive.close()
            stream.close()
            system.move(beside, target)
            yield pd.DataFrame({"at": [at]})

    dealt = rows.select(F.pmod(F.xxhash64(name), F.lit(count)).cast("int").alias("at"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    dealt.repartition(count, "at").sortWithinPartitions("at", "name").mapInPandas(pack, "at int").write.format("noop").mode("overwrite").save()
