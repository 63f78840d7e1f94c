import os
import time
import zipfile

import pytest

from lodestrata.sources import archives


def pack(path, members, at=None):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    if at:
        os.utime(path, ns=(at, at))


def read(spark, path, **options):
    archives.register(spark)
    return spark.read.format("zip_members").options(path=str(path), **options).load()


def test_members_as_their_directory_lists_them(spark, tmp_path):
    pack(tmp_path / "a.zip", [("x/1.jpg", b"abc"), ("x/", b""), ("../out.jpg", b"no"), ("x/1.json", b"{}"), ("ü.JPG", b"")])
    pack(tmp_path / "empty.zip", [])
    (tmp_path / "note.txt").write_text("no archive")
    rows = read(spark, tmp_path).collect()
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        want = sorted((m.filename, m.header_offset, m.file_size, m.CRC) for m in z.infolist() if not m.is_dir() and ".." not in m.filename)
    assert sorted((r["member"], r["header_offset"], r["size"], r["crc"]) for r in rows) == want and all(r["content"] is None for r in rows)
    assert {r["member"]: bytes(r["content"]) for r in read(spark, tmp_path, contents="true").collect()} == {"x/1.jpg": b"abc", "x/1.json": b"{}", "ü.JPG": b""}
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").count() == 0


def test_one_large_archive_is_many_tasks_and_small_ones_are_few(spark, tmp_path):
    pack(tmp_path / "big.zip", [(f"m{i}", b"x") for i in range(1050)])
    assert read(spark, tmp_path / "big.zip", members="100").rdd.getNumPartitions() == 11
    assert read(spark, tmp_path / "big.zip", members="100").select("member").distinct().count() == 1050
    for i in range(30):
        pack(tmp_path / f"s{i}.zip", [("m", b"x")])
    assert read(spark, tmp_path, members="1050").rdd.getNumPartitions() == 2


def test_suffixes_are_pushed_into_the_reader(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringEndsWith

    pack(tmp_path / "a.zip", [("1.json", b"{}"), ("1.jpg", b"x")])
    pack(tmp_path / "b.zip", [("2.json", b"{}")])
    reader = archives._Reader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([StringEndsWith(("member",), ".json"), IsNotNull(("member",)), EqualTo(("archive",), f"{tmp_path}/b.zip")]))
    assert rest == [IsNotNull(("member",))] and [r[1] for p in reader.partitions() for r in reader.read(p)] == ["2.json"]
    assert sorted(r["member"] for r in read(spark, tmp_path).where("member like '%.json'").collect()) == ["1.json", "2.json"]
    assert read(spark, tmp_path).where(f"archive = '{tmp_path}/a.zip' and member like '%.json'").count() == 1


def test_changed_and_broken_archives_are_errors(spark, tmp_path):
    pack(tmp_path / "a.zip", [("1", b"x")])
    reader = archives._Reader({"path": str(tmp_path)})
    planned = reader.partitions()
    pack(tmp_path / "a.zip", [("1", b"xyz")])
    with pytest.raises(RuntimeError, match="changed"):
        list(reader.read(planned[0]))
    (tmp_path / "b.zip").write_bytes(b"not an archive")
    with pytest.raises(ValueError, match="no directory"):
        reader.partitions()


def test_a_stream_takes_each_archive_once(spark, tmp_path):
    source, out, now = tmp_path / "in", tmp_path / "out", time.time_ns() - 10**12
    source.mkdir()
    archives.register(spark)

    def run():
        rows = spark.readStream.format("zip_members").option("path", str(source)).load().select("member")
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "seen")).option("path", str(out)).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["member"] for r in spark.read.parquet(str(out)).collect())

    pack(source / "b.zip", [("b1", b""), ("b2", b"")], now)
    assert run() == ["b1", "b2"]
    pack(source / "a.zip", [("a1", b"")], now)  # as old as what was seen, and before it by name
    pack(source / "c.zip", [("c1", b"")], now + 10**9)
    assert run() == ["a1", "b1", "b2", "c1"] == run()
