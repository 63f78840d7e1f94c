import json

from pyspark.sql import functions as F

from lodestrata.operators import audit


def counted(df):
    return {(r["measure"], r["item"]): r["n"] for r in df.collect()}


MEDIA = "id long, family string, path string, size long, crc long"
SIDECARS = "id long, family string, path string, raw string"


def test_an_export_by_its_rules(spark):
    media = [(1, "f", "a/Photos from 2019/x.jpg", 10, 1), (2, "f", "a/y.JPG", 10, 1), (3, "f", "a/y.JPG", 11, 2), (4, "g", "a/Photos from 2019/x.jpg", 99, 3), (5, "f", "a/z.mp4", 7, 4), (6, "f", "plain", 7, 4)]
    taken = lambda **more: json.dumps({"photoTakenTime": {"timestamp": "86400"}, **more})
    sidecars = [
        (1, "f", "a/Photos from 2019/x.jpg.json", taken(title="other.jpg", geoData={"latitude": 1.5, "longitude": 2.0})),  # by its own name
        (2, "f", "a/Photos from 2019/long.supplemental-metadata.json", taken(title="x.jpg")),  # by its title
        (3, "f", "a/y.JPG.json", taken()),  # two entries of that path
        (4, "g", "a/q.jpg.json", taken(title="../x.jpg", description="d")),  # a title that leads elsewhere is none
        (5, "f", "a/u.json", "{"), (6, "f", "a/v.json", "[1, 2]"), (7, "f", "a/w.json", '{"z": 1, "y": null}'), (8, "f", "a/big.json", "{}" + " " * audit.MAX_JSON), (9, "f", "a/none.json", '{"photoTakenTime": null}'),
    ]
    got = counted(audit.export_audit(spark.createDataFrame(media, MEDIA), spark.createDataFrame(sidecars, SIDECARS), spark.createDataFrame([("y.JPG", 10), ("k", 99)], "name string, size long")))
    assert {k: v for k, v in got.items() if k[0] == "json"} == {("json", "photo"): 5, ("json", "unreadable"): 1, ("json", "not_object"): 1, ("json", "without_photo_taken_time"): 1, ("json", "oversized"): 1}
    assert got["key_shape", "y,z"] == 1 and got["key_shape", "photoTakenTime"] == 2 and got["key_shape", "photoTakenTime,title"] == 1
    assert (got["sidecar", "unique"], got["sidecar", "ambiguous"], got["sidecar", "unmatched"]) == (2, 1, 2)
    assert got["media_with_unique_sidecar", ""] == got["media_with_multiple_sidecars", ""] == 1
    assert got["coverage", "capture_year_1970"] == 4 and got["coverage_unique", "capture_year_1970"] == 2 and got["coverage_unique", "geoData_nonzero_location"] == 1 and ("coverage_unique", "nonempty_description") not in got
    assert (got["overlap", "name_size_candidate"], got["overlap", "size_only_candidate"], got["overlap", "no_equal_size_in_catalog"], got["overlap_bytes", "no_equal_size_in_catalog"]) == (1, 2, 3, 25)
    assert got["year_folder", "2019"] == 2 and got["extension", ".jpg"] == 4 and got["extension", ""] == 1 and got["repeated_size_crc_extra", ""] == 2


def test_an_empty_export(spark):
    got = counted(audit.export_audit(spark.createDataFrame([], MEDIA), spark.createDataFrame([], SIDECARS), spark.createDataFrame([], "name string, size long")))
    assert got == {("repeated_size_crc_extra", ""): 0}


def test_parts_that_are_missing(spark):
    names = ["takeout-x-001.zip", "takeout-x-004.zip", "takeout-x-002.zip", "takeout-y-007.zip", "Photos-1.zip", "takeout-x-9.zip"]
    archives = spark.createDataFrame([(n,) for n in names], "archive string")
    assert [tuple(r) for r in audit.part_gaps(archives).collect()] == [("takeout-x", 3)]
    own, part = audit.family(F.col("archive"))
    assert {tuple(r) for r in archives.select(own, part).collect()} == {("takeout-x", 1), ("takeout-x", 4), ("takeout-x", 2), ("takeout-y", 7), ("Photos-1.zip", None), ("takeout-x-9.zip", None)}


def test_strata_without_a_sample_count_zero(spark):
    population = spark.createDataFrame([("a", None), ("a", None), ("b", "s")], "source string, shape string")
    sample = spark.createDataFrame([("a", None, True, "x"), ("a", None, False, None)], "source string, shape string, probed boolean, f string")
    got = {(r["source"], r["measure"]): r["n"] for r in audit.survey_coverage(population, sample, ["f"]).collect()}
    assert got == {("a", "population"): 2, ("a", "selected"): 2, ("a", "probed"): 1, ("a", "f"): 1, ("b", "population"): 1, ("b", "selected"): 0, ("b", "probed"): 0, ("b", "f"): 0}


def test_years_beyond_9999_count_where_they_may(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from parity import assert_same

    from lodestrata.plans import upkeep

    raw = ['{"photoTakenTime": {"timestamp": "%d"}}' % x for x in (253402300799, 253402300800, 2 * 10**12)]
    told = spark.createDataFrame([(i, "f", f"a/{i}.json", x) for i, x in enumerate(raw)], SIDECARS)
    years = lambda **more: sorted(r["item"] for r in audit.export_audit(spark.createDataFrame([], MEDIA), told, spark.createDataFrame([], "name string, size long"), **more).where("measure = 'coverage' and item like 'capture_year%'").collect())
    assert years() == ["capture_year_9999"] and years(latest=10**13) == ["capture_year_10000", "capture_year_65347", "capture_year_9999"]
    ids = [*range(29_320, 29_345), *range(128_000, 128_012)]  # the times of taking pass the year 9999, and a million million seconds
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": [f"u{i}" for i in ids], "html": ["<p>" * (i % 7) for i in ids]}), tmp_path / "pages.parquet")
    assert_same(upkeep.archive_audit(spark, str(tmp_path)), upkeep.SQL["archive_audit"], str(tmp_path))
