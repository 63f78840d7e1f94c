"""Views and rules that no registered query uses, by what the catalogue's rules say."""

from pyspark.sql import functions as F

from lodestrata.functions import text, times
from lodestrata.operators import details, progress, search, views


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_described_hits_come_first_with_or_without_a_score(spark):
    scored = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("b", 0.7), ("d", 0.1)], "content_hash string, score double")
    described = spark.createDataFrame([("c",), ("b",), ("b",), (None,)], "content_hash string")
    got = [tuple(r) for r in views.visual_hits(scored, described).orderBy("rank").collect()]
    assert got == [("b", 0.7, True, 1), ("c", None, True, 2), ("a", 0.9, False, 3), ("d", 0.1, False, 4)]
    assert [r["content_hash"] for r in views.visual_hits(scored, described, 3).orderBy("rank").collect()] == ["b", "c", "a"]


def test_transcripts_list_segments_in_time_and_none_is_an_empty_list(spark):
    work = spark.createDataFrame([("a", "m", "complete"), ("b", "m", "complete"), ("c", "old", "complete")], "content string, model string, status string")
    segments = spark.createDataFrame([("a", "m", 5.0, 6.0, "two"), ("a", "m", 1.0, 2.0, "one"), ("a", "old", 0.0, 1.0, "no")], "content string, model string, start double, end double, text string")
    got = {r["content"]: [s["text"] for s in r["segments"]] for r in views.transcripts(work, segments, "m").collect()}
    assert got == {"a": ["one", "two"], "b": []}


def test_current_facts_take_the_last_of_models_as_good(spark):
    facts = spark.createDataFrame([("a", "new", "1", 1), ("a", "good", "2", 2), ("a", "bad", "9", 3), ("b", "bad", "1", 4)], "content_hash string, model string, derived_at string, value int")
    assert rows(views.current_facts(facts, ["new", "good"]).select("content_hash", "value")) == [("a", 2)]


def test_trip_exclusions_count_what_is_gone(spark):
    out = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "b"), ("u", "c"), ("t", "d")], "trip string, content_hash string")
    items = spark.createDataFrame([("b", 4), ("b", 2), ("d", 9)], "content_hash string, id int")
    assert rows(views.trip_exclusions(out, items, "t")) == [("b", 2, 3, 1), ("d", 9, 3, 1)]
    assert rows(views.trip_exclusions(out, items, "t", 1)) == [("b", 2, 3, 1)]


def test_frames_of_the_first_named_sampler_win(spark):
    frames = spark.createDataFrame([(1, "old", "x"), (1, "new", "y"), (2, "old", "z"), (3, "bad", "w")], "frame_id int, sampler string, box string")
    assert rows(views.frame_observations(frames, ["new", "old"]).select("frame_id", "box")) == [(1, "y"), (2, "z")]


def test_only_files_that_are_as_recorded_are_sound(spark):
    schema = "path string, size long, mtime_ns long"
    recorded = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, None)], schema)
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, None)], schema)
    assert rows(views.unchanged_paths(recorded, now)) == [("a", True), ("b", False), ("c", False), ("d", True)]


def test_events_that_name_unknown_contents_or_no_photos(spark):
    events = spark.createDataFrame([(1, "favorite", ["a", "v"]), (2, "cover", ["v"]), (3, "hide", ["gone"])], "event int, op string, contents array<string>")
    items = spark.createDataFrame([("a", "photo"), ("v", "video")], "content_hash string, kind string")
    assert rows(views.unknown_members(events, items, F.col("op") == "cover")) == [(2, "v"), (3, "gone")]


def test_recognised_text_is_searched_once_each(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2)], "content_hash string, id int")
    texts = spark.createDataFrame([("a", "two"), ("a", "one"), ("a", "one")], "content_hash string, text string")
    assert rows(search.with_recognised(items, texts)) == [("a", 1, "one two"), ("b", 2, None)]


def test_words_to_show_are_sure_and_hold_two_letters_or_digits(spark):
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(s).alias("score")) for w, s in (("sign", 0.5), ("x", 0.9), ("a-b", 0.9), ("42", 0.8), ("dim", 0.49))])
    assert [w["word"] for w in one(spark, details.shown_words(words))[0]] == ["sign", "42"]


def test_embedded_fields_are_read_in_their_order(spark):
    as_map = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    xmp = as_map({"dc:title": ["T"], "dc:subject": ["k", "l"], "xmp:Rating": ["4.0"], "exif:DateTimeOriginal": ["2020:05:06 07:08:09"], "xmp:CreateDate": ["1999:01:01 00:00:00"]})
    iptc = as_map({"iptc:ObjectName": ["other"], "iptc:Caption": ["C"], "iptc:Keywords": ["l", "m"]})
    (got,) = one(spark, details.embedded_summary(xmp, iptc))
    assert tuple(got["title"]) == ("T", "dc:title") and tuple(got["caption"]) == ("C", "iptc:Caption") and got["rating"] == 4
    assert got["created"]["source"] == "xmp:exif:DateTimeOriginal" and got["created"]["value"].startswith("2020-05-06T07:08:09") and list(got["keywords"]) == ["k", "l", "m"]
    (bad,) = one(spark, details.embedded_summary(as_map({"xmp:Rating": ["9"]}), as_map({"x": ["y"]})))
    assert bad["rating"] is None and bad["title"] is None and bad["created"] is None


def test_capture_coverage_counts_each_sidecar_once(spark):
    claims = spark.createDataFrame([("p", "date", "2020-01-02", "capture", "f"), ("p", "date", "2020-01-03", "capture", "g"), ("q", "date", "2019-01-02", "other", "f"), ("q", "location", "1,2", None, "geoData"), ("q", "description", "x", None, None)], "path string, attribute string, value string, meaning string, field string")
    assert rows(details.capture_coverage(claims)) == [("capture_timestamp", 1), ("capture_year_2020", 1), ("geoData_nonzero_location", 1), ("nonempty_description", 1)]


def test_spans_of_time_in_words(spark):
    assert one(spark, *[times.humanised(F.lit(s)) for s in (59, 3600, 7199, 7200, 90000)]) == ("0 minutes", "60 minutes", "119 minutes", "2 hours", "25 hours")


def test_byte_ranges(spark):
    cases = {None: (0, 9, False), "": (0, 9, False), "bytes=0-": (0, 9, True), "bytes=2-4": (2, 4, True), "bytes=5-99": (5, 9, True), "bytes=-3": (7, 9, True), "bytes=-99": (0, 9, True), "bytes=10-": None, "bytes=4-2": None, "bytes=-0": None, "bytes=-": None, "bytes=0-1,3-4": None, "items=0-1": None}
    for header, want in cases.items():
        (got,) = one(spark, text.byte_range(F.lit(header).cast("string"), F.lit(10).cast("long")))
        assert (tuple(got) if got is not None else None) == want, header


def test_summaries_of_empty_ledgers_are_zero(spark):
    empty = spark.createDataFrame([], "content_hash string, model string, status string, face_count int")
    assert rows(progress.face_summary(empty, "m")) == [(0, 0, 0, 0)] and rows(progress.work_summary(empty, "m")) == [(0, 0)]
    work = spark.createDataFrame([("a", "old", "e"), ("a", "new", None), ("b", "old", "e"), ("c", "bad", "e")], "content_hash string, sampler string, error string")
    facts = spark.createDataFrame([("new",), ("new",), ("bad",)], "sampler string")
    assert rows(progress.frame_coverage(work, facts, ["new", "old"])) == [(2, 2, 1, 4, 3)]


def test_raw_metadata_that_is_no_json_is_null(spark):
    files = spark.createDataFrame([("a", "/r", '{"x": 1}'), ("b", "/r", "{"), ("c", "/r", None)], "path string, root string, metadata string")
    assert rows(progress.raw_metadata(files, F.lit(True)).select("path", "raw", "source")) == [("a", '{"x": 1}', "/r/a"), ("b", None, "/r/b"), ("c", None, "/r/c")]


def test_best_groups_over_many_blocks(spark, monkeypatch):
    import random

    from lodestrata.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 6)
    monkeypatch.setattr(neighbours, "BLOCK_ASKED", 4)
    rng = random.Random(2)
    vector = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]  # few values: many ties
    asked, members = [(i, vector()) for i in range(9)], [(rng.randrange(7), vector()) for _ in range(30)] + [(50, [1.0, 1.0, 1.0])]
    got = rows(neighbours.best_groups(spark.createDataFrame(asked, "face_id long, vector array<double>"), spark.createDataFrame(members, "person int, vector array<double>"), "person"))
    want = []
    for i, u in asked:
        by = {}
        for p, v in members:
            by.setdefault(p, []).append(sum(a * b for a, b in zip(u, v, strict=True)))
        best = sorted((-max(s), p, sorted(s, reverse=True)) for p, s in by.items())[:2]
        want += [(i, p, s[0], s[1] if len(s) > 1 else None, r) for r, (_, p, s) in enumerate(best, 1)]
    assert got == sorted(want, key=str)
    few = neighbours.best_matches(spark.createDataFrame(asked, "vec_id long, vector array<double>"), spark.createDataFrame(asked, "vec_id long, vector array<double>"), 3)
    plain = [(i, *x) for i, u in asked for x in [(o, -s, r) for r, (s, o) in enumerate(sorted((-sum(a * b for a, b in zip(u, v, strict=True)), o) for o, v in asked if o != i)[:3], 1)]]
    assert rows(few.select("vec_id", "o", "score", "rank")) == sorted(plain, key=str)


def test_trips_of_dates_that_can_be_trusted(spark):
    import hashlib

    from lodestrata.operators import journeys

    schema = "id int, content_hash string, day string, cell string, confirmed boolean, date_status string, date_meaning string"
    good = [(i, f"h{i}", f"2020-01-0{d}", "1:2", False, "single", "capture") for i, d in ((5, 3), (4, 1), (9, 1))]
    bad = [(0, "x", "2020-01-01", "1:2", False, "conflict", "capture"), (1, "x", "2020-01-01", "1:2", None, "single", "created"), (2, None, "2020-01-01", "1:2", True, "single", "capture"), (3, "x", None, "1:2", True, "single", "capture"), (6, "x", "2020-01-01", "1:2", None, None, None)]
    sure = [(7, "h7", "2020-02-01", "1:2", True, "conflict", None), (8, "h8", "2020-02-01", "1:2", True, "invalid", "x")]  # two only: no trip
    labels = spark.createDataFrame([("9:9", "elsewhere")], "place string, label string")
    got = rows(journeys.trip_proposals(spark.createDataFrame(good + bad + sure, schema), labels))
    name = hashlib.sha256(b"1:22020-01-012020-01-03").hexdigest()
    assert got == [(name, "Recorded place · 2020-01-01", "2020-01-01", "2020-01-03", "1:2", 3, 4)]


def test_everything_known_of_an_item_multiplies_nothing(spark):
    items = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    facts = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 1)], "id int, attribute string, value int")
    paths = spark.createDataFrame([(1, "p"), (2, "q"), (1, "o"), (None, "x")], "id int, path string")
    got = {r["id"]: ([tuple(f) for f in r["facts"]], [p["path"] for p in r["paths"]]) for r in details.evidence_of(items, "id", facts=facts, paths=paths).collect()}
    assert got == {1: ([("a", 1), ("b", 2)], ["o", "p"]), 2: ([], ["q"]), None: ([], [])}


def test_large_groups_are_split_and_all_exemplars_count(spark, monkeypatch):
    import random

    from lodestrata.operators import neighbours

    for name, n in (("BLOCK_ROWS", 16), ("BLOCK_ASKED", 4), ("GROUP_ROWS", 5)):
        monkeypatch.setattr(neighbours, name, n)
    rng = random.Random(4)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    asked, members = [(i, vector()) for i in range(9)], [(rng.choice([0, 0, 0, 1, 2, 3]), i, vector()) for i in range(120)] + [(9, 900, vector())]
    best = lambda u, of: sorted(((-max(s), p, sorted(s, reverse=True)) for p, s in of.items()), key=lambda x: x[:2])
    frames = spark.createDataFrame(asked, "face_id long, vector array<double>"), spark.createDataFrame(members, "person int, face_id long, vector array<double>")
    want, told = [], []
    for i, u in asked:
        by = {}
        for p, _, v in members:
            by.setdefault(p, []).append(sum(a * b for a, b in zip(u, v, strict=True)))
        two = best(u, by)[:2]
        want += [(i, p, round(s[0], 9), round(s[1], 9) if len(s) > 1 else None, r) for r, (_, p, s) in enumerate(two, 1)]
        fits = two[0][2][0] >= 0.3 and (len(two[0][2]) == 1 or two[0][2][1] >= 0.1)
        told += [(i, two[0][1])] if fits and two[1][0] - two[0][0] >= 0.01 else []
    got = neighbours.best_groups(*frames, "person").withColumns({c: F.round(c, 9) for c in ("first", "second")})
    assert rows(got) == sorted(want, key=str)
    assert rows(details.suggestions(*frames, 0.3, 0.3, 0.1, 0.01, most=None).select("face_id", "person")) == sorted(told, key=str)
    assert rows(details.suggestions(*frames, 0.3, 0.3, 0.1, 0.01, most=3).select("face_id", "person")) != sorted(told, key=str)
