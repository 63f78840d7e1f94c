import base64
import hashlib
import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import identity

SCHEMA = "z double, b binary, list array<double>, a map<string,struct<y:long,x:string>>, ok boolean"
NUMBER = st.none() | st.floats(width=64)
ROW = st.tuples(NUMBER, st.none() | st.binary(max_size=9), st.none() | st.lists(NUMBER, max_size=4), st.none() | st.dictionaries(st.text(st.characters(exclude_categories=("Cs",)), max_size=5), st.none() | st.tuples(st.integers(-(2**63), 2**63 - 1), st.text(st.characters(exclude_categories=("Cs",)), max_size=5)), max_size=3), st.booleans())


def told(v):
    return v if v is None or math.isfinite(v) else {"nonfinite": str(v)}


def plain(row):
    z, b, numbers, a, ok = row
    value = {
        "z": told(z), "b": None if b is None else {"encoding": "base64", "value": base64.b64encode(b).decode()}, "list": None if numbers is None else [told(v) for v in numbers],
        "a": None if a is None else {k: None if v is None else {"y": v[0], "x": v[1]} for k, v in a.items()}, "ok": ok,
    }
    return json.dumps(value, sort_keys=True, allow_nan=False)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, min_size=20, max_size=40))
def test_json_and_digests_as_python_gives_them(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).select(identity.canonical_json(F.struct("*")).alias("j"), identity.model_identity("m", F.struct("*")).alias("m"))
    got = df.collect()
    assert sorted(r["j"] for r in got) == sorted(map(plain, rows))
    assert all(r["m"] == "m:" + hashlib.sha256(r["j"].encode()).hexdigest() for r in got)


def test_unknown_types_are_errors_and_null_stays(spark):
    assert spark.range(1).select(identity.canonical_json(F.lit(None).cast("struct<x:int>"))).first()[0] is None
    with pytest.raises(Exception, match="unsupported type"):
        spark.range(1).select(identity.canonical_json(F.struct(F.current_date().alias("d")))).collect()


def test_names(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    box = [0.1, 1e-05, 0.3, 1.0]
    row = spark.range(1).select(
        identity.face_id(F.lit("c"), F.lit("m"), F.lit(box)), identity.face_id(F.lit("c"), F.lit("m"), F.lit(box), F.lit("f")), identity.frame_id(F.lit("c"), F.lit("s"), F.lit(7), F.lit("1/25")), identity.trip_id(F.lit("1:2"), F.lit("2020-01-01"), F.lit("2020-01-02"))
    ).first()
    geometry = json.dumps(box, separators=(",", ":"))
    assert tuple(row) == (h("cm" + geometry), h("cfm" + geometry), h("c:s:7:1/25"), h("1:22020-01-012020-01-02"))
