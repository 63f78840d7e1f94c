"""Names that are digests: of trips, frames, faces and models, and the canonical JSON that such digests are of."""

from __future__ import annotations

import base64
import json
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def typed(value: object, kind: pa.DataType) -> object:
    """A value as JSON can say it: bytes in base64 and numbers that aren't finite under a tag; other types than text, numbers,
    truth values, bytes, lists, maps and structs are an error."""
    if value is None:
        return None
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return {"encoding": "base64", "value": base64.b64encode(value).decode("ascii")}
    if pa.types.is_floating(kind):
        return value if math.isfinite(value) else {"nonfinite": str(value)}
    if pa.types.is_boolean(kind) or pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return value
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [typed(v, kind.value_type) for v in value]
    if pa.types.is_map(kind):
        return {str(k): typed(v, kind.item_type) for k, v in value}
    if pa.types.is_struct(kind):
        return {f.name: typed(value[f.name], f.type) for f in kind}
    raise ValueError(f"unsupported type {kind}")


def _dumped(values: pa.Array, indented: bool) -> pa.Array:
    parted = {} if indented else {"separators": (",", ":")}
    out = (typed(v, values.type) for v in values.to_pylist())
    return pa.array([None if v is None else json.dumps(v, sort_keys=True, allow_nan=False, **parted) for v in out], pa.string())


@F.arrow_udf(StringType())
def _canonical(values: pa.Array) -> pa.Array:
    return _dumped(values, True)


@F.arrow_udf(StringType())
def _compact(values: pa.Array) -> pa.Array:
    return _dumped(values, False)


def canonical_json(value: Column, compact: bool = False) -> Column:
    """JSON with sorted keys, a blank after commas and colons unless ``compact``; floats as their shortest digits; null stays null.

    A column of any type made of structs, maps, lists, text, numbers, truth values and bytes.
    """
    return _compact(value) if compact else _canonical(value)


def model_identity(name: str, settings: Column) -> Column:
    """The model's name and the digest of its settings: models of equal settings are the same one."""
    return F.concat(F.lit(name + ":"), F.sha2(canonical_json(settings), 256))


def trip_id(place: Column, after: Column, before: Column) -> Column:
    return F.sha2(F.concat(place, after, before), 256)


def frame_id(content: Column, sampler: Column, pts: Column, time_base: Column) -> Column:
    return F.sha2(F.concat_ws(":", content, sampler, pts.cast("string"), time_base), 256)


def face_id(content: Column, model: Column, box: Column, frame: Column | None = None) -> Column:
    """A face's name: its content, the frame's if it is in a video, the model's, and its box (array of doubles)."""
    return F.sha2(F.concat(content, F.coalesce(frame, F.lit("")) if frame is not None else F.lit(""), model, canonical_json(box, compact=True)), 256)
