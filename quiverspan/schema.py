"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _INT, _BOOL, _TIME = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
_VECTOR, _PAYLOAD = T.ArrayType(T.FloatType()), T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


POINT = _struct(id=_STRING, vector=_VECTOR, payload=_PAYLOAD)
SEGMENT = _struct(segment=_LONG, state=_STRING, vectors=_LONG, bytes=_LONG, created_at=_TIME, position=_LONG)
CHANGE = _struct(id=_STRING, vector=_VECTOR, payload=_PAYLOAD, is_delete=_BOOL, ts=_LONG, seq=_LONG)
FEEDBACK_SESSION = _struct(id=_STRING, collection=_STRING, query=_STRING, user_id=_STRING, session_id=_STRING, created_at=_TIME, additional_context=_STRING)
FEEDBACK_ITEM = _struct(session_id=_STRING, result_id=_STRING, relevance_score=_INT, clicked=_BOOL, position=_INT, comment=_STRING)
