"""Row types of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

CATALOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("test_types", _STRINGS),
        T.StructField("description", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("job_levels", _STRINGS),
        T.StructField("remote_testing", T.BooleanType()),
        T.StructField("adaptive", T.BooleanType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

FILTERS = T.StructType(
    [
        T.StructField("test_type", _STRINGS),
        T.StructField("job_level", _STRINGS),
        T.StructField("remote_testing", T.BooleanType()),
        T.StructField("adaptive", T.BooleanType()),
        T.StructField("duration_max", T.IntegerType()),
    ]
)

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
    ]
)

# Requests and model texts of a stream, with the times at which they were made.
TIMED_REQUESTS = T.StructType([*REQUESTS.fields, T.StructField("asked_at", T.TimestampType())])
TIMED_RESPONSES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("asked_at", T.TimestampType()),
        T.StructField("raw", T.StringType()),
        T.StructField("given_at", T.TimestampType()),
    ]
)

RECOMMENDATION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("test_type", T.StringType()),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("reply", T.StringType()),
        T.StructField("recommendations", T.ArrayType(RECOMMENDATION)),
        T.StructField("end_of_conversation", T.BooleanType()),
    ]
)
