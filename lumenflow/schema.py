"""Table schemas shared by readers and operators."""

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp_us", T.LongType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("polarity", T.BooleanType()),
    ]
)

#: What the binary reader emits: events, external triggers and unknown words.
RECORD = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("timestamp_us", T.LongType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("polarity", T.BooleanType()),
        T.StructField("trigger_id", T.IntegerType()),
        T.StructField("trigger_value", T.BooleanType()),
    ]
)

EVENT_COLUMNS = [f.name for f in EVENT.fields]
