"""Row shapes, enums and limits shared by the engine."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, DELETE = 0, 1

#: One version of one key. ``seq`` orders versions; a delete is a row with op 1.
RECORD = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType(), True),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("pos", T.IntegerType(), False),
    ]
)

#: One command of the replicated log, with the client's session.
COMMAND = T.StructType(
    [
        T.StructField("idx", T.LongType(), False),
        T.StructField("operation", T.StringType(), True),
        T.StructField("key", T.StringType(), True),
        T.StructField("value", T.StringType(), True),
        T.StructField("client_id", T.StringType(), True),
        T.StructField("request_seq", T.LongType(), True),
    ]
)

# Limits that results depend on.
MAX_KEY_BYTES = 16 * 1024
MAX_VALUE_BYTES = 4 * 1024 * 1024
APPEND_CAP_BYTES = 1024 * 1024
MAX_ENTRY_BYTES = 4 * 1024 * 1024 + 32 * 1024
ENTRY_OVERHEAD_BYTES = 32
BATCH_MAX_ENTRIES = 256
BATCH_MAX_BYTES = 1024 * 1024
SNAPSHOT_CHUNK_BYTES = 1024 * 1024
FLUSH_THRESHOLD = 1000
COMPACTION_THRESHOLD = 4
