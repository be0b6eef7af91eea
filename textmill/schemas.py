"""Schemas and fixed values shared by the whole library."""

from pyspark.sql import types as T

# Limits, defaults and names that decide results.
MAX_WORDS = 1000
MIN_WORDS = 100
REFNUM_MIN = 100000
REFNUM_MAX = 999999
DEFAULT_REFNUMS = (100001, 200001)
LIST_LIMIT = 100
PREVIEW_CHARS = 100
TOP_K = 5
OUTER_BATCH = 200
RECENT_EVENTS = 50
ALIVE_SECONDS = 30
DEGRADED_SECONDS = 120
HEARTBEAT_STALE_SECONDS = 20
FORGET_SECONDS = 7 * 24 * 3600
SNAPSHOT_INTERVAL = "10 seconds"
DEFAULT_PORT = 8080

# The fields of an event on the shared log.
METRICS_META = T.StructType(
    [
        T.StructField("service", T.StringType()),
        T.StructField("processingStage", T.StringType()),
        T.StructField("bindingState", T.StringType()),
        T.StructField("hdfsProcessedDirExists", T.BooleanType()),
        T.StructField("inputMode", T.StringType()),
    ]
)

METRICS_EVENT = T.StructType(
    [
        T.StructField("instanceId", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("totalChunks", T.LongType()),
        T.StructField("processedChunks", T.LongType()),
        T.StructField("errorCount", T.LongType()),
        T.StructField("processingRate", T.DoubleType()),
        T.StructField("uptime", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("currentFile", T.StringType()),
        T.StructField("filesProcessed", T.LongType()),
        T.StructField("filesTotal", T.LongType()),
        T.StructField("lastError", T.StringType()),
        T.StructField("memoryUsedMB", T.LongType()),
        T.StructField("pendingMessages", T.LongType()),
        T.StructField("meta", METRICS_META),
        T.StructField("hostname", T.StringType()),
        T.StructField("publicHostname", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("bootEpoch", T.LongType()),
        T.StructField("version", T.StringType()),
    ]
)

# Fields every metrics event has to carry.
METRICS_REQUIRED = (
    "instanceId",
    "timestamp",
    "event",
    "status",
    "url",
    "meta.service",
    "meta.processingStage",
)

# A row of the vector table. Rows that were not stored are kept beside the stored
# ones, under their own outcome; outcome and batch are folders of the table.
VECTOR_ROW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("refnum1", T.IntegerType()),
        T.StructField("refnum2", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("error", T.StringType()),
        T.StructField("dropped_words", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
    ]
)
# Refused by a rule, or not embedded by the provider: the first stays so, the second is tried again.
STORED, REJECTED, FAILED, MISSING, EMPTY = "stored", "rejected", "failed", "missing", "empty"
