"""Record layouts shared by all operators."""

from pyspark.sql import types as T

# A block is identified by all four columns; (pool, block) names it regardless of version.
KEY = ["pool_id", "block_id", "length", "gen_stamp"]
ID = ["pool_id", "block_id"]

BLOCK = T.StructType(
    [
        T.StructField("pool_id", T.StringType(), False),
        T.StructField("block_id", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("gen_stamp", T.LongType(), False),
    ]
)

REPLICA = T.StructType([T.StructField("ip", T.StringType()), T.StructField("port", T.IntegerType())])

FILE = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField(
            "blocks",
            T.ArrayType(T.StructType(BLOCK.fields + [T.StructField("replicas", T.ArrayType(REPLICA))])),
        ),
    ]
)

FINALIZED = T.StructType(BLOCK.fields + [T.StructField("ts", T.TimestampType(), False)])

# Defaults (fixed values).
BACKUP_BATCH = 100
DELETE_BATCH = 100
BACKUP_AGE = "5 seconds"
RETRY_DELAY = "60 seconds"
RESTORE_CAPACITY = 10
RESTORE_TTL = "10 minutes"
RESTORE_POLL = "10 seconds"
VALIDATE_RETRIES = 3
PAGE_SIZE = 10_000
REPORT_KEEP = "7 days"
REPORT_PREFIX = "report."
REPORT_TIME = "yyyyMMddHHmmss"
