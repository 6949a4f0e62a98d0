"""Table shapes shared by the operators."""

from pyspark.sql import types as T

ESSENTIAL_COLUMNS = ["case_id", "subject", "description"]

# What a missing ticket column is filled with.
COLUMN_DEFAULTS = {
    "channel": "unknown",
    "product_line": "unknown",
    "region": "unknown",
    "language": "en",
    "severity": "medium",
    "status": "open",
}

OPTIONAL_COLUMNS = ["created_at", *COLUMN_DEFAULTS]
FREE_COLUMNS = ["current_category", "resolution_code", "close_reason", "agent_team"]
TEXT_COLUMNS = ["subject", "description", *COLUMN_DEFAULTS]

TICKET_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ESSENTIAL_COLUMNS]
    + [T.StructField("created_at", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in COLUMN_DEFAULTS]
    + [T.StructField(c, T.StringType()) for c in FREE_COLUMNS]
)

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("case_sensitive", T.BooleanType()),
        T.StructField("assign_code", T.StringType()),
        T.StructField("assign_name", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("notes", T.StringType()),
        T.StructField("rule_order", T.IntegerType()),
    ]
)

TAXONOMY_SCHEMA = "code string, name string, description string"
VECTOR_SCHEMA = "case_id string, embedding array<float>"

# The exported label table.
LABEL_COLUMNS = {
    "case_id": "string",
    "predicted_code": "string",
    "predicted_name": "string",
    "confidence": "double",
    "model_strategy": "string",
    "version": "string",
    "decided_by": "string",
    "decided_at_utc": "string",
}

NOISE_TOPIC = -1
