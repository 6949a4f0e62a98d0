"""Tickets labelled as they arrive.

Masking and rules look at one row at a time, so a streaming table passes through
the same plan as a stored one and needs neither state nor a watermark.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from casemill.operators import cascade
from casemill.operators.rules import Rule
from casemill.plans.pipeline import redact_and_label


def label_stream(tickets: DataFrame, rules: Iterable[Rule], path: str, checkpoint: str) -> StreamingQuery:
    """Write masked, rule-labelled tickets to ``path`` until the input is used up."""
    decided = cascade.decide(redact_and_label(tickets, rules))
    return (
        decided.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
