"""Scoring scenarios block by block as their daily flows arrive, an extension for generators that append blocks.

A block holds whole scenarios. Each micro-batch is scored like any panel and appended under its batch id, so a
batch that is run again after a failure replaces its own rows and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.image import Reference, hazard_image
from ..sources.panel import daily_to_monthly


def score_blocks(stream: DataFrame, reference: Reference, path: str, checkpoint: str, wet_exclusion_days: int = 0, supplement: bool = False) -> StreamingQuery:
    """Starts a query over (scenario_id, pos, month_ix, day, flow) that fills ``path`` with image rows; stops when the input is read."""

    def score(batch: DataFrame, batch_id: int) -> None:
        image = hazard_image(daily_to_monthly(batch), batch, reference, wet_exclusion_days, supplement)
        image.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
