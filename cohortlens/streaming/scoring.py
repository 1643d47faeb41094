"""The bulk scorer is row-wise, so it also runs on a stream of new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators.scoring import Scorer, batch_score
from cohortlens.session import scratch_path


def score_stream(rows: DataFrame, scorer: Scorer, path: str, id_col: str, keep: list[str] | None = None,
                 checkpoint: str | None = None) -> StreamingQuery:
    """Append scored rows to a Parquet folder until all rows present are done.

    Restarting with the same ``checkpoint`` carries on where the last run stopped.
    """
    checkpoint = checkpoint or scratch_path(rows.sparkSession, "stream")
    return (
        batch_score(rows, scorer, id_col, keep)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(path)
    )
