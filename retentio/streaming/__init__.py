"""Scoring on a streaming DataFrame.

The reference has no streaming (data arrives by file, history is appended in batches).
What carries over unchanged is that scoring is stateless: a fitted ``PipelineModel`` plus
the risk-level expression can be applied to a ``readStream`` DataFrame, and each
micro-batch can be stored as a dated assessment with ``foreachBatch``. No watermark or
state is involved, and no new operator is added here.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.ml.train import score_students
from retentio.sources.history import RiskHistory


def score_stream(model: PipelineModel, students_stream: DataFrame) -> DataFrame:
    """Streaming scores (student_id, dropout_probability, prediction, risk_level)."""
    return score_students(model, students_stream)


def store_scores(scored_stream: DataFrame, history: RiskHistory, model_version: str, checkpoint: str,
                 trigger_once: bool = True):
    """Merge each micro-batch into the assessment of its processing date, student by student.

    A batch of a day adds to the earlier ones; a repeated batch changes nothing. ``notes`` holds
    the batch's number, by which a repeated batch is known where students have no id.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        day = df.sparkSession.range(1).select(F.current_date()).first()[0]
        history.merge(df, day, model_version, notes=f"batch {epoch}")

    w = scored_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
