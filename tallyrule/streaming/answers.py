"""Answers over streams: routing and gating are stateless, so a stream of inputs is answered row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyrule.operators.routing import Pattern, answer


def read_inputs(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def answer_stream(inputs: DataFrame, library: list[Pattern]) -> DataFrame:
    """Verdicts, labels and receipts of streamed inputs."""
    return answer(inputs, library)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Answer all that is there and stop; the checkpoint resumes after a failure, and each input is written once."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
