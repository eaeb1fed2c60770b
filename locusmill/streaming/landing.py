"""Association of genotype files as they land: micro-batches of dosage arrays through the same kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.assoc import Traits, associate

GENO = "variant_id string, dosage array<float>"


def associate_stream(spark: SparkSession, folder: str, traits: Traits, files_per_batch: int = 4) -> DataFrame:
    """A streaming DataFrame of results for every Parquet file (variant_id, dosage) that appears in ``folder``.

    The kernel keeps no state, so rows need no watermark; files are taken a few at a time.
    """
    geno = spark.readStream.schema(GENO).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return associate(geno, traits)


def run_until_done(results: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has landed, exactly once a file, and stop."""
    q = results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
