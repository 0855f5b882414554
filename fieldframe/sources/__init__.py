"""Readers and writers: fixed-record binary formats, run files, result tables."""

from pyspark.sql import SparkSession


def register_all(spark: SparkSession) -> SparkSession:
    """Register the binary formats with a session, with file pruning by frame."""
    from fieldframe.sources.compact_field import CompactFieldSource
    from fieldframe.sources.field_snapshot import FieldSnapshotSource
    from fieldframe.sources.mhd_raw import MhdRawSource
    from fieldframe.sources.particle_snapshot import ParticleSnapshotSource

    for source in (ParticleSnapshotSource, CompactFieldSource, FieldSnapshotSource, MhdRawSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
