"""Report sinks: ordered text written as files, whatever the size of one report."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sections(sections: DataFrame, path: str, keys: list[str], text: str = "markdown") -> None:
    """Write sections in key order. A long report spans several part files, in order of their names."""
    ordered = sections.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_reports(reports: DataFrame, path: str, key: str = "reply_id", text: str = "text", ext: str = "ext") -> None:
    """One text per row, in a folder per format."""
    reports.select(ext, F.col(text).alias("value")).write.mode("overwrite").partitionBy(ext).text(path)
