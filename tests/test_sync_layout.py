"""The repeated sync on a table in one file and on the same table as a folder of files."""
from __future__ import annotations

from checks.queries import QUERIES


def test_sync_reads_tables_in_one_file_and_in_many(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 5}", "en" if i % 2 else None, "src", 6) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "many").mkdir()
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for layout in ("one", "many"):
        row = QUERIES["D2_repeated_sync"](spark, str(tmp_path / layout)).first()
        assert (row["documents"], row["contents"], row["chunks"], row["added_again"]) == (5, 5, 5, 0)
