"""Files as (path, name, size, content), and the text that can be had from each."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.quality import flow_quality, paged_quality, printable_share, service_quality
from ..functions.text import compat_folded, trimmed

# --- fixed values ---
TYPE_OF = {"pdf": "pdf", "doc": "word", "docx": "word", "md": "md", "markdown": "md"}
OTHER_TYPE = "txt"
MAX_BYTES = 48 * 1024 * 1024  # the limit of the system we match; here only where a caller asks for it
PLAIN = r"(?i)\.(?:txt|md|markdown)\z"
OLD_WORD, WORD, PAGED = r"(?i)\.doc\z", r"(?i)\.docx\z", r"(?i)\.pdf\z"
NOTE_TOO_LARGE = ("文件过大（", " MB），为避免手机内存不足已跳过解析。")
NOTE_OLD_WORD = "老式 .doc 为二进制格式，暂不支持解析。请在 Word 中另存为 .docx 或导出 PDF 后重新导入。"
OTHER_QUALITY = 0.5
SERVICE_MIN_CHARS = 20
# --- end of fixed values ---

# (bytes, name) -> (text, pages, note); pages is None for unpaged files
Extractor = Callable[[bytes, str], tuple[str | None, int | None, str | None]]
EXTRACTED = "text string, pages int, note string"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Plain files below a folder. Folders are not listed; content is read only if selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return with_names(files)


def with_names(files: DataFrame) -> DataFrame:
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return files.select("path", name.alias("name"), F.col("length").alias("size"), "modificationTime", "content")


def file_type(name: Column) -> Column:
    """Type by extension; anything unknown counts as text."""
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    items = [F.lit(x) for pair in TYPE_OF.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*items), extension), F.lit(OTHER_TYPE))


def plain_text(content: Column) -> Column:
    """UTF-8 without a leading byte-order mark, trimmed; bytes that are not UTF-8 become U+FFFD."""
    return trimmed(F.make_valid_utf8(content.cast("string")))


def _extracted(make_extractor: Callable[[], Extractor]):
    """The caller's extractor over Arrow batches, made once per task; rows without bytes pass through."""

    @pandas_udf(EXTRACTED)
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        extractor = make_extractor()
        for contents, names in batches:
            rows = [extractor(c, n) if c is not None else (None, None, None) for c, n in zip(contents, names)]
            out = pd.DataFrame(rows, columns=["text", "pages", "note"])
            yield out.astype({"pages": "Int32"})

    return extract


def routed(
    files: DataFrame,
    make_extractor: Callable[[], Extractor] | None = None,
    by_service: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Files with text, source (nas/local/none), quality, pages and note.

    Plain files are decoded here. PDF and DOCX bytes go to the caller's extractor; `by_service` says
    it is the high-quality parsing service, whose paged texts are scored by their density. One pass:
    only bytes that need the extractor are sent to it. Files above `max_bytes`, if given, get a note instead of a text.
    """
    name = F.col("name")
    too_large = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    binary = ~too_large & (name.rlike(WORD) | name.rlike(PAGED))
    if make_extractor is None:
        none = F.lit(None)
        got = F.struct(none.cast("string").alias("text"), none.cast("int").alias("pages"), none.cast("string").alias("note"))
    else:
        got = _extracted(make_extractor)(F.when(binary, F.col("content")), name)
    rows = files.withColumn("got", got).withColumn("body", compat_folded(F.coalesce(trimmed(F.col("got.text")), F.lit(""))))
    rows = rows.withColumn("share", printable_share(F.col("body")))
    plain = F.when(~too_large & ~binary & ~name.rlike(OLD_WORD), plain_text(F.col("content")))

    body, pages = F.col("body"), F.coalesce(F.col("got.pages"), F.lit(0))
    share = F.col("share")
    paged, flow = paged_quality(body, pages, share), flow_quality(body, share)
    served = F.lit(by_service) & (F.length(body) >= SERVICE_MIN_CHARS)
    size_mb = F.format_string("%.1f", F.col("size") / 1048576.0)
    usable = F.when(served, True).when(name.rlike(PAGED), paged["has_text"]).otherwise(flow["has_text"])
    text = F.when(binary, F.when(usable, body)).otherwise(F.when(plain != "", plain))
    quality = (
        F.when(too_large | name.rlike(OLD_WORD), 0.0)
        .when(name.rlike(PLAIN), F.when(plain != "", 1.0).otherwise(0.0))
        .when(name.rlike(WORD), flow["quality"])
        .when(name.rlike(PAGED), F.when(served, service_quality(body, pages)).otherwise(paged["quality"]))
        .otherwise(F.when(plain != "", OTHER_QUALITY).otherwise(0.0))
    )
    own_note = F.when(name.rlike(PAGED), F.when(~served, paged["note"])).otherwise(flow["note"])
    note = (
        F.when(too_large, F.concat(F.lit(NOTE_TOO_LARGE[0]), size_mb, F.lit(NOTE_TOO_LARGE[1])))
        .when(name.rlike(OLD_WORD), NOTE_OLD_WORD)
        .when(binary, F.coalesce(F.col("got.note"), own_note))
    )
    source = F.when(text.isNull(), "none").when(binary & served & name.rlike(PAGED), "nas").otherwise("local")
    return rows.select(
        *(c for c in files.columns if c != "content"),
        file_type(name).alias("type"),
        text.alias("text"),
        source.alias("source"),
        quality.alias("quality"),
        F.when(name.rlike(PAGED), F.col("got.pages")).alias("pages"),
        note.alias("note"),
    )
