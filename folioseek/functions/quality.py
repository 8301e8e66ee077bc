"""Scores for how far an extracted text can be trusted."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, rounded

# --- fixed values ---
PRINTABLE = rf"[\u4e00-\u9fff\u3000-\u303f\uff00-\uffefA-Za-z0-9\p{{P}}{SPACE}]"
NOTE_NO_TEXT_LAYER = "未检测到文本层，可能是扫描件（需要 OCR）"
NOTE_LOW_QUALITY = "文本提取质量较低，可能存在乱码"
NOTE_EMPTY_BODY = "文档正文为空"
# --- end of fixed values ---


def printable_share(text: Column) -> Column:
    """Share of characters that are Han, Latin letters, digits, punctuation or white space."""
    n = F.length(text)
    return F.when(n > 0, 1 - F.length(F.regexp_replace(text, f"{PRINTABLE}++", "")) / n).otherwise(0.0)


def _binary_rounded(x: Column) -> Column:
    """A share (0 to 1) to 2 decimals by its binary value, as the parsing service rounds.

    Half-way marks are compared as doubles. Where a value is the double nearest to a mark, the mark's own
    rounding decides; there are a hundred marks, and Python rounds by the binary value.
    """
    marks = F.array(*(F.lit(round((2 * j + 1) / 200, 2)) for j in range(101)))
    j = F.floor(x * 100).cast("int")
    mark = (2 * j + 1) / 200.0
    return F.when(x > mark, (j + 1) / 100.0).when(x < mark, j / 100.0).otherwise(F.get(marks, j))


def service_quality(text: Column, pages: Column) -> Column:
    """Density rule of the parsing service: characters per page, 0 when empty."""
    per_page = F.length(text) / F.greatest(pages, F.lit(1))
    dense = _binary_rounded(F.least(F.lit(1.0), 0.88 + per_page / 20000))
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).when(per_page < 60, 0.3).otherwise(dense)
    )


def paged_quality(text: Column, pages: Column, share: Column | None = None) -> Column:
    """struct<quality, has_text, note> for paged files: printable share x page density.

    `share` is `printable_share(text)` where the caller has it as a column already.
    """
    share = printable_share(text) if share is None else share
    n = F.length(text)
    per_page = F.when(pages > 0, n / pages).otherwise(0.0)
    quality = F.when(
        (n > 0) & (pages > 0), share * F.least(F.lit(1.0), per_page / 200)
    ).otherwise(0.0)
    has_text = (n >= 20) & (per_page >= 10)
    note = F.when(~has_text, NOTE_NO_TEXT_LAYER).when(quality < 0.4, NOTE_LOW_QUALITY)
    return F.struct(
        rounded(quality, 2).alias("quality"), has_text.alias("has_text"), note.alias("note")
    )


def flow_quality(text: Column, share: Column | None = None) -> Column:
    """struct<quality, has_text, note> for unpaged word-processor files."""
    share = printable_share(text) if share is None else share
    has_text = F.length(text) >= 10
    quality = F.when(has_text, share).otherwise(0.0)
    return F.struct(
        rounded(quality, 2).alias("quality"),
        has_text.alias("has_text"),
        F.when(~has_text, NOTE_EMPTY_BODY).alias("note"),
    )
