"""Retrieval chunks: one row per logical line or rejoined block of wrapped lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_lines

# --- fixed values ---
CHUNK_MAX = 800  # longer blocks are cut
LONG_LINE = 38  # a line this long may be a wrapped line
HEADING_LEN = 12  # a shorter line without an ending is a heading or table row
LINE_END = "。！？；：、）】」”!?;:"
HAN_END = r"㐀-䶿一-鿿豈-﫿）】」”"
HAN_START = r"㐀-䶿一-鿿豈-﫿（【「“"
# --- end of fixed values ---


def chunk_texts(text: Column) -> Column:
    """The chunks of one text, in order.

    Works on `clean_lines`, where a single newline may be line wrapping and an empty line is a
    definite break. Each step turns more single newlines into breaks; what is left at the end is
    wrapping and is undone. The whole rule stays in the row, so no shuffle is needed.
    """
    t = clean_lines(text)
    # Patterns start at the newline and look back from there: cheap to scan for.
    # A line with a closing mark is complete.
    t = F.regexp_replace(t, rf"\n(?<=[{LINE_END}]\n)(?!\n)", "\n\n")
    # So is the line before a heading.
    heading = rf"[^\n]{{1,{HEADING_LEN - 1}}}(?<![{LINE_END}])(?=\n|\z)"
    t = F.regexp_replace(t, rf"\n(?<!\n\n)(?={heading})", "\n\n")
    # Short lines at the head of a block stand alone; \G walks over a run of them.
    t = F.regexp_replace(t, rf"(\G|\n\n)([^\n]{{1,{LONG_LINE - 1}}})\n(?!\n)", "$1$2\n\n")
    # Wrapped lines: Han meets Han without a blank.
    t = F.regexp_replace(t, rf"\n(?<=[{HAN_END}]\n)(?=[{HAN_START}])", "")
    t = F.regexp_replace(t, r"\n(?<!\n\n)(?!\n)", " ")
    blocks = F.filter(F.split(t, "\n\n"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.sequence(F.lit(1), F.length(b), F.lit(CHUNK_MAX)),
                lambda at: F.substr(b, at, F.lit(CHUNK_MAX)),
            ),
        )
    )


def chunk_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, seq, content, page_no, ctype), key (doc_id, seq). Documents without text give no rows."""
    return docs.select("doc_id", F.posexplode(chunk_texts(F.col(text))).alias("seq", "content")).select(
        "doc_id",
        "seq",
        "content",
        F.lit(None).cast("int").alias("page_no"),
        F.lit("para").alias("ctype"),
    )
