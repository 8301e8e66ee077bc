"""Text expressions shared by ingestion, indexing and reports.

Everything here is `Column -> Column` on built-in functions, so it stays inside the JVM.
"""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
# White space as ECMAScript trims it. Java's \s is ASCII only, so the set is spelled out.
SPACE_CHARS = (
    "\t\n\u000b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE = r"\t\n\u000b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Han ranges that are cut into single characters and pairs.
HAN = r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
# Characters that join the parts of one word: CY-1578, g/cm3, mPa·s, ISO_3219.
JOINERS = r"\-_\u00b7\u2010-\u2015\u2027/\\"
# Full-width forms U+FF01..U+FF5E stand for U+0021..U+007E.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F))
# Blocks whose characters are replaced by their compatibility form (Kangxi radicals, CJK compatibility).
COMPAT_BLOCKS = ((0x2E80, 0x2FFF), (0xF900, 0xFAFF))
# Content fingerprint: texts beyond twice this many characters are fingerprinted on both ends.
FINGERPRINT_SIDE = 60_000
# --- end of fixed values ---


def _compat_pairs() -> tuple[str, str]:
    src, dst = [], []
    for low, high in COMPAT_BLOCKS:
        for code in range(low, high + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain != chr(code):
                src.append(chr(code))
                dst.append(plain)
    return "".join(src), "".join(dst)


_COMPAT_FROM, _COMPAT_TO = _compat_pairs()


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def blank(c: Column) -> Column:
    """True for null, empty and white-space-only values."""
    return F.coalesce(trimmed(c), F.lit("")) == ""


def null_if_blank(c: Column) -> Column:
    return F.when(~blank(c), trimmed(c))


def _is_ascii(c: Column) -> Column:
    """One byte per character; lets plain texts skip the passes that only matter beyond ASCII."""
    return F.octet_length(c) == F.length(c)


def folded_case(c: Column) -> Column:
    low = F.lower(c)
    return F.when(_is_ascii(c), low).otherwise(F.translate(low, FULL_WIDTH, HALF_WIDTH))


def flat(c: Column) -> Column:
    """Letters, digits and Han only: the form in which whole phrases are compared."""
    return F.regexp_replace(folded_case(c), f"[^0-9a-z{HAN}]+", "")


def _word_tokens(t: Column) -> Column:
    """Maximal runs of [0-9a-z], then the joined form of words held together by joiners."""
    words = F.regexp_extract_all(t, F.lit("[0-9a-z]+"), F.lit(0))
    compound = F.regexp_extract_all(t, F.lit(f"[0-9a-z]++(?:[{JOINERS}]++[0-9a-z]++)+"), F.lit(0))
    joined = F.transform(compound, lambda w: F.regexp_replace(w, f"[{JOINERS}]+", ""))
    return F.when(t.rlike(f"[{JOINERS}]"), F.concat(words, joined)).otherwise(words)


def _han_pairs(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(f"(?=([{HAN}]{{2}}))[{HAN}]"), F.lit(1))


def index_tokens(c: Column) -> Column:
    """Tokens of a text to be indexed, repeats kept, order free.

    Words as in `_word_tokens`; Han runs give single characters and overlapping pairs. Whole-text
    regex passes keep this in generated code; the Han passes run only where there is Han.
    """
    t = folded_case(F.coalesce(c, F.lit("")))
    words = _word_tokens(t)
    han = F.concat(F.regexp_extract_all(t, F.lit(f"[{HAN}]"), F.lit(0)), _han_pairs(t))
    return F.when(~_is_ascii(t) & t.rlike(f"[{HAN}]"), F.concat(words, han)).otherwise(words)


def query_tokens(c: Column) -> Column:
    """Distinct tokens of a query in order of appearance; a Han character counts alone only if it stands alone."""
    t = folded_case(F.coalesce(c, F.lit("")))
    runs = F.regexp_extract_all(t, F.lit(f"[0-9a-z{JOINERS}]+|[{HAN}]+"), F.lit(0))
    per_run = F.transform(
        runs,
        lambda r: F.when(~r.rlike(f"^[{HAN}]"), _word_tokens(r))
        .when(F.length(r) == 1, F.array(r))
        .otherwise(_han_pairs(r)),
    )
    return F.array_distinct(F.flatten(per_run))


def compat_folded(c: Column) -> Column:
    """Compatibility ideographs and radicals as ordinary Han; all else unchanged."""
    return F.translate(c, _COMPAT_FROM, _COMPAT_TO)


def fingerprint(c: Column, side: int | None = None) -> Column:
    """Content fingerprint `sha256-length` of the whole text.

    With `side` (FINGERPRINT_SIDE in the system we match), texts longer than both sides are fingerprinted on their
    first and last `side` characters plus the length, and texts that differ only between them count as copies.
    """
    sample = c
    if side is not None:
        ends = F.concat(F.substring(c, 1, side), F.right(c, F.lit(side)))
        sample = F.when(F.length(c) > 2 * side, ends).otherwise(c)
    return F.when(F.length(c) > 0, F.concat(F.sha2(sample, 256), F.lit("-"), F.length(c)))


def clean_tags(tags: Column) -> Column:
    t = F.transform(F.coalesce(tags, F.array().cast("array<string>")), trimmed)
    return F.array_distinct(F.filter(t, lambda x: x != ""))


def split_tags(c: Column, on_space: bool = True) -> Column:
    """Typed tags as a distinct list; `on_space=False` lets a tag hold inner blanks."""
    sep = f"[,，、{SPACE}]+" if on_space else "[,，、]"
    return clean_tags(F.split(F.coalesce(c, F.lit("")), sep))


def clean_lines(c: Column) -> Column:
    """Trimmed, non-blank lines: `\\n` between lines, `\\n\\n` where the text has an empty line.

    An empty element of the raw split is an empty line and becomes a newline of its own, so the
    joined text shows it as a run of newlines; lines of white space only are dropped.
    """
    lines = F.transform(F.split(c, "\n"), lambda x: F.when(x == "", "\n").otherwise(trimmed(x)))
    kept = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return F.regexp_replace(F.btrim(kept, F.lit("\n")), r"\n{3,}", "\n\n")


def rejoined_paragraphs(c: Column) -> Column:
    """Undo line wrapping inside paragraphs; a blank is added only between Latin letters or digits."""
    t = F.regexp_replace(clean_lines(c), r"\n(?<=[A-Za-z0-9]\n)(?=[A-Za-z0-9])", " ")
    return F.regexp_replace(t, r"\n(?<!\n\n)(?!\n)", "")


def clipped(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def rounded(c: Column, digits: int) -> Column:
    """Half-up rounding on the double itself: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def size_text(n: Column) -> Column:
    mb, kb = 1024.0 * 1024.0, 1024.0
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "")
        .when(n >= mb, F.format_string("%.1f MB", rounded(n / mb, 1)))
        .when(n >= kb, F.concat(F.floor(n / kb + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )
