"""Product model and document kind from a file name and the text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# --- fixed values ---
SCAN_CHARS = 3000  # the opening that the system we match looks at; here only where a caller asks for it
MODEL_MIN_HITS = 2
# Standards and formats that look like a model number.
MODEL_BLOCK = ("ISO", "GB", "GBU", "ASTM", "DIN", "JIS", "EN", "IEC", "HTTP", "WWW", "PDF")
# Kind patterns by priority, matched without regard to case; {s} is a white-space class.
KIND_RULES = (
    ("tds", r"T\.?D\.?S\.?|Technical{s}*Data{s}*Sheet|Product{s}*Data|技术数据表|产品数据表|技术数据单"),
    ("spec", r"Spec(?:ification)?(?![A-Za-z0-9_])|采购规范|采购规格|技术规格|规格书|技术要求|技术条件"),
    ("report", r"C\.?O\.?A\.?|Certificate{s}*of{s}*Analysis|检验报告|检测报告|质检报告|分析报告|试验报告"),
    ("sds", r"M?S\.?D\.?S\.?|Safety{s}*Data{s}*Sheet|安全数据表|安全技术说明书"),
)
# --- end of fixed values ---

# Word edges are ASCII: a model number may touch Han characters.
_MODEL = rf"(?<![A-Za-z0-9_])[A-Z]{{2,4}}[-_{SPACE}]?\d{{3,5}}[A-Z]?(?![A-Za-z0-9_])"
_BLOCKED = rf"^(?:{'|'.join(MODEL_BLOCK)})[-_{SPACE}]?\d"


def _opening(text: Column, scan_chars: int | None) -> Column:
    return text if scan_chars is None else F.substring(text, 1, scan_chars)


def model_hits(text: Column, scan_chars: int | None = None) -> Column:
    """Normalised model numbers in order of appearance, repeats kept."""
    found = F.regexp_extract_all(_opening(text, scan_chars), F.lit(_MODEL), F.lit(0))
    wanted = F.filter(found, lambda m: ~m.rlike(_BLOCKED))
    return F.transform(wanted, lambda m: F.regexp_replace(m, rf"[-_{SPACE}]", ""))


def most_frequent_first(ranked: Column, min_hits: int) -> Column:
    """Of structs (n, earliness, model): the model with the most hits, the earliest one on a tie, null below `min_hits`."""
    return F.when(ranked["n"] >= min_hits, ranked["model"])


def pick_model(text: Column, min_hits: int = MODEL_MIN_HITS, scan_chars: int | None = None) -> Column:
    """Most frequent model number, the earliest one on a tie, null below `min_hits`."""
    hits = model_hits(text, scan_chars)
    ranked = F.transform(
        F.array_distinct(hits),
        lambda k: F.struct(
            F.size(F.filter(hits, lambda h: h == k)).alias("n"),
            (-F.array_position(hits, k)).alias("earliness"),
            k.alias("model"),
        ),
    )
    return most_frequent_first(F.array_max(ranked), min_hits)


def _holds(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern.replace("{s}", f"[{SPACE}]"))


def _kind_in(text: Column) -> Column:
    return first_kind([_holds(text, pattern) for _, pattern in KIND_RULES])


def first_kind(found: list[Column]) -> Column:
    """The first kind whose rule was `found`, rules in their order."""
    kind = F.lit(None).cast("string")
    for (name, _), hit in reversed(list(zip(KIND_RULES, found))):
        kind = F.when(hit, name).otherwise(kind)
    return kind


# ---- texts that come in parts, joined by one line break

EDGE = 40  # characters of a part that a kind pattern can reach into, white space as one blank


def part_kinds(text: Column) -> Column:
    """Which kind rules one part holds by itself. No rule looks behind, and ahead a line break is like the end."""
    return F.array(*[_holds(text, pattern) for _, pattern in KIND_RULES])


def part_edges(text: Column) -> Column:
    """What the neighbours of a part need of it, as a struct of bounded size.

    `letters` at its end and `digits` at its start make a model number over the line break; `tail`, `head` and `whole`
    (only where the part is short enough to lie inside a pattern) are for the kind rules, which take white space of any length.
    """
    blanks = F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.struct(
        F.regexp_extract(text, r"(?<![A-Za-z0-9_])[A-Z]{2,4}\z", 0).alias("letters"),
        F.regexp_extract(text, r"\A\d{3,5}[A-Z]?(?![A-Za-z0-9_])", 0).alias("digits"),
        F.right(blanks, F.lit(EDGE)).alias("tail"),
        F.left(blanks, F.lit(EDGE)).alias("head"),
        (F.length(blanks) <= EDGE).alias("whole"),
    )


def seam_model(before: Column, after: Column) -> Column:
    """The model number that two neighbours' edges make together, or null."""
    model = F.concat(before["letters"], after["digits"])
    return F.when((before["letters"] != "") & (after["digits"] != "") & ~model.rlike(_BLOCKED), model)


def seam_kinds(before: Column, after: Column, later: Column) -> Column:
    """Which kind rules hold over the edge of a part and the next one, or the next two: only alternatives with white space can."""
    behind = F.when(after["whole"], F.coalesce(later["head"], F.lit(""))).otherwise("")
    seam = F.concat_ws(" ", before["tail"], after["head"], behind)
    spaced = ["|".join(x for x in pattern.split("|") if "{s}" in x) for _, pattern in KIND_RULES]
    return F.array(*[_holds(seam, x) if x else F.lit(False) for x in spaced])


def pick_kind(name: Column, text: Column, scan_chars: int | None = None) -> Column:
    return F.coalesce(_kind_in(name), _kind_in(_opening(text, scan_chars)))


def classify(name: Column, text: Column, scan_chars: int | None = None) -> tuple[Column, Column]:
    """(model, kind): the file name decides, the text fills in; the whole text, or its first `scan_chars` characters."""
    model = F.coalesce(pick_model(name, 1, scan_chars), pick_model(text, scan_chars=scan_chars))
    return model, pick_kind(name, text, scan_chars)
