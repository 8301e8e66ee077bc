"""Text lines from positioned spans: (doc_id, page, x0, y0, x1, y1, size, text)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, trimmed
from .tables import written

# --- fixed values ---
ROW_REACH = 0.6  # x font size: how far a span's middle may lie from its row's first span
WORD_GAP = 0.45  # x row height: a wider gap between spans is a blank
DEFAULT_SIZE = 10.0
# --- end of fixed values ---

PAGE = ["doc_id", "page"]
LEVEL = [*PAGE, "y0", "y1", "size"]  # what decides how far a span reaches: spans of one line share it
STRIP = 6.0  # height of a strip of a page, in mean font sizes of the page
CELLS = 4096  # cells that are put in order together
SLAB = 256.0  # height of the part of a page whose spans are dealt together, in font sizes rounded up to a power of 2


def _reaches(levels: DataFrame) -> DataFrame:
    """Levels (with the number `n` of their spans) and `first` and `last`: the cells of the page from their middle to as far down as their row may go.

    A row goes from its first span as far as its largest font reaches, and a span can only share a row with spans
    near it. So each level counts, with its size and height, for the strips around it, and reaches as far as the most
    that counts for its own strip; a heading widens the reach of its neighbours and of nothing else. Spans
    whose reaches do not meet are in different rows, and in the same order by top edge as by middle.
    """
    half = F.col("mid") - F.col("y0")
    far = F.greatest(F.col("size") * ROW_REACH, half, F.lit(0.0))
    mean = F.sum(F.col("size") * F.col("n")) / F.sum("n")
    unit = levels.groupBy(*PAGE).agg(F.greatest(mean, F.lit(1e-6)).alias("unit"))
    placed = levels.join(unit, PAGE).withColumn("far", far)
    strip = lambda y: F.floor(y / (F.col("unit") * STRIP))
    around = F.sequence(strip(F.col("mid") - F.col("far") * 2), strip(F.col("mid") + F.col("far") * 2))
    counted = placed.select(*PAGE, F.explode(around).alias("strip"), "far").groupBy(*PAGE, "strip").agg(F.max("far").alias("reach"))
    cell = F.col("unit") / 8
    return (
        placed.withColumn("strip", strip(F.col("mid")))
        .join(counted, [*PAGE, "strip"])
        .withColumns({"first": F.floor(F.col("mid") / cell), "last": F.floor((F.col("mid") + F.col("reach")) / cell)})
    )


def _slab() -> Column:
    """The part of the page that a span is dealt to; from the span alone, so that it needs no join."""
    scale = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("size", F.lit(1e-6)))))
    return F.floor(F.col("mid") / (scale * SLAB))


def _bands(spans: DataFrame) -> DataFrame:
    """(doc_id, page, y0, y1, size, slab, band, alone), one row per level: spans of different bands can never share a row.

    Reaches that touch form a band, whole in reading order. Only the distinct reaches are put in order, in ranges of
    cells with what the ranges above carry into them, so that no page is ordered by one task. A band is `alone` where
    one slab holds it whole.
    """
    keys = [*PAGE, "first", "last"]
    levels = spans.groupBy(*LEVEL).agg(F.count("*").alias("n")).withColumn("mid", (F.col("y0") + F.col("y1")) / 2)
    on_grid = written(_reaches(levels).select(*LEVEL, "mid", "first", "last"), "levels")
    distinct = on_grid.select(*keys).distinct().withColumn("range", F.floor(F.col("first") / CELLS))
    ends = distinct.groupBy(*PAGE, "range").agg(F.max("last").alias("end"))
    ranges_above = Window.partitionBy(*PAGE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*PAGE, "range", F.max("end").over(ranges_above).alias("carried"))
    above = Window.partitionBy(*PAGE, "range").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = above.rowsBetween(Window.unboundedPreceding, 0)
    met = F.greatest(F.col("carried"), F.max("last").over(above))
    marked = distinct.join(ends, [*PAGE, "range"]).withColumn("gap", F.coalesce(F.col("first") - met > 1, F.lit(True)).cast("int"))
    local = marked.withColumn("here", F.sum("gap").over(upto))
    begun = marked.groupBy(*PAGE, "range").agg(F.sum("gap").alias("gaps"))
    begun = begun.select(*PAGE, "range", F.coalesce(F.sum("gaps").over(ranges_above), F.lit(0)).alias("before"))
    bands = local.join(begun, [*PAGE, "range"]).select(*keys, (F.col("before") + F.col("here")).alias("band"))
    placed = on_grid.withColumn("slab", _slab()).join(bands, keys)
    held = placed.groupBy(*PAGE, "band").agg((F.min("slab") == F.max("slab")).alias("alone"))
    return placed.join(held, [*PAGE, "band"]).select(*LEVEL, "slab", "band", "alone")


def _members(spans: DataFrame) -> DataFrame:
    """(doc_id, page, band, members): the spans of each band in reading order.

    Spans cross the network once, dealt by slab together with the bands of their levels; what lies in a slab is put together there.
    Only spans of a band that lies in several slabs meet in another shuffle, by band.
    """
    bands = written(_bands(spans), "bands")
    # What a line has in common stands together, which packs better.
    dealt = spans.select(*LEVEL, _slab().alias("slab"), "x0", "x1", "text").unionByName(bands, allowMissingColumns=True)
    dealt = dealt.select(*LEVEL, "slab", "band", "alone", "x0", "x1", "text").repartition(*PAGE, "slab").withColumn("mid", (F.col("y0") + F.col("y1")) / 2)
    level_first = Window.partitionBy(*PAGE, "slab", "y0", "y1", "size").orderBy(F.col("band").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumns({c: F.first(c).over(level_first) for c in ("band", "alone")}).filter("text is not null and band is not null")
    member = F.struct("y0", "x0", "mid", "size", "x1", "y1", "text")
    gathered = F.array_sort(F.collect_list(member)).alias("members")
    whole = found.filter("alone").groupBy(*PAGE, "slab", "band").agg(gathered).drop("slab")
    if bands.filter("not alone").isEmpty():
        return whole
    return whole.unionByName(found.filter("not alone").groupBy(*PAGE, "band").agg(gathered))


def _row_starts(members: Column) -> Column:
    """Where the rows of a band begin among its spans in top-edge order.

    A span joins the current row when its middle lies within reach of the row's first span; the
    reach grows with the largest font of the row. The anchor depends on what came before, so this
    is a fold over the band.
    """
    none = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0.0).alias("anchor"), F.lit(DEFAULT_SIZE).alias("size"), F.lit(0).alias("at"), none.alias("starts")
    )

    def step(acc: Column, s: Column) -> Column:
        near = F.abs(s["mid"] - acc["anchor"]) <= F.greatest(s["size"], acc["size"]) * ROW_REACH
        joins = (acc["at"] > 0) & near
        at = acc["at"] + 1
        return F.struct(
            F.when(joins, acc["anchor"]).otherwise(s["mid"]).alias("anchor"),
            F.when(joins, F.greatest(acc["size"], s["size"])).otherwise(s["size"]).alias("size"),
            at.alias("at"),
            F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(at))).alias("starts"),
        )

    return F.aggregate(members, start, step, lambda acc: acc["starts"])


def _banded_rows(spans: DataFrame) -> DataFrame:
    """(doc_id, page, band, row, members): the non-blank spans row by row."""
    size = F.coalesce("size", F.lit(DEFAULT_SIZE))
    solid = spans.filter(~blank(F.col("text"))).withColumns({"size": size, "mid": (F.col("y0") + F.col("y1")) / 2})
    begun = _members(solid).withColumn("starts", _row_starts(F.col("members")))
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("members") + 1)
    rows = F.transform("starts", lambda s, i: F.slice("members", s, end(i) - s))
    return begun.select(*PAGE, "band", F.posexplode(rows).alias("at", "members")).select(
        *PAGE, "band", (F.col("at") + 1).alias("row"), "members"
    )


def span_rows(spans: DataFrame) -> DataFrame:
    """Non-blank spans with their (band, row) on the page."""
    return _banded_rows(spans).select(*PAGE, "band", "row", F.explode("members").alias("m")).select(*PAGE, "band", "row", "m.*")


def _line_text(members: Column, height: Column) -> Column:
    """Spans of one row, already from left to right; a wide gap becomes one blank."""
    before = F.concat(F.array(F.get(members, F.lit(0))), F.slice(members, 1, F.size(members) - 1))

    def piece(s: Column, b: Column) -> Column:
        wide = (s["x0"] - b["x1"] > height * WORD_GAP) & ~b["text"].endswith(" ")
        return F.concat(F.when(wide, " ").otherwise(""), s["text"])

    return trimmed(F.array_join(F.zip_with(members, before, piece), ""))


def span_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, band, row, line): table rows stay in one line; (band, row) orders a page.

    Rows are ordered and measured before they are unpacked, so that both are plain columns where
    the text is put together, not expressions evaluated again for every span.
    """
    across = F.array_sort(F.transform("members", lambda m: F.struct(m["x0"], m["y0"], m["x1"], m["y1"], m["text"])))
    height = F.array_max(F.transform("members", lambda m: m["y1"] - m["y0"]))
    measured = F.explode(F.array(F.struct(across.alias("members"), height.alias("height"))))
    rows = _banded_rows(spans).select(*PAGE, "band", "row", measured.alias("m"))
    line = _line_text(F.col("m.members"), F.col("m.height"))
    return rows.select(*PAGE, "band", "row", line.alias("line")).filter(F.col("line") != "")


def document_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, pages, text): the lines of a document joined, an empty line between pages."""
    page = F.struct("band", "row", "line")
    pages = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(page)).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    docs = pages.select(*PAGE, text.alias("text")).groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps")
    )
    return docs.select("doc_id", "pages", F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n").alias("text"))
