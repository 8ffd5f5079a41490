"""Operators over page regions: ordering, columns, bands, separators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind(y: Column, h: Column, page_h: Column, margin: int = 100) -> Column:
    return F.when(y < margin, "header").when(y + h > page_h - margin, "footer").otherwise("body")


def scanlines(regions: DataFrame, samples: int = 10) -> DataFrame:
    """A row for each scan line that meets a region; lines are a tenth of the page apart.

    The lines that a region meets follow from its place, so no join is needed.
    """
    step = F.greatest(F.floor(F.col("page_h") / samples), F.lit(1))
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("page_h").cast("long") - 1, step), lambda s: (s >= F.col("y")) & (s <= F.col("y") + F.col("h")))
    return regions.withColumn("scan_y", F.explode(met))


def column_gaps(regions: DataFrame, least: int = 30) -> DataFrame:
    """page_id, page_w, scan_y, gap_x: middles of the gaps between neighbours on a scan line."""
    line = Window.partitionBy("page_id", "scan_y").orderBy("x", "region_id")
    ends = scanlines(regions).select("page_id", "page_w", "scan_y", (F.col("x") + F.col("w")).alias("end"), F.lead("x").over(line).alias("next"))
    return ends.where(F.col("next") - F.col("end") >= least).select("page_id", "page_w", "scan_y", F.floor((F.col("end") + F.col("next")) / 2).alias("gap_x"))


def detect_columns(regions: DataFrame, least: int = 30, apart: int = 100, samples: int = 3) -> DataFrame:
    """page_id, column_index, x_start, x_end: clusters of gaps seen often enough part the page."""
    page = Window.partitionBy("page_id").orderBy("gap_x", "scan_y")
    gaps = column_gaps(regions, least).withColumn("new", (F.col("gap_x") - F.lag("gap_x").over(page) >= apart).cast("int"))
    clustered = gaps.withColumn("cluster", F.coalesce(F.sum("new").over(page), F.lit(0)))
    cuts = clustered.groupBy("page_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.percentile("gap_x", F.lit(0.5)).cast("int").alias("cut"))
    cuts = cuts.where(F.col("n") >= samples).groupBy("page_id").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    pages = regions.groupBy("page_id").agg(F.max("page_w").cast("int").alias("page_w"))
    edges = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array("page_w"))
    edged = pages.join(cuts, "page_id", "left").select("page_id", edges.alias("edges"))
    return edged.select("page_id", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("column_index")).select(
        "page_id", "column_index", F.get("edges", F.col("column_index")).alias("x_start"), F.get("edges", F.col("column_index") + 1).alias("x_end")
    )


def assign_columns(regions: DataFrame, columns: DataFrame) -> DataFrame:
    """regions with column_index: the first column that holds the middle, else 0. A page's columns travel as one array."""
    per_page = columns.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("column_index", "x_start", "x_end"))).alias("cols"))
    middle = F.col("x") + F.floor(F.col("w") / 2)
    inside = F.filter("cols", lambda c: (c["x_start"] <= middle) & (middle <= c["x_end"]))
    return regions.join(per_page, "page_id", "left").withColumn("column_index", F.coalesce(F.get(inside, F.lit(0))["column_index"], F.lit(0))).drop("cols")


def reading_order(regions: DataFrame) -> DataFrame:
    """regions (with column_index) with region_kind and reading_order from 0: headers, body by column, footers."""
    named = regions.withColumn("region_kind", kind(F.col("y"), F.col("h"), F.col("page_h")))
    group = F.when(F.col("region_kind") == "header", 0).when(F.col("region_kind") == "body", 1).otherwise(2)
    page = Window.partitionBy("page_id").orderBy(group, F.when(group == 1, F.col("column_index")), "y", "region_id")
    return named.withColumn("reading_order", F.row_number().over(page) - 1)


def reading_text(ordered: DataFrame) -> DataFrame:
    """page_id and text: region texts in order, a blank line where the column grows against the region before."""
    page = Window.partitionBy("page_id").orderBy("reading_order")
    body = F.concat(F.when(F.col("column_index") > F.lag("column_index").over(page), "\n\n").otherwise(""), F.trim("text"), F.lit("\n"))
    pieces = ordered.select("page_id", F.struct("reading_order", body.alias("line")).alias("p"), F.trim(F.coalesce("text", F.lit(""))).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.col("p")))), lambda p: p["line"]), "")
    return pieces.groupBy("page_id").agg(joined.alias("text"))


def classify_regions(boxes: DataFrame) -> DataFrame:
    """boxes (x1, y1, x2, y2) that are large enough, with region_type and position."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ratio = F.when(h > 0, w / h).otherwise(0.0)
    names = (
        F.when(F.col("y1") < 100, "header")
        .when(F.col("y2") > F.col("page_h") - 100, "footer")
        .when((F.col("y1") < F.col("page_h") * 0.2) & (w > F.col("page_w") * 0.6) & (h > 40), "title")
        .when((w > F.col("page_w") * 0.5) & (h > 25) & (h < 60), "heading")
        .when((ratio > 0.5) & (ratio < 2.0) & (w > 200) & (h > 100), "table")
        .otherwise("text")
    )
    position = F.when(F.col("region_type") == "text", "body").otherwise(F.col("region_type"))
    return boxes.where((w >= 50) & (h >= 20)).withColumn("region_type", names).withColumn("position", position)


def cluster_columns(typed: DataFrame, apart: int = 30) -> DataFrame:
    """page_id and its column starts: a middle further than `apart` from the last start begins a column."""
    middle = F.floor((F.col("x1") + F.col("x2")) / 2).cast("long")
    xs = typed.where(F.col("region_type") == "text").groupBy("page_id").agg(F.sort_array(F.collect_list(middle)).alias("xs"))
    none = F.array().cast("array<bigint>")
    step = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > apart), F.concat(acc, F.array(x))).otherwise(acc)
    return xs.select("page_id", F.aggregate("xs", none, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x))).alias("starts"))


def nearest_column(typed: DataFrame, starts: DataFrame) -> DataFrame:
    """typed with column_id: for text regions, the nearest column start, the first of equals; else 0."""
    middle = F.floor((F.col("x1") + F.col("x2")) / 2)
    near = F.array_min(F.transform("starts", lambda s, i: F.struct(F.abs(middle - s).alias("d"), i.alias("i"))))["i"]
    return typed.join(starts, "page_id", "left").withColumn("column_id", F.when(F.col("region_type") == "text", F.coalesce(near, F.lit(0))).otherwise(0)).drop("starts")


def layout_order(typed: DataFrame) -> DataFrame:
    """typed (with column_id) with layout_order from 0 by type, text by column; other types are -1."""
    rank = F.array_position(F.array(*map(F.lit, ("header", "title", "heading", "text", "table", "footer"))), F.col("region_type"))
    page = Window.partitionBy("page_id").orderBy(F.when(rank == 0, 99).otherwise(rank), F.when(rank == 4, F.col("column_id")), "y1", "region_id")
    return typed.withColumn("layout_order", F.when(rank == 0, -1).otherwise(F.row_number().over(page) - 1))


def analyze_layout(boxes: DataFrame) -> DataFrame:
    """Classes, columns and order of a page's boxes."""
    typed = classify_regions(boxes)
    return layout_order(nearest_column(typed, cluster_columns(typed)))


def filter_regions(regions: DataFrame) -> DataFrame:
    """Regions large enough for their page; large pages are newspapers with small print."""
    large = (F.col("page_w") > 2000) | (F.col("page_h") > 2000)
    area = F.col("page_w") * F.col("page_h") * F.when(large, 0.00005).otherwise(0.0005)
    ok = (F.col("w") * F.col("h") >= area) & (F.col("w") >= F.when(large, 15).otherwise(30)) & (F.col("h") >= F.when(large, 10).otherwise(15))
    return regions.where(ok)


def horizontal_lines(lines: DataFrame) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return lines.where((dx != 0) & (F.degrees(F.abs(F.atan(dy / F.nullif(dx, F.lit(0))))) < 10))


def merge_lines(lines: DataFrame, apart: int = 20) -> DataFrame:
    """page_id and separator_ys: a running middle takes in heights near it."""
    ys = lines.groupBy("page_id").agg(F.sort_array(F.collect_set(F.floor((F.col("y1") + F.col("y2")) / 2).cast("long"))).alias("ys"))
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.get("ys", F.lit(0)).alias("now"))
    step = lambda acc, y: F.when(y - acc["now"] <= apart, F.struct(acc["out"].alias("out"), F.floor((acc["now"] + y) / 2).cast("long").alias("now"))).otherwise(
        F.struct(F.concat(acc["out"], F.array(acc["now"])).alias("out"), y.alias("now"))
    )
    rest = F.slice("ys", F.lit(2), F.greatest(F.size("ys") - 1, F.lit(0)))
    return ys.select("page_id", F.aggregate(rest, start, step, lambda acc: F.concat(acc["out"], F.array(acc["now"]))).alias("separator_ys"))


def crop_intervals(merged: DataFrame, height: int, margin: int = 10, least: int = 50) -> DataFrame:
    """page_id, crop_no, y1, y2 between separators, widened by the margin; low ones go."""
    h = F.lit(height).cast("long")
    edges = merged.select("page_id", F.concat(F.array(F.lit(0).cast("long")), "separator_ys", F.array(h)).alias("e"))
    pairs = edges.select("page_id", F.posexplode(F.zip_with(F.slice("e", F.lit(1), F.size("e") - 1), F.slice("e", F.lit(2), F.size("e") - 1), lambda a, b: F.struct(F.greatest(F.lit(0), a - margin).alias("y1"), F.least(h, b + margin).alias("y2")))).alias("at", "c"))
    kept = pairs.where(F.col("c.y2") - F.col("c.y1") > least)
    return kept.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1).alias("crop_no"), "c.y1", "c.y2")


def page_bands(pages: DataFrame) -> DataFrame:
    """page_id, band, x1, y1, x2, y2: header, its halves, body; ends are inclusive."""
    w, h = F.col("page_w"), F.col("page_h")
    top, half = F.floor(0.2 * h), F.floor(0.5 * w)
    not_below = lambda c: F.greatest(F.lit(0), c)
    band = lambda name, *box: F.struct(F.lit(name).alias("band"), *[c.cast("long").alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)])
    zero = F.lit(0)
    bands = F.array(
        band("header", zero, zero, w - 1, not_below(top - 1)),
        band("ref", zero, zero, not_below(half - 1), not_below(top - 1)),
        band("date", half, zero, w - 1, not_below(top - 1)),
        band("body", zero, top, w - 1, h - 1),
    )
    return pages.select("page_id", "page_w", "page_h", F.explode(bands).alias("b")).select("page_id", "page_w", "page_h", "b.*")


def body_regions(named: DataFrame) -> DataFrame:
    """Regions named body, or all of a page that has none."""
    has = F.max((F.col("name") == "body").cast("int")).over(Window.partitionBy("page_id"))
    return named.withColumn("has", has).where((F.col("has") == 0) | (F.col("name") == "body")).drop("has")


def clamp_regions(boxes: DataFrame, least: int = 8) -> DataFrame:
    """Boxes cut to the page (ends inclusive); empty and tiny ones go."""
    cut = lambda c, size: F.greatest(F.lit(0), F.least(F.col(c), F.col(size) - 1)).alias(c)
    inside = boxes.select("region_id", "page_id", cut("x1", "page_w"), cut("y1", "page_h"), cut("x2", "page_w"), cut("y2", "page_h"))
    return inside.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (F.col("x2") - F.col("x1") + 1 >= least) & (F.col("y2") - F.col("y1") + 1 >= least))


def region_text(tokens: DataFrame, key: str, least: float = 30.0) -> DataFrame:
    """Words over a confidence, in order, and their mean confidence."""
    good = F.when(F.col("conf") > least, F.struct(F.col("pos"), F.col("text").alias("line")))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(good)), lambda p: p["line"]), " ")
    return tokens.groupBy(key).agg(words.alias("text"), F.coalesce(F.avg(F.when(F.col("conf") > least, F.col("conf"))), F.lit(0.0)).alias("confidence"))


def segment_naming(regions: DataFrame, ranges: int = 200) -> DataFrame:
    """File names of crops by global order; nulls come last, and a region without a page has no name.

    Regions are dealt by ranges of pages; a region's number is its rank in its range plus the sizes of the ranges before,
    and only those sizes meet in one task. The bounds are values, fixed before (approximate quantiles): a range found
    anew, by a sample or by where a row lies, need not be the same in each branch of the plan.
    """
    cuts = regions.agg(F.percentile_approx("page_id", [k / ranges for k in range(1, ranges)])).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(cuts)))).cast(f"array<{regions.schema['page_id'].dataType.simpleString()}>")
    below = F.size(F.filter(bounds, lambda b: b < F.col("page_id")))
    ranged = regions.select("region_id", "page_id", F.when(F.col("page_id").isNull(), len(cuts) + 1).otherwise(below).alias("range"))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    order = [F.asc_nulls_last("page_id"), F.asc_nulls_last("region_id")]
    ranked = ranged.withColumn("inside", F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1)
    within = F.col("inside") - F.min("inside").over(Window.partitionBy("range", "page_id"))
    ranked = ranked.withColumn("within", within).join(F.broadcast(before), "range")
    number = F.col("before") + F.col("inside")
    name = F.format_string("segment_%04d_page%02d_region%02d.png", number, F.col("page_id"), F.col("within"))
    return ranked.select("region_id", F.when(F.col("page_id").isNotNull(), name).alias("file_name"))
