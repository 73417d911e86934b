"""Word boxes → lines → paragraphs, and merging of token ranges kept as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.operators import ordered


BOX = ["page_id", "box_id", "x0", "y0", "x1", "y1"]
BOX_ORDER = ["y0", "x0", "box_id"]


def _grow_lines(boxes: DataFrame) -> DataFrame:
    """Numbers the lines within (page, segment): a box joins the line if it overlaps it enough.

    The line grows with every box, so each step depends on the one before. Sorted rows are
    read as a stream: a task holds one batch and the border of one line.
    """
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, line, top, bottom = None, 0, 0, 0
        for batch in batches:
            numbers = []
            for page, segment, y0, y1 in zip(batch["page_id"], batch["segment"], batch["y0"], batch["y1"]):
                smaller, shared = min(bottom - top, y1 - y0), min(bottom, y1) - max(top, y0)
                if (page, segment) != held:
                    held, line, top, bottom = (page, segment), 0, y0, y1
                elif smaller > 0 and shared >= fv.LINE_OVERLAP_SHARE * smaller:
                    top, bottom = min(top, y0), max(bottom, y1)
                else:
                    line, top, bottom = line + 1, y0, y1
                numbers.append(line)
            yield batch.assign(local=numbers)

    keys = ["page_id", "segment"]
    schema = f"page_id long, box_id long, x0 long, y0 long, x1 long, y1 long, segment long, {ordered.PART} int, local long"
    return boxes.select(*BOX, "segment", ordered.PART).repartition(*keys).sortWithinPartitions(*keys, *BOX_ORDER).mapInPandas(walk, schema)


def word_lines(boxes: DataFrame) -> DataFrame:
    """Boxes with the number of their line on the page.

    A box that starts below everything before it opens a new line whatever the lines look
    like. Pages are cut there, and the pieces are worked on apart, so that a page with very
    many boxes is not one task.
    """
    typed = boxes.select(*[F.col(c).cast("long").alias(c) for c in BOX])
    split = ordered.range_split(typed, ["page_id"], BOX_ORDER)
    reach = ordered.running(split, ["page_id"], BOX_ORDER, F.col("y1"), "_reach", how="max", include_current=False)
    cut = reach.withColumn("_cut", F.coalesce((F.col("y0") >= F.col("_reach")).cast("long"), F.lit(0).cast("long")))
    grown = _grow_lines(ordered.running(cut, ["page_id"], BOX_ORDER, F.col("_cut"), "segment"))
    # lines come in the order of boxes, so segments lie in the ranges of the split as well:
    # only a row per segment is numbered, and joined back where its boxes already are
    keys = ["page_id", "segment"]
    per_segment = grown.groupBy(*keys).agg(F.min(ordered.PART).alias(ordered.PART), (F.max("local") + 1).alias("_lines"))
    before = ordered.running(per_segment, ["page_id"], ["segment"], F.col("_lines"), "_before", include_current=False)
    numbered = grown.drop(ordered.PART).join(before.select(*keys, "_before"), keys)
    return numbered.select(*BOX, (F.coalesce("_before", F.lit(0)) + F.col("local")).cast("int").alias("line"))


def line_boxes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("page_id", "line").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], F.count("*").alias("words"))


def paragraphs(line_rows: DataFrame) -> DataFrame:
    """Lines at most twelve rows below the line before form a paragraph."""
    order = ["y0", "x0", "line"]
    split = ordered.range_split(line_rows, ["page_id"], order)
    gap = ordered.previous(split, ["page_id"], order, "y1", "above").withColumn(
        "_new", F.when(F.col("above").isNull(), 0).otherwise((F.col("y0") - F.col("above") > fv.PARAGRAPH_GAP).cast("int")).cast("long"))
    numbered = ordered.running(gap, ["page_id"], order, F.col("_new"), "n")
    return numbered.groupBy("page_id", "n").agg(
        *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], F.count("*").alias("lines")).withColumns({
            "region_id": F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("-r"), F.col("n").cast("string")),
            "region_type": F.when(F.col("lines") <= 1, "text_line").otherwise("paragraph")})


def merge_range_rows(ranges: DataFrame, group: list[str], gap: int = fv.RANGE_MERGE_GAP) -> DataFrame:
    """(group, start, end) rows merged where they overlap or lie at most ``gap`` apart."""
    order = ["start", "end"]
    split = ordered.range_split(ranges.select(*group, *order).distinct(), group, order)
    reach = ordered.running(split, group, order, F.col("end"), "_reach", how="max", include_current=False)
    marked = reach.withColumn("_new", F.coalesce((F.col("start") > F.col("_reach") + gap).cast("long"), F.lit(0).cast("long")))
    numbered = ordered.running(marked, group, order, F.col("_new"), "_n")
    return numbered.groupBy(*group, "_n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_n")
