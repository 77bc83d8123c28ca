"""Multi-line log entries from lines.

Input is a frame of lines `(path, block, pos, value)`: lines of one file in the order
`(block, pos)`. A block is a bounded run of lines (a file split). All windows run inside a
block; what an earlier block hands on to a later one (line count, open entry) comes
from a table with one row per block.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbraid.functions.times import TOMCAT_TS
from logbraid.session import broadcast_within, cut

#: One row per split of a file is broadcast up to this number of splits.
BROADCAST_ROWS = 200_000

# Shapes of the first line of an entry.
TOMCAT_HEADER = f"^(?:{TOMCAT_TS})"
POSTGRES_HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) (\S+) \[(\d+)\] ([A-Z]+):\s?(.*)$"


def _blocks_with_counts(local: DataFrame) -> DataFrame:
    """(path, block, n_lines, n_counted, last_row, last_seen, last_head) from numbered lines."""
    return local.groupBy("path", "block").agg(
        F.max("row").alias("n_lines"), F.max("seen").alias("n_counted"), F.max("opened").alias("last")
    ).select("path", "block", "n_lines", "n_counted", F.col("last.row").alias("last_row"), F.col("last.seen").alias("last_seen"), F.col("last.head").alias("last_head"))


def _blocks_by_place(flagged: DataFrame) -> DataFrame:
    """The same without counted lines, from places alone: a block's lines follow each other in `pos` without a gap. Nothing is sorted, and
    only the one header per block that is looked for brings its text along."""
    blocks = flagged.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("pos").alias("last_pos"), F.max(F.when(F.col("header"), F.col("pos"))).alias("header_pos")
    )
    blocks = cut(blocks.withColumn("last_row", F.col("n_lines") - (F.col("last_pos") - F.col("header_pos"))))
    place = blocks.where("header_pos is not null").select("path", "block", F.col("header_pos").alias("pos"))
    heads = flagged.where("header").join(broadcast_within(place, BROADCAST_ROWS), ["path", "block", "pos"]).select("path", "block", F.col("value").alias("last_head"))
    zero = F.lit(0).cast("long")
    return blocks.join(heads, ["path", "block"], "left").select(
        "path", "block", "n_lines", zero.alias("n_counted"), "last_row", F.when(F.col("last_row").isNotNull(), zero).alias("last_seen"), "last_head"
    )


def number_lines(lines: DataFrame, is_header: Column, is_counted: Column, ordinals: bool = True) -> DataFrame:
    """Adds, per line: `line_no` in its file, `entry_line` (line of the header that opens its
    entry, null before the first header), `head` (that header's text) and, with `ordinals`, `ordinal` (how many counted lines of the entry
    come before it). Without them, `pos` must grow by one from line to line of a block, and lines are sorted once."""
    in_block = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    flagged = lines.withColumns({"counted": is_counted, "header": is_header})
    seen = F.count_if("counted").over(in_block) if ordinals else F.lit(0).cast("long")
    local = flagged.withColumns({"row": F.count(F.lit(1)).over(in_block), "seen": seen}).withColumn(
        # Row and count of the last header so far, relative to the block.
        "opened",
        F.last(F.when(F.col("header"), F.struct("row", "seen", F.col("value").alias("head"))), ignorenulls=True).over(in_block),
    )

    blocks = _blocks_with_counts(local) if ordinals else _blocks_by_place(flagged)
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "path",
        "block",
        "last_row",
        "last_seen",
        "last_head",
        F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("n_counted").over(earlier), F.lit(0)).alias("counted_before"),
    )
    carried = F.struct(
        (F.col("lines_before") + F.col("last_row")).alias("line"),
        (F.col("counted_before") + F.col("last_seen")).alias("seen"),
        F.col("last_head").alias("head"),
    )
    blocks = blocks.select(
        "path",
        "block",
        "lines_before",
        "counted_before",
        F.last(F.when(F.col("last_row").isNotNull(), carried), ignorenulls=True).over(earlier).alias("carry"),
    )

    placed = local.join(blocks, ["path", "block"])
    here = F.col("opened").isNotNull()
    entry_line = F.when(here, F.col("lines_before") + F.col("opened.row")).otherwise(F.col("carry.line"))
    entry_seen = F.when(here, F.col("counted_before") + F.col("opened.seen")).otherwise(F.col("carry.seen"))
    return placed.select(
        "path",
        "value",
        "counted",
        "header",
        (F.col("lines_before") + F.col("row")).alias("line_no"),
        entry_line.alias("entry_line"),
        F.when(here, F.col("opened.head")).otherwise(F.col("carry.head")).alias("head"),
        (F.col("counted_before") + F.col("seen") - entry_seen).alias("ordinal"),
    )


def _part(part_lines: int | None) -> Column:
    """Number of the part of its entry that a line is in."""
    return F.lit(0) if part_lines is None else F.floor((F.col("line_no") - F.col("entry_line")) / part_lines)


def _joined(keep: Column, text: Column) -> Column:
    """Kept lines of a group in line order, as one text."""
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("line_no"), text.alias("text")))))
    return F.array_join(F.transform(rows, lambda row: row["text"]), "\n")


def stitch_tomcat(
    lines: DataFrame, header: str = TOMCAT_HEADER, max_lines: int | None = None, part_lines: int | None = None
) -> DataFrame:
    """Records `(path, start_line, end_line, origin, line)`. An entry keeps its lines that are not blank, with
    `max_lines` only the first of them; it ends at the line before the next header, or at
    the end of the file. Each line before the first header is a record of its own. With `part_lines`, an entry of more lines
    becomes several records, each with its own lines and the header, so that no text grows without bound."""
    not_blank = F.regexp_like(F.col("value"), F.lit(r"(?U)\S"))
    numbered = number_lines(lines, F.regexp_like(F.col("value"), F.lit(header)), not_blank, ordinals=max_lines is not None)

    # A line before the first header is its own group.
    opening = F.coalesce("entry_line", "line_no")
    keep = F.col("counted")
    if max_lines is not None:
        keep = keep & (F.col("entry_line").isNull() | (F.col("ordinal") < max_lines))
    part = F.when(F.col("entry_line").isNotNull(), _part(part_lines)).otherwise(0)
    entries = numbered.groupBy("path", opening.alias("opening"), part.alias("part")).agg(
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.max("entry_line").alias("entry_line"),
        F.max(keep).alias("has_text"),
        F.max("head").alias("head"),
        _joined(keep, F.col("value")).alias("line"),
    )
    span = F.when(F.col("entry_line").isNotNull(), F.concat(F.lit("-"), F.col("end_line").cast("string")))
    return entries.where("has_text").select(
        "path",
        "start_line",
        "end_line",
        F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.coalesce(span, F.lit(""))).alias(
            "origin"
        ),
        F.when(F.col("part") > 0, F.concat_ws("\n", "head", "line")).otherwise(F.col("line")).alias("line"),
    )


def stitch_postgres(lines: DataFrame, name: Column, part_lines: int | None = None) -> DataFrame:
    """Raw records of a database server log. Continuation lines are kept whole, blank ones
    too; lines before the first header are dropped. With `part_lines`, an entry of more lines becomes several records with the
    same header, so that no text grows without bound; the record key of a further one ends in its number."""
    value = F.col("value")
    is_header = F.regexp_like(value, F.lit(POSTGRES_HEADER))
    numbered = number_lines(lines, is_header, F.lit(True), ordinals=False).where("entry_line is not null")
    text = F.when(F.col("header"), F.regexp_extract(value, POSTGRES_HEADER, 5)).otherwise(value)
    number = _part(part_lines)
    entries = numbered.groupBy("path", "entry_line", number.alias("number")).agg(
        F.max("head").alias("first"),
        _joined(F.lit(True), text).alias("message"),
    )
    part = lambda n: F.regexp_extract("first", POSTGRES_HEADER, n)
    return entries.select(
        name.alias("origin"),
        F.concat_ws(" ", part(1), part(2)).alias("timestamp"),
        part(4).alias("level"),
        part(3).alias("pid"),
        "message",
        F.concat_ws(":", "path", "entry_line", F.when(F.col("number") > 0, F.col("number"))).alias("record_key"),
    )
