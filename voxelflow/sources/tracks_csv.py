"""Track tables from CSV files, with the format's own rules.

Lines are trimmed, blank ones dropped, fields split at commas without quoting;
a row has exactly eight.  A header names track_id, start, t, x, y, z and a in
any order; without one the places 0, 2 to 6 count.  Lines end at a line feed, with or without a carriage return.  A row whose t, x, y and z
are blank is a break.  Anything else that isn't a finite number is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import finite_number, natural_key

FIELDS = ("track_id", "start", "t", "x", "y", "z", "a")
POSITIONS = {"track_id": 0, "t": 2, "x": 3, "y": 4, "z": 5, "a": 6}


#: What a line loses at its ends.
BLANK = " \t\r\f\v\ufeff"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, track_set, line_no, fields and header (null without one); line numbers count lines that aren't blank.

    A file is read in splits.  A first pass counts each split's lines and keeps its
    first one; a line's number is its place in its split plus the lines of the
    splits before, so no file is one row or one task.  Files are sets of tracks of
    their own, numbered in the natural order of their paths.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    place = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.btrim("value", F.lit(BLANK)).alias("line"))
    lines = place.where("line <> ''").withColumn("at", F.monotonically_increasing_id())  # grows by one from line to line inside a split
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min_by("line", "at").alias("line"))
    w = Window.partitionBy("file").orderBy("split")
    files = splits.select("file").distinct()
    files = files.select("file", F.concat(F.lit("track-set-"), F.row_number().over(Window.orderBy(natural_key(F.col("file")), "file")).cast("string")).alias("track_set"))
    head = F.transform(F.split(F.lower(F.first("line").over(w)), ","), lambda x: F.trim(x))
    named = F.when(F.size(F.array_intersect(head, F.array(*map(F.lit, FIELDS)))) == len(FIELDS), head)
    earlier = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", (earlier - F.col("first")).alias("shift"), named.alias("header")).join(files, "file")
    fields = lines.join(starts, ["file", "split"]).select("file", "track_set", (F.col("at") + F.col("shift")).alias("line_no"), F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("fields"), "header")
    wrong = F.raise_error(F.concat(F.lit("row "), F.col("line_no").cast("string"), F.lit(" does not have 8 columns")))
    return fields.withColumn("fields", F.when(F.size("fields") == 8, F.col("fields")).otherwise(wrong.cast("array<string>")))


def parse(lines: DataFrame, one_based: bool = False) -> DataFrame:
    """Rows as ``track_rows``: file, track_set, row_idx, source_track_id, is_break, time, x, y, z, amplitude."""
    headed = F.col("header").isNotNull()
    rows = lines.where(~headed | (F.col("line_no") > 0))

    def raw(name: str):
        by_name = F.try_element_at("fields", F.array_position("header", name).cast("int"))
        by_place = F.element_at("fields", POSITIONS[name] + 1) if name in POSITIONS else F.lit("0")
        return F.when(headed, by_name).otherwise(by_place)

    def number(name: str):
        bad = F.raise_error(F.concat(F.lit(f"invalid {name} value "), raw(name))).cast("double")
        return F.coalesce(finite_number(raw(name)), bad)

    blank = (raw("t") == "") & (raw("x") == "") & (raw("y") == "") & (raw("z") == "")
    only = lambda c: F.when(~blank, c)
    start = F.when(headed, number("start")).otherwise(0.0)
    zero = number("t") - (1 if one_based else 0)
    return rows.select(
        "file",
        "track_set",
        F.col("line_no").cast("long").alias("row_idx"),
        number("track_id").cast("long").alias("source_track_id"),
        blank.alias("is_break"),
        only(F.greatest(F.lit(0.0), start + zero)).alias("time"),
        only(number("x")).alias("x"),
        only(number("y")).alias("y"),
        only(number("z")).alias("z"),
        only(F.greatest(F.lit(0.0), number("a"))).alias("amplitude"),
    )


def read_tracks(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    return parse(read_lines(spark, path), one_based)
