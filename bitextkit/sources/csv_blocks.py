"""CSV files with line breaks inside quotes, read by many tasks.

Whether a line begins a record depends on all quotes before it in its file.  So
every line is read under both assumptions, that it begins outside and inside a
quoted cell; what it does to that state is one of four maps (keep, change, always
outside, always inside).  Maps compose: the state after some lines is that of the
last constant map, changed as often as lines after it change it.  Three scans
follow: inside each block (the lines of one file split, one task), over the
summaries of a file's blocks (one row a block), and again inside the blocks with the
state known.  Lines of a record that is more than one line meet by a shuffle on
the place of its first line, also across blocks; all other lines stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Cells: a quoted one with what follows its last quote, or one that begins without a quote.
_QUOTED = '"(?:[^"]|"")*+"[^,]*+'
_CELLS = f'(?:(?:{_QUOTED}|[^",][^,]*+|),)*+'
_OPEN = '"(?:[^"]|"")*+'
#: A line that ends inside quotes, if it begins outside (inside) of them.
ENDS_INSIDE = f"^{_CELLS}{_OPEN}$"
STAYS_INSIDE = f'^(?:[^"]|"")*+(?:"[^,]*+,{_CELLS}{_OPEN})?$'


def _states(df: DataFrame, by: list[str], order: list[str], outside: str, inside: str, suffix: str) -> DataFrame:
    """Adds the running maps: ``o{suffix}`` and ``i{suffix}``, the states after a row
    if the first row of its group began outside and inside."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col(outside) == F.col(inside)
    change = F.when(~same & (F.col(outside) == 1), 1).otherwise(0)
    df = df.withColumn("_flips", F.sum(change).over(w))
    last = F.last(F.when(same, F.struct(F.col(outside).alias("s"), F.col("_flips").alias("f"))), ignorenulls=True).over(w)
    df = df.withColumn("_last", last)
    base, since = F.col("_last.s"), F.col("_flips") - F.coalesce(F.col("_last.f"), F.lit(0))
    return df.withColumns({f"o{suffix}": (F.coalesce(base, F.lit(0)) + since) % 2,
                           f"i{suffix}": (F.coalesce(base, F.lit(1)) + since) % 2}).drop("_flips", "_last")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, record): the records of CSV files as texts, with the
    place of their first line; line breaks inside are ``\\n``, as the one-task
    reader gives them.  Blank records are left out, headers are not.  ``record`` is
    complete but for an unclosed quote at the end of a file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("text"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.withColumns({"_o": F.col("text").rlike(ENDS_INSIDE).cast("int"),
                               "_i": F.col("text").rlike(STAYS_INSIDE).cast("int")})
    lines = _states(lines, ["file", "block"], ["line"], "_o", "_i", "_run")
    blocks = lines.groupBy("file", "block").agg(F.max_by("o_run", "line").alias("_bo"), F.max_by("i_run", "line").alias("_bi"))
    blocks = _states(blocks, ["file"], ["block"], "_bo", "_bi", "_all")               # one row a block
    before = Window.partitionBy("file").orderBy("block")
    blocks = blocks.select("file", "block", F.coalesce(F.lag("o_all").over(before), F.lit(0)).alias("_enter"))
    lines = lines.join(F.broadcast(blocks), ["file", "block"])
    run = Window.partitionBy("file", "block").orderBy("line")
    ends_inside = F.when(F.col("_enter") == 0, F.col("o_run")).otherwise(F.col("i_run"))
    lines = lines.withColumn("_inside", ends_inside)
    lines = lines.withColumn("_begins", F.coalesce(F.lag("_inside").over(run), F.col("_enter")) == 0)
    whole = lines.filter("_begins AND _inside = 0").select("file", "block", "line", F.col("text").alias("record"))
    parts = lines.filter("NOT (_begins AND _inside = 0)").select(
        "file", "block", "line", "text", F.when(F.col("_begins"), F.struct("block", "line")).alias("_first"))
    # the first line of a record: the last beginning before, in this block or the blocks before it
    heads = parts.groupBy("file", "block").agg(F.max("_first").alias("_tail"))
    heads = heads.select("file", "block", F.max("_tail").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_prior"))
    parts = parts.join(F.broadcast(heads), ["file", "block"])
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_first", F.coalesce(F.max("_first").over(upto), F.col("_prior")))
    many = parts.groupBy("file", "_first").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"]), "\n").alias("record"))
    many = many.select("file", "_first.block", "_first.line", "record")
    return whole.unionByName(many).filter(F.trim("record") != "")


def without_headers(records: DataFrame) -> DataFrame:
    """The records but the first of every file."""
    first = records.groupBy("file").agg(F.min(F.struct("block", "line")).alias("_head"))    # one row a file
    return records.join(F.broadcast(first), "file").filter(
        F.struct("block", "line") > F.col("_head")).drop("_head")
