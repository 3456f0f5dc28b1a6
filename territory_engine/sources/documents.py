"""Large JSON documents read in splits.

A document ``{"key": ..., "values": [{...}, {...}, ...]}`` of any size may stand on one line, so it cannot be split
at line ends. It is read as text that ends at every ``}`` instead, which Spark's text source splits by
byte ranges. Whether a piece begins inside a string, and how deep in brackets, follows from all pieces before
it. Both are prefix sums of an associative summary (does the piece turn the quote state; how does it change the
depth, if it begins outside a string and if inside), so they are computed in two levels: within each
split, and over one row a split.

A JSON escape never stands before ``}``, so an escape is never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _net(text: Column) -> Column:
    """Opening less closing brackets of a text without strings."""
    length = F.length(text)
    return (length - F.length(F.translate(text, "{[", ""))) - (length - F.length(F.translate(text, "}]", "")))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the documents under ``path``: file, split, n (order in the split), text (with its ``}``), quoted (does it
    begin in a string), depth (in which it begins) and after (in which it ends; null if that is in a string)."""
    read = spark.read.option("lineSep", "}").text(path)
    plain = F.regexp_replace("text", r"\\.", "")
    parts = F.split("plain", '"')
    summary = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("n"), F.concat("value", F.lit("}")).alias("text")
    ).withColumn("plain", plain).select(
        "file", "split", "n", "text", ((F.size(parts) - 1) % 2).alias("turns"),
        _net(F.concat_ws("", F.filter(parts, lambda _, i: i % 2 == 0))).alias("net_outside"),
        _net(F.concat_ws("", F.filter(parts, lambda _, i: i % 2 == 1))).alias("net_inside"))
    # one split's pieces lie in one task's window: a split is of bounded size (spark.sql.files.maxPartitionBytes)
    here = Window.partitionBy("file", "split").orderBy("n")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    turned = summary.withColumn("turned", F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2)
    either = {  # the change of depth if the split begins outside a string, and if inside
        0: F.when(F.col("turned") == 0, F.col("net_outside")).otherwise(F.col("net_inside")),
        1: F.when(F.col("turned") == 0, F.col("net_inside")).otherwise(F.col("net_outside"))}
    splits = turned.groupBy(F.col("file").alias("of_file"), F.col("split").alias("of_split")).agg(
        F.sum("turns").alias("turns"), F.sum(either[0]).alias("net_0"), F.sum(either[1]).alias("net_1"))
    before = Window.partitionBy("of_file").orderBy("of_split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    begun = splits.withColumn("begins", (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).cast("int")).withColumn(
        "net", F.when(F.col("begins") == 0, F.col("net_0")).otherwise(F.col("net_1"))).select(
        "of_file", "of_split", "begins", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("base"))
    met = turned.join(begun, (F.col("file") == F.col("of_file")) & (F.col("split") == F.col("of_split")))
    net = F.when(F.col("begins") == 0, either[0]).otherwise(either[1])
    depth = F.col("base") + F.coalesce(F.sum(net).over(earlier), F.lit(0))
    ended = ((F.col("begins") + F.col("turned") + F.col("turns")) % 2) == 0
    return met.select("file", "split", "n", "text", ((F.col("begins") + F.col("turned")) % 2 == 1).alias("quoted"), depth.alias("depth"),
                      F.when(ended, depth + net).alias("after"))


def array_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, element) of the objects in the documents' arrays at level 2, and (file, text) of what lies around the arrays.

    An element that is one piece goes on as it is; pieces of an element with braces in it (nested objects, or braces in
    strings) are put together by its number, also over the border of two splits. A document holds one such
    array; an empty array and an empty file have no elements.
    """
    head = F.regexp_extract("text", r"(?s)^(.*?\[)\s*\{", 1)  # up to the array's bracket, in the piece that opens it
    opens = ~F.col("quoted") & (F.col("depth") < 2) & (head != "") & (F.col("after").isNull() | (F.col("after") >= 2))
    between = ~F.col("quoted") & (F.col("depth") == 2)  # begins behind an element
    ends = F.coalesce(F.col("after") == 2, F.lit(False))
    kind = (F.when(ends & (opens | between), "whole").when(between & (F.col("after") < 2), "around")
            .when(opens | between | F.col("quoted") | (F.col("depth") > 2), "part").otherwise("around"))
    text = F.when(opens, F.substring(F.col("text"), F.length(head) + 1, F.length("text"))).otherwise(F.col("text"))
    cut = pieces(spark, path).select("file", "split", "n", ends.alias("ends"), kind.alias("kind"), text.alias("element"),
                                     F.when(opens, head).otherwise(F.col("text")).alias("text"), opens.alias("opens"))
    whole = cut.where("kind = 'whole'").select("file", "element")
    # the number of an element that is several pieces: how many of its file ended before
    earlier = Window.partitionBy("file", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("of_file").orderBy("of_split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = cut.groupBy(F.col("file").alias("of_file"), F.col("split").alias("of_split")).agg(F.sum(F.col("ends").cast("int")).alias("ended"))
    base = splits.select("of_file", "of_split", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("base"))
    numbered = cut.withColumn("ended", F.coalesce(F.sum(F.col("ends").cast("int")).over(earlier), F.lit(0)))
    parts = numbered.where("kind = 'part'").join(base, (F.col("file") == F.col("of_file")) & (F.col("split") == F.col("of_split")))
    joined = parts.groupBy("file", (F.col("base") + F.col("ended")).alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("split", "n", "element"))).alias("parts"))  # the pieces of one element
    elements = whole.unionByName(joined.select("file", F.concat_ws("", F.col("parts.element")).alias("element")))
    around = cut.where((F.col("kind") == "around") | F.col("opens")).select("file", "text")
    return elements.select("file", F.regexp_replace("element", r"^[\s,]+", "").alias("element")), around
