"""Claim batch files (S1–S4, U4): JSON objects, each an envelope ``{batch, workerTimestamp,
workerId}`` or a bare claim at top level. Read with an explicit schema, in parallel by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLAIM_COLUMNS
from ..schema import BATCH_FILE


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_INNERMOST = r"[\{\[][^\{\}\[\]]*+[\}\]]"
# a line break between two root values: inside a JSON value a brace is never followed by a brace
_BETWEEN = r"(?<=\})\s*[\r\n]\s*(?=\{)"
# white space and what a line may end with
_SPACE = " \t\n\x0b\f\r\x85\u2028\u2029"
# between a run of opening and a run of closing brackets, or the other way round
_TURN = r"(?<=\()(?=\))|(?<=\))(?=\()"


def _one_value(text: Column) -> Column:
    """Is the text exactly one JSON value, nested to any depth? Strings are replaced by a digit, then the
    innermost brackets; of the brackets left, runs of one kind are added up to the depth after
    each run. One value starts and ends with a bracket, and the depth is zero after the last run only.
    Every step reads the text once, however deep it is. (Which bracket closes which is left to the parser.)
    """
    rest = F.regexp_replace(F.regexp_replace(text, _STRING, "0"), _INNERMOST, "0")
    brackets = F.translate(F.regexp_replace(rest, r"[^\{\}\[\]]++", ""), "{[}]", "(())")
    runs = F.split(brackets, _TURN)
    depth = F.aggregate(
        F.slice(runs, 2, F.size(runs)), F.length(F.get(runs, F.lit(0))),
        lambda depth, run: F.when(depth <= 0, F.lit(-1))  # it was over before this run
        .otherwise(depth + F.when(run.startswith("("), F.length(run)).otherwise(-F.length(run))))
    # the end alone tells most unfinished objects
    last = F.substring(F.rtrim(text, F.lit(_SPACE)), -1, 1).isin("}", "]", "0", '"')
    nested = rest.rlike(r"^\s*[\{\[]") & rest.rlike(r"[\}\]]\s*$") & (depth == 0)
    return F.when(last, rest.rlike(r"^\s*0\s*$") | nested).otherwise(F.lit(False))


def _parse(text: DataFrame, mode: str, lines: bool) -> DataFrame:
    """Parse objects with the fixed schema; ``_obj`` tells apart objects that share a file (their
    position, or for line-wise reading a hash of the line).

    A whole file may hold any number of objects, each starting on a line of its own. What is
    not exactly one value (trailing text, two values on a line, an unfinished object) is
    unreadable as a whole, so no part of it is lost.
    """
    files = text.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("_file"), "value")
    if lines:
        pieces = files.select("_file", F.xxhash64("value").alias("_obj"), F.col("value").alias("_text"))
    else:
        pieces = files.select("_file", F.posexplode(F.split("value", _BETWEEN)).alias("_obj", "_text")).withColumn(
            "_obj", F.col("_obj").cast("long"))
    unreadable = F.lit("{") if mode == "PERMISSIVE" else F.raise_error(F.concat(F.lit("unreadable object in "), F.col("_file"))).cast("string")
    opts = {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"}
    # a filter on what a generator gives is not moved below it: each object is checked and parsed once
    checked = pieces.select("_file", "_obj", "_text", F.explode(F.array(_one_value(F.col("_text")))).alias("_whole"))
    parsed = checked.select("_file", "_obj", "_text", "_whole", F.explode(F.array(
        F.from_json(F.when(F.col("_whole"), F.col("_text")).otherwise(unreadable), BATCH_FILE, opts))).alias("o"))
    fields = [f.name for f in BATCH_FILE.fields if f.name != "_corrupt_record"]
    return parsed.select(*[F.col(f"o.{f}").alias(f) for f in fields],
                         F.when(F.col("_whole"), F.col("o._corrupt_record")).otherwise(F.col("_text")).alias("_corrupt_record"),
                         "_file", "_obj")


def read_batch_files(spark: SparkSession, path: str, mode: str = "PERMISSIVE", lines: bool = False) -> DataFrame:
    """Every batch object under ``path`` with its file path.

    By default a file is read whole and may hold one (possibly pretty-printed) object or many,
    one after the other (what ``sinks.publish.claim_envelopes`` writes); with ``lines`` each line
    is an object and large files are read in splits. ``PERMISSIVE`` keeps unreadable objects in
    ``_corrupt_record`` (split them off with ``quarantine``); ``FAILFAST`` stops on the first one.
    """
    return _parse(spark.read.text(path, wholetext=not lines), mode, lines)


def stream_batch_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                       clean_source: str | None = None, archive_dir: str | None = None,
                       lines: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """The same objects as a file stream; ``clean_source`` = ``archive`` or ``delete``
    removes consumed files after their batch commits (S5)."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if clean_source:
        reader = reader.option("cleanSource", clean_source)
        if archive_dir:
            reader = reader.option("sourceArchiveDir", archive_dir)
    return _parse(reader.text(path, wholetext=not lines), mode, lines)


def quarantine(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (readable objects, unreadable objects with their file and raw text)."""
    bad = F.col("_corrupt_record").isNotNull()
    return objects.where(~bad), objects.where(bad).select("_file", "_corrupt_record")


def unwrap(objects: DataFrame) -> DataFrame:
    """One CLAIM row per claim, envelope or bare, with ``_file`` and ``_offset`` for ordering.

    An envelope's ``batch`` is exploded with its position; a bare object is its own single
    claim at offset 0. An empty envelope yields nothing. Unknown keys were already dropped by
    the fixed schema.
    """
    bare = F.array(F.struct(*[F.col(c).alias(c) for c in CLAIM_COLUMNS]))
    claims = F.when(F.col("batch").isNotNull(), F.col("batch")).otherwise(bare)
    return (
        objects.where(F.col("_corrupt_record").isNull())
        .select("_file", "_obj", F.posexplode(claims).alias("_offset", "c"))
        .select(*[F.col(f"c.{c}").alias(c) for c in CLAIM_COLUMNS], "_file", "_obj",
                F.col("_offset").cast("long").alias("_offset"))
    )


def staged(claims: DataFrame, path: str) -> DataFrame:
    """The claims written as Parquet under ``path`` and read back: for jobs that read them more than once
    (the fold counts them by address first), so that the files are parsed once."""
    claims.write.parquet(path)
    return claims.sparkSession.read.schema(claims.schema).parquet(path)


# Claims with equal times are applied in file, object, then position order.
BATCH_ORDER = ("time_ms", "_file", "_obj", "_offset")
