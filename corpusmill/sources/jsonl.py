"""JSON-lines read and write (A1, A2)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill.functions.text import is_blank, strip

_BAD = "_bad_line"
# as the standard loader reads JSON: NaN and Infinity are numbers, strings take
# double quotes only; of a repeated key the last value counts
_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true", "mode": "PERMISSIVE"}

# lines in a compressed file at most.  It cannot be split; Spark counts 4 MB for
# opening a file, so that a task gets about as many lines as of plain files
PACKED_ROWS = 2000


def text_lines(raw: DataFrame) -> DataFrame:
    """(value, file) of a text source; lines blank after strip are skipped."""
    return raw.select("value", F.col("_metadata.file_path").alias("file")).filter(~is_blank("value"))


def placed_lines(raw: DataFrame) -> DataFrame:
    """(value, file, block, row): every line of a batch text source with the
    input split it was read from and its number among the task's rows."""
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"))


def numbered(some: DataFrame, raw: DataFrame) -> DataFrame:
    """``some`` lines of ``placed_lines(raw)`` with ``line``, counted from 1 in
    their file.  A split is read in order by one task, so a line's number is
    the number of lines in earlier splits of its file (prefix sums over one row
    per split, which go to every task) plus its distance from the split's first
    row.  Blank lines count."""
    splits = placed_lines(raw).groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(earlier, F.lit(0)).alias("before"))
    return (some.join(F.broadcast(splits), ["file", "block"])
            .withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1).drop("before", "first"))


def parse_lines(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """(value, file, row, bad): ``row`` by the schema; ``bad`` if the line is
    not one JSON object with values of the declared types.  Works on batches
    and streams.  A line is parsed in a generator, behind which no filter moves,
    so that the test and the row share the one parse."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = StructType([*fields.fields, StructField(_BAD, StringType())])
    parsed = F.from_json("value", wide, {**_OPTIONS, "columnNameOfCorruptRecord": _BAD})
    # the whole line is one value: inside brackets it is an array of one object
    alone = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<struct<_:string>>", _OPTIONS)
    out = lines.withColumn("row", F.explode(F.array(parsed)))
    bad = (F.substring(strip("value"), 1, 1) != "{") | F.col("row").isNull() | F.col(f"row.{_BAD}").isNotNull() \
        | (F.coalesce(F.size(alone), F.lit(0)) != 1)
    return out.withColumn("bad", F.coalesce(bad, F.lit(True))).withColumn("row", F.col("row").dropFields(_BAD))


def _fail(bad: Column, place: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid JSON line in "), place, F.lit(": "), F.substring("value", 1, 200)))).otherwise(F.lit(True))


def strict_rows(parsed: DataFrame) -> DataFrame:
    """The rows; the job fails on the first bad line it meets, naming the file
    and the line text (a stream has no line numbers)."""
    return parsed.filter(_fail(F.col("bad"), F.col("file"))).select("row.*")


def read_jsonl(spark: SparkSession, path, schema: StructType | str, mode: str = "strict"):
    """A1: one JSON object per line, UTF-8, declared schema.

    strict: the job fails on a bad line, naming file and line number.  report:
    returns ``(rows, bad_lines)``; ``bad_lines`` has (file, line, value).  A
    value of another type than declared makes a line bad.  A missing path fails
    at once.  JSON null stays null.  Line numbers cost a pass that counts lines
    per split without parsing them; it does not run for the rows of a report."""
    raw = spark.read.text(path)
    parsed = parse_lines(placed_lines(raw).filter(~is_blank("value")), schema)
    if mode not in ("strict", "report"):
        raise ValueError("mode must be 'strict' or 'report'")
    if mode == "report":
        bad = parsed.filter("bad").select("file", "block", "at", "value")
        return parsed.filter(~F.col("bad")).select("row.*"), numbered(bad, raw).select("file", "line", "value")
    place = F.concat(F.col("file"), F.lit(" line "), F.col("line").cast("string"))
    return numbered(parsed, raw).filter(_fail(F.col("bad"), place)).select("row.*")


def write_jsonl(df: DataFrame | Iterable[DataFrame], path: str, compression: str | None = None) -> str:
    """A2: one object per line, non-ASCII unescaped, nulls written, target
    replaced, parents created; a directory of part files (one per task).

    ``compression="gzip"`` packs the same lines (about a quarter of the disk);
    such files are read whole by a task, so none holds more than PACKED_ROWS.
    Of several DataFrames one is taken and written after the other, each task a
    file; the directory gets its ``_SUCCESS`` after the last."""
    several = not isinstance(df, DataFrame)
    for n, part in enumerate(df if several else [df]):
        out = part.write.mode("append" if n else "overwrite").option("ignoreNullFields", "false")
        if compression:
            out = out.options(**{"compression": compression, "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": PACKED_ROWS})
        if several:
            out = out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        out.json(path)
    if several:
        sc = part.sparkSession.sparkContext
        done = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        done.getFileSystem(sc._jsc.hadoopConfiguration()).create(done).close()
    return path
