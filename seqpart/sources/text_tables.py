"""Small text tables: score matrices, background frequencies, token files, id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpart.functions.strings import tokens


def read_tokens(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(file, at, tokens) of every line with content."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    return raw.select("file", "at", tokens(F.col("value"), comment).alias("tokens")).filter(F.size("tokens") > 0)


def read_score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Substitution matrix in long form (a, b, score): a header line of symbols, then one row per symbol."""
    lines = read_tokens(spark, path)
    first = lines.groupBy("file").agg(F.min_by("tokens", "at").alias("symbols"), F.min("at").alias("first"))
    rows = lines.join(F.broadcast(first), "file").filter("at > first")
    named = F.size("tokens") > F.size("symbols")
    values = F.when(named, F.slice("tokens", F.lit(2), F.size("symbols"))).otherwise(F.col("tokens"))
    label = F.when(named, F.col("tokens")[0])
    cells = rows.select(label.alias("a"), "symbols", F.posexplode(values).alias("col", "v"))
    return cells.select("a", F.element_at("symbols", F.col("col") + 1).alias("b"), F.col("v").cast("int").alias("score"))


def write_score_matrix(matrix: DataFrame, path: str, symbols: str) -> None:
    wide = matrix.withColumnRenamed("a", "row_symbol").groupBy("row_symbol").pivot("b", list(symbols)).agg(F.first("score"))
    order = F.instr(F.lit(symbols), F.col("row_symbol"))
    body = wide.select(order.alias("at"), F.concat_ws(" ", "row_symbol", *[F.lpad(F.col(s).cast("string"), 3, " ") for s in symbols]).alias("value"))
    head = matrix.sparkSession.createDataFrame([(0, "  " + " ".join(s.rjust(3) for s in symbols))], "at int, value string")
    body.unionByName(head).orderBy("at").select("value").coalesce(1).write.mode("overwrite").text(path)  # at most 30 lines


def read_background(spark: SparkSession, path: str) -> DataFrame:
    """(residue, f): the first line names the alphabet, the rest hold a residue and its frequency."""
    t = read_tokens(spark, path).filter(F.size("tokens") == 2)
    return t.select(F.upper(F.col("tokens")[0]).alias("residue"), F.col("tokens")[1].try_cast("double").alias("f")).filter("f is not null")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias("name")).filter("name <> ''")
