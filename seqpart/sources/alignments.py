"""Multiple alignment files as rows (msa_id, row_idx, name, aligned), for reading and writing.

Text is split into alignments and lines by Spark; a row's pieces from successive blocks are joined by an aggregate on
(alignment, name), so no alignment is ever held whole by one task. Line order inside an alignment comes from
``posexplode`` of the entry text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = "msa_id string, row_idx bigint, name string, aligned string"


def _lines(entries: DataFrame) -> DataFrame:
    """(msa_id, at, line) from (msa_id, entry)."""
    return entries.select("msa_id", F.posexplode(F.split("entry", "\r?\n")).alias("at", "line"))


def _entries(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    if separator is None:
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.md5(F.input_file_name()).alias("msa_id"), F.col("value").alias("entry"))
    raw = spark.read.option("lineSep", separator).text(path).filter(F.trim("value") != "")
    key = F.concat_ws(":", F.md5(F.input_file_name()), F.monotonically_increasing_id().cast("string"))
    return raw.select(key.alias("msa_id"), F.col("value").alias("entry"))


def _join_blocks(pieces: DataFrame) -> DataFrame:
    """Rows from (msa_id, at, name, text): blocks concatenated in line order, rows numbered by first appearance."""
    joined = pieces.groupBy("msa_id", "name").agg(
        F.min("at").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), "").alias("aligned"))
    order = Window.partitionBy("msa_id").orderBy("first")
    return joined.select("msa_id", (F.row_number().over(order) - 1).cast("bigint").alias("row_idx"), "name", "aligned")


def parse_stockholm(entries: DataFrame) -> DataFrame:
    lines = _lines(entries).filter(~F.col("line").startswith("#") & (F.trim("line") != "") & ~F.col("line").startswith("//"))
    part = F.split(F.trim("line"), "\\s+", 2)
    return _join_blocks(lines.select("msa_id", "at", part[0].alias("name"), part[1].alias("text")))


def stockholm_annotation(entries: DataFrame) -> DataFrame:
    """(msa_id, kind, key, tag, text): GF, GS, GC and GR lines, continued lines joined."""
    lines = _lines(entries).filter(F.col("line").rlike("^#=G[FSCR]\\s"))
    kind = F.substring("line", 3, 2)
    two = kind.isin("GS", "GR")
    part = F.split("line", "\\s+", 4)
    short = F.split("line", "\\s+", 3)
    rows = lines.select("msa_id", "at", kind.alias("kind"), F.when(two, part[1]).otherwise("").alias("key"),
                        F.when(two, part[2]).otherwise(short[1]).alias("tag"), F.when(two, part[3]).otherwise(short[2]).alias("text"))
    glue = F.when(F.col("kind").isin("GC", "GR"), "").otherwise(" ")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"])
    grouped = rows.groupBy("msa_id", "kind", "key", "tag").agg(texts.alias("texts"))
    return grouped.select("msa_id", "kind", "key", "tag", F.when(glue == "", F.array_join("texts", "")).otherwise(F.array_join("texts", " ")).alias("text"))


def parse_clustal(entries: DataFrame) -> DataFrame:
    lines = _lines(entries).filter(F.col("line").rlike("^\\S+\\s+[A-Za-z*.~-]+(\\s+[0-9]+)?\\s*$") & (F.col("at") > 0))
    part = F.split("line", "\\s+")
    return _join_blocks(lines.select("msa_id", "at", part[0].alias("name"), part[1].alias("text")))


def parse_selex(entries: DataFrame) -> DataFrame:
    lines = _lines(entries).filter(~F.col("line").startswith("#") & F.col("line").rlike("^\\S+\\s+\\S"))
    part = F.split(F.trim("line"), "\\s+", 2)
    return _join_blocks(lines.select("msa_id", "at", part[0].alias("name"), F.regexp_replace(part[1], " ", "-").alias("text")))


def parse_psiblast(entries: DataFrame) -> DataFrame:
    lines = _lines(entries).filter(F.col("line").rlike("^\\S+\\s+\\S+\\s*$"))
    part = F.split(F.trim("line"), "\\s+", 2)
    return _join_blocks(lines.select("msa_id", "at", part[0].alias("name"), part[1].alias("text")))


def parse_afa(entries: DataFrame) -> DataFrame:
    """Aligned FASTA; one pass cuts records, another cuts their lines."""
    records = entries.select("msa_id", F.posexplode(F.split("entry", "(?m)^>")).alias("at", "rec")).filter(F.trim("rec") != "")
    name = F.regexp_extract("rec", "^(\\S+)", 1)
    text = F.regexp_replace(F.regexp_replace("rec", "^[^\\n]*", ""), "\\s", "")
    return _join_blocks(records.select("msa_id", "at", name.alias("name"), text.alias("text")))


def parse_a2m(entries: DataFrame) -> DataFrame:
    """Dotless or dotted A2M: lower case marks inserts. Insert runs are padded to the widest run of their position."""
    rows = parse_afa(entries).withColumn("aligned", F.regexp_replace("aligned", "\\.", ""))
    runs = rows.withColumn("runs", F.split(F.regexp_replace("aligned", "([A-Z*-])", "|$1"), "[|]"))
    cut = runs.select("msa_id", "row_idx", "name", F.posexplode("runs").alias("pos", "run"))
    head = F.regexp_extract("run", "^([A-Z*-]?)", 1)
    tail = F.regexp_replace("run", "^[A-Z*-]", "")
    parts = cut.select("msa_id", "row_idx", "name", "pos", head.alias("head"), tail.alias("tail"))
    width = parts.groupBy("msa_id", "pos").agg(F.max(F.length("tail")).alias("w"))
    padded = parts.join(width, ["msa_id", "pos"]).withColumn("text", F.concat("head", F.rpad("tail", F.col("w"), F.lit("."))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return padded.groupBy("msa_id", "row_idx", "name").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("aligned"))


def parse_phylip(entries: DataFrame, interleaved: bool = True) -> DataFrame:
    """PHYLIP with 10-column names, interleaved or sequential."""
    head = F.split(F.trim(F.element_at(F.split("entry", "\n"), 1)), "\\s+")
    sized = entries.select("msa_id", "entry", head[0].cast("int").alias("rows"), head[1].cast("int").alias("cols"))
    lines = sized.select("msa_id", "rows", "cols", F.posexplode(F.filter(F.split("entry", "\r?\n"), lambda x: F.trim(x) != "")).alias("at", "line")).filter("at > 0")
    squeeze = lambda c: F.regexp_replace(c, "\\s", "")
    if interleaved:
        row = (F.col("at") - 1) % F.col("rows")
        first = F.col("at") <= F.col("rows")
        text = F.when(first, F.substring(F.col("line"), 11, 1 << 30)).otherwise(F.col("line"))
        body = lines.select("msa_id", row.alias("row_idx"), "at", F.when(first, F.trim(F.substring("line", 1, 10))).alias("name"), squeeze(text).alias("text"))
    else:
        # every row spans the same number of lines
        order = Window.partitionBy("msa_id").orderBy("at")
        per_row = F.max("at").over(Window.partitionBy("msa_id")) / F.col("rows")
        row = F.floor((F.col("at") - 1) / per_row)
        first = F.coalesce(F.lag(row).over(order) != row, F.lit(True))
        text = F.when(first, F.substring(F.col("line"), 11, 1 << 30)).otherwise(F.col("line"))
        body = lines.select("msa_id", row.alias("row_idx"), "at", F.when(first, F.trim(F.substring("line", 1, 10))).alias("name"), squeeze(text).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    return body.groupBy("msa_id", F.col("row_idx").cast("bigint").alias("row_idx")).agg(
        F.max("name").alias("name"), F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("aligned"))


PARSERS = {"stockholm": parse_stockholm, "pfam": parse_stockholm, "clustal": parse_clustal, "clustallike": parse_clustal,
           "selex": parse_selex, "psiblast": parse_psiblast, "afa": parse_afa, "a2m": parse_a2m, "phylip": parse_phylip,
           "phylips": lambda e: parse_phylip(e, interleaved=False)}


def read_alignments(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    separator = "\n//" if fmt in ("stockholm", "pfam") else None
    return PARSERS[fmt](_entries(spark, path, separator))


def format_alignment(rows: DataFrame, fmt: str, width: int = 60) -> DataFrame:
    """(msa_id, at, value): text lines of each alignment; sort by ``at`` when writing."""
    pad = F.max(F.length("name")).over(Window.partitionBy("msa_id"))
    named = rows.withColumn("label", F.rpad("name", pad + 2, F.lit(" ")))
    if fmt in ("stockholm", "pfam", "psiblast", "selex"):
        body = named.select("msa_id", (F.col("row_idx") + 1).alias("at"), F.concat("label", "aligned").alias("value"))
        if fmt in ("psiblast", "selex"):
            return body
        ids = rows.groupBy("msa_id").agg(F.max("row_idx").alias("last"))
        edge = ids.select("msa_id", F.lit(0).cast("bigint").alias("at"), F.lit("# STOCKHOLM 1.0\n").alias("value")).unionByName(
            ids.select("msa_id", (F.col("last") + 2).alias("at"), F.lit("//").alias("value")))
        return body.unionByName(edge)
    if fmt in ("afa", "a2m"):
        wrapped = F.regexp_replace("aligned", f"(.{{{width}}})(?=.)", "$1\n")
        return rows.select("msa_id", F.col("row_idx").alias("at"), F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value"))
    if fmt in ("clustal", "phylip"):
        starts = F.explode(F.sequence(F.lit(0), F.floor((F.length("aligned") - 1) / width)))
        blocks = named.select("msa_id", "row_idx", "name", "label", "aligned", starts.alias("b"))
        piece = F.substring(F.col("aligned"), (F.col("b") * width + 1).cast("int"), F.lit(width))
        at = F.col("b") * 1_000_000_000 + F.col("row_idx") + 1
        if fmt == "clustal":
            body = blocks.select("msa_id", at.alias("at"), F.concat("label", piece).alias("value"))
            top = rows.select("msa_id").distinct().select("msa_id", F.lit(0).cast("bigint").alias("at"), F.lit("CLUSTAL W multiple sequence alignment\n").alias("value"))
        else:
            lead = F.when(F.col("b") == 0, F.rpad(F.substring("name", 1, 10), 10, " ")).otherwise("")
            body = blocks.select("msa_id", at.alias("at"), F.concat(lead, piece).alias("value"))
            sizes = rows.groupBy("msa_id").agg(F.count("*").alias("r"), F.max(F.length("aligned")).alias("c"))
            top = sizes.select("msa_id", F.lit(0).cast("bigint").alias("at"), F.concat_ws(" ", F.col("r").cast("string"), F.col("c").cast("string")).alias("value"))
        return body.unionByName(top)
    raise ValueError(f"unknown alignment format {fmt}")
