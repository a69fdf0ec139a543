"""File-format guesses from names and first bytes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --- fixed values: format names by suffix and by magic --------------------------------------------------------
SUFFIX = {".fa": "fasta", ".fasta": "fasta", ".gb": "genbank", ".sto": "stockholm", ".sth": "stockholm", ".stk": "stockholm",
          ".afa": "afa", ".afasta": "afa", ".a2m": "a2m", ".slx": "selex", ".selex": "selex", ".pfam": "pfam",
          ".pb": "psiblast", ".ph": "phylip", ".phy": "phylip", ".phyi": "phylip", ".phys": "phylips"}
MAGIC = {">": "fasta", "ID   ": "embl", "LOCUS   ": "genbank", "# STOCKHOLM 1.": "stockholm", "CLUSTAL": "clustal"}
# -----------------------------------------------------------------------------------------------------------------


def format_of(text: Column) -> Column:
    """Format by leading bytes."""
    body = F.regexp_replace(text, "^\\s+", "")
    out = None
    for magic, name in MAGIC.items():
        test = body.startswith(magic)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def sniff_path(spark: SparkSession, path: str) -> str:
    """Format of a file: known suffix first, else its first line."""
    stem = path[:-3] if path.endswith(".gz") else path
    dot = stem[stem.rfind("."):] if "." in stem.rsplit("/", 1)[-1] else ""
    if dot in SUFFIX:
        return SUFFIX[dot]
    row = spark.read.text(path).filter(F.trim("value") != "").select(format_of(F.col("value"))).first()
    return row[0] if row else "unknown"
