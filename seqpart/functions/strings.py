"""Record, id and file-name strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(seq: Column, width: int = 60) -> Column:
    """Insert line breaks every ``width`` characters, none at the end."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta_record(name: Column, descr: Column, seq: Column, width: int = 60) -> Column:
    header = F.concat(F.lit(">"), F.concat_ws(" ", name, F.when(descr != "", descr)))
    return F.concat_ws("\n", header, wrap(seq, width))


def hms(seconds: Column) -> Column:
    """Seconds as HH:MM:SS, each part cut towards zero."""
    whole = F.floor(seconds).cast("bigint")
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(whole / 3600).cast("bigint")
    hours_text = F.when(hours < 10, part(hours)).otherwise(hours.cast("string"))
    minutes = F.floor((whole % 3600) / 60).cast("bigint")
    return F.concat_ws(":", hours_text, part(minutes), part(whole % 60))


def file_tail(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_tail(path), "\\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.regexp_extract(file_tail(path), "(\\.[^.]*)$", 1)


def tokens(line: Column, comment: str = "#") -> Column:
    """Whitespace-separated fields of a line, without the comment tail."""
    body = F.regexp_replace(line, f"{comment}.*$", "")
    return F.filter(F.split(body, "[ \\t\\r\\n]+"), lambda t: t != "")


def hit_line(query: Column, target: Column, pid: Column, length: Column, evalue: Column, decision: Column) -> Column:
    """One row of the hit table in its fixed-width text form."""
    return F.format_string("%-15s %-15s %6.2f %7d %12.2E %8s", query, target, pid, length, evalue, decision)
