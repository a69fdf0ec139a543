"""Quality rules: per-text counts, and lines that recur over the documents of a host.

Lines are normalised (lower case, blanks collapsed) and hashed; each host counts in how many distinct texts a line stands.
Lines above the limit are removed from all texts but the one whose smallest id comes first, so what near copies share stays once;
a document that keeps too little is rejected. The limit is one count of texts for hosts of every size. Column expressions
throughout.

Defined results: a null text has no words and fails the base rule; texts that are equal count once per line, so copies and
repeated rows don't make a line frequent, and all of them keep the lines that their text keeps; missing ids come last; a null host
is a host of its own; an empty table gives no rows; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqpart.plans.sizing import BROADCAST_BYTES
from seqpart.session import cut_lineage

from .common import BLANKS, BLANK_RUN, bind, words

# A line is frequent when it stands in more distinct texts of a host than this, however many the host has.
COMMON_TEXTS = 10
# A document is depleted when less than this share of its words is left, or fewer words than LEAST_WORDS.
KEPT_SHARE = 0.30
LEAST_WORDS = 10
WINDOW = 5
# Stands for a missing id, which comes last.
LAST = (1 << 63) - 1


def lines(text: Column) -> Column:
    """Lines with at least one word, as they stand."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.length(F.translate(s, BLANKS, "")) > 0)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, BLANK_RUN, " "))))


def repeated_words(found: Column) -> Column:
    """Number of words inside windows of five words that stand at least twice in the text, first ones included."""

    def spread(places: Column) -> Column:
        """Words covered by windows that start at the given sorted places."""
        gaps = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def places(windows: Column) -> Column:
        """Sort (hash, place); windows with an equal neighbour are repeated."""
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])))

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        windows = F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
        return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long"))
                    .otherwise(bind(places(w), spread)))

    return bind(F.transform(found, lambda w: F.xxhash64(w)), of)


def base_counts(text: Column, found: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": bind(lines(text), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_repeat_words": repeated_words(found),
    }


def frequent_lines(docs: DataFrame, least_texts: int = COMMON_TEXTS, least_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(host, copy, line) of the distinct texts' lines, and (of_host, of_line, keeper) of the frequent ones; documents have ``host``,
    ``copy``, ``doc_id`` and ``text``.

    Distinct (host, line, text) are found by an aggregate that combines before the shuffle, so a line or a text that fills the
    table moves once per task. ``least_share`` of the host's texts may be asked for besides.
    """
    lined = docs.select("host", "copy", "doc_id", F.explode(F.array_distinct(F.transform(lines(F.col("text")), line_hash))).alias("line"))
    # The text of the smallest id keeps the line: (no id, id, text) in this order.
    once = lined.groupBy("host", "line", "copy").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"))
    per_line = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("first", "copy")).alias("least")).filter(F.col("texts") > least_texts)
    if least_share > 0:
        hosts = docs.select("host", "copy").distinct().groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("all_texts"))
        per_line = per_line.join(hosts, per_line.host.eqNullSafe(hosts.h)).filter(F.col("texts") > F.col("all_texts") * least_share)
    return lined, per_line.select(F.col("host").alias("of_host"), F.col("line").alias("of_line"), F.col("least.copy").alias("keeper"))


def text_lines(docs: DataFrame, least_texts: int, least_share: float) -> DataFrame:
    """(line_host, line_copy, frequent) to join documents with: the hashes of a text's own frequent lines that it doesn't keep, so no
    row grows with a host.

    Each join is a broadcast when the measured size is small; else a shuffle whose large partitions Spark splits.
    """
    lined, frequent = frequent_lines(docs, least_texts, least_share)
    frequent = cut_lineage(frequent)
    same = F.col("host").eqNullSafe(F.col("of_host")) & (F.col("line") == F.col("of_line")) & (F.col("copy") != F.col("keeper"))
    small = frequent.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("of_host", F.lit(""))) + 72), F.lit(0))).first()[0] <= BROADCAST_BYTES
    met = lined.join(F.broadcast(frequent), same) if small else lined.select("host", "copy", "line").distinct().join(frequent, same)
    found = cut_lineage(met.groupBy(F.col("host").alias("line_host"), F.col("copy").alias("line_copy")).agg(F.collect_set("line").alias("frequent")))
    held = found.agg(F.coalesce(F.sum(F.size("frequent") * 8 + F.octet_length(F.coalesce("line_host", F.lit(""))) + 64), F.lit(0))).first()[0]
    return F.broadcast(found) if held <= BROADCAST_BYTES else found


def with_frequent(docs: DataFrame, least_texts: int, least_share: float) -> DataFrame:
    """(row, frequent): the documents, packed in a struct so that no name can clash, with their frequent lines; null where there are
    none."""
    packed = docs.select(F.struct("*").alias("row"))
    seen = packed.select(F.col("row.source").alias("host"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("copy"), F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    held = text_lines(seen, least_texts, least_share)
    same = F.col("row.source").eqNullSafe(F.col("line_host")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("line_copy"))
    return packed.join(held, same, "left").select("row", "frequent")


def verdicts(text: Column) -> Column:
    """Counts, base rule, what is left of the text, and whether the document is kept; needs ``frequent``."""
    def gone(line: Column) -> Column:
        return F.array_contains(F.col("frequent"), line_hash(line))

    some = F.size("frequent") > 0
    # One struct, so that words and counts are computed once per row.
    made = bind(words(text), lambda found: F.struct(*(c.alias(name) for name, c in base_counts(text, found).items())))
    left = F.when(some, F.array_join(F.filter(F.split(text, "\n"), lambda s: ~gone(s)), "\n")).otherwise(text)

    def judge(c: Column) -> Column:
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])

        def rest(kept_text: Column) -> Column:
            n_left = F.when(some, F.size(words(kept_text))).otherwise(c["n_words"])
            kept = ~failed & (n_left >= LEAST_WORDS) & (n_left >= KEPT_SHARE * c["n_words"])
            return F.struct(c.alias("counts"), failed.alias("failed"), kept_text.alias("left"), kept.alias("kept"))

        return bind(left, rest)

    return bind(made, judge)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, least_texts: int = COMMON_TEXTS, least_share: float = 0.0) -> DataFrame:
    """(doc_id, counts, base_failed, kept, text_left) for each document."""
    joined = with_frequent(docs.select("doc_id", "text", "source"), least_texts, least_share)
    return joined.select(F.col("row.doc_id").alias("doc_id"), verdicts(F.col("row.text")).alias("v")).select(
        "doc_id", *(F.col(f"v.counts.{c}").alias(c) for c in COUNTS), F.col("v.failed").alias("base_failed"),
        F.col("v.kept").alias("kept"), F.col("v.left").alias("text_left"))


def kept_documents(docs: DataFrame, least_texts: int = COMMON_TEXTS, least_share: float = 0.0) -> DataFrame:
    """The documents that pass, frequent lines taken out and ``n_chars`` counted anew where a line went."""
    joined = with_frequent(docs, least_texts, least_share)
    # Exploding none or one verdict filters without computing it twice.
    judged_once = F.explode(F.filter(F.array(verdicts(F.col("row.text"))), lambda j: j["kept"]))
    out = joined.select("row", "frequent", judged_once.alias("v"))
    named = {"text": F.col("v.left"), "n_chars": F.when(F.size("frequent") > 0, F.length("v.left").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(named[c].alias(c) if c in named else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
