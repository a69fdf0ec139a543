"""Alignments as rows (msa_id, row_idx, name, aligned): columns, identity, weights, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAPS = "-._~"
# parts of one alignment in the pair join; each holds all later rows but only a share of the earlier ones
PAIR_SALTS = 16


# columns of one piece of a row, and cells that one task explodes
BLOCK = 128
CELLS_PER_TASK = 2_000_000


def cells(msa: DataFrame, *keep: str) -> DataFrame:
    """One row per residue cell: (keep.., col, sym), gaps included."""
    letters = F.filter(F.split("aligned", ""), lambda c: c != "")
    return msa.select(*keep, F.posexplode(letters).alias("col", "sym"))


def pieces(msa: DataFrame, *keep: str) -> DataFrame:
    """Rows cut into pieces of ``BLOCK`` columns: (msa_id, keep.., block, aligned), dealt by alignment and block.

    Texts are shuffled once, before any explode; aggregates on (msa_id, block, ..) then need no further shuffle, and the number of
    tasks follows the cells, so that none explodes more of them as the input grows.
    """
    total = msa.agg(F.coalesce(F.sum(F.length("aligned").cast("bigint")), F.lit(0))).first()[0]
    cores = msa.sparkSession.sparkContext.defaultParallelism
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.length("aligned") - 1) / BLOCK).cast("int"))).alias("block")
    cut = msa.filter(F.length("aligned") > 0).select("msa_id", *keep, "aligned", starts)
    piece = F.substring(F.col("aligned"), F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("aligned")
    return cut.select("msa_id", *keep, "block", piece).repartition(int(min(max(cores, total // CELLS_PER_TASK), 200_000)), "msa_id", "block")


def _counts(cut: DataFrame, *more: str) -> DataFrame:
    """(msa_id, block, col, sym, more.., k): rows of each symbol of a column; ``col`` counts from the start of its block."""
    return cells(cut, "msa_id", "block", *more).groupBy("msa_id", "block", "col", "sym", *more).agg(F.count("*").alias("k"))


def _column() -> Column:
    return (F.col("block") * BLOCK + F.col("col")).alias("col")


def column_counts(msa: DataFrame) -> DataFrame:
    return _counts(pieces(msa)).select("msa_id", _column(), "sym", "k")


def consensus(msa: DataFrame, symfrac: float = 0.5) -> DataFrame:
    """Per column: residue share, consensus flag, most common residue."""
    gap = F.col("sym").isin(*GAPS)
    per = _counts(pieces(msa)).groupBy("msa_id", "block", "col").agg(
        F.sum(F.when(gap, 0).otherwise(F.col("k"))).alias("residues"), F.sum("k").alias("total"),
        F.max(F.when(~gap, F.struct(F.col("k"), (-F.ascii("sym")).alias("_t"), F.col("sym")))).alias("_best"))
    return per.select("msa_id", _column(), "residues", "total", (F.col("residues") >= symfrac * F.col("total")).alias("is_consensus"), F.col("_best.sym").alias("top"))


def identity(a: Column, b: Column, alphabet: str = "ACDEFGHIKLMNPQRSTVWYX") -> Column:
    """Identical residues over the shorter residue length of two aligned strings."""
    strip = lambda s: F.length(F.regexp_replace(s, f"[^{alphabet}]", ""))
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ((x == y) & (x != "") & F.contains(F.lit(alphabet), x)).cast("int"))
    same = F.aggregate(pairs, F.lit(0), lambda acc, v: acc + v)
    short = F.least(strip(a), strip(b))
    return F.when(short > 0, same / short).otherwise(0.0)


def jukes_cantor(a: Column, b: Column, k: int = 20, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> tuple[Column, Column]:
    """Distance and variance from the share of differing aligned residues; null without common residues or where too many differ."""
    both = lambda test: F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (F.contains(F.lit(alphabet), x) & F.contains(F.lit(alphabet), y)
                                                               & (x != "") & (y != "") & test(x, y)).cast("int")),
        F.lit(0), lambda acc, v: acc + v)
    same, diff = both(lambda x, y: x == y), both(lambda x, y: x != y)
    n = same + diff
    d = F.try_divide(diff, n)
    x = 1.0 - d * k / (k - 1.0)
    finite = (n > 0) & (diff * k < n * (k - 1))
    return F.when(finite, -F.log(x) * (k - 1.0) / k), F.when(finite, F.try_divide(d * (1 - d), n * x * x))


def pairs_within(msa: DataFrame) -> DataFrame:
    """Row pairs i < j of each alignment; the pair table is the operator's result.

    The earlier rows are dealt over salts and the later ones copied to each, so that no alignment is one task.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1))).alias("_salt")
    l = msa.select("msa_id", F.pmod(F.xxhash64("row_idx"), F.lit(PAIR_SALTS)).cast("int").alias("_salt"), F.col("row_idx").alias("i"), F.col("aligned").alias("a"))
    r = msa.select("msa_id", salts, F.col("row_idx").alias("j"), F.col("aligned").alias("b"))
    # the copies are not in Spark's estimate of the size, by which it might broadcast them
    return l.join(r.hint("merge"), ["msa_id", "_salt"]).filter("i < j").drop("_salt")


def position_weights(msa: DataFrame) -> DataFrame:
    """Position-based weights over all columns: each residue gives 1/(kinds * copies) of its column, divided by the
    residues of the row, scaled to the number of rows."""
    cut = pieces(msa, "row_idx")
    is_gap = lambda c: c.isin(*GAPS)
    columns = _counts(cut).groupBy("msa_id", "block", "col").agg(F.collect_list(F.struct("sym", "k")).alias("of"))
    kinds = F.size(F.filter("of", lambda s: ~is_gap(s["sym"])))
    gives = F.transform("of", lambda s: F.when(is_gap(s["sym"]), 0.0).otherwise(1.0 / (kinds * s["k"])))
    # a column has a row for gaps too, so the columns of a block follow each other without holes
    tables = columns.select("msa_id", "block", F.struct("col", F.col("of.sym").alias("syms"), gives.alias("gives")).alias("t")).groupBy("msa_id", "block").agg(
        F.array_sort(F.collect_list("t")).alias("table"))
    met = cut.join(tables.hint("merge"), ["msa_id", "block"])
    letters = F.filter(F.split("aligned", ""), lambda c: c != "")
    shares = F.zip_with(letters, "table", lambda c, t: F.when(c.isNotNull(), F.element_at(t["gives"], F.array_position(t["syms"], c).cast("int"))).otherwise(0.0))
    part = met.select("msa_id", "row_idx", F.aggregate(shares, F.lit(0.0), lambda a, v: a + v).alias("given"),
                      F.length(F.regexp_replace("aligned", "[-._~]", "")).alias("residues"))
    raw = part.groupBy("msa_id", "row_idx").agg(F.coalesce(F.try_divide(F.sum("given"), F.sum("residues")), F.lit(0.0)).alias("raw"))
    rows = msa.select("msa_id", "row_idx").join(raw, ["msa_id", "row_idx"], "left").fillna(0.0, ["raw"])
    total = rows.groupBy("msa_id").agg(F.sum("raw").alias("s"), F.count("*").alias("n"))
    return rows.join(total, "msa_id").select("msa_id", "row_idx", F.when(F.col("s") > 0, F.col("raw") / F.col("s") * F.col("n")).otherwise(1.0).alias("wgt"))


def cluster_weights(labels: DataFrame, msa_id: str = "msa_id") -> DataFrame:
    """1 / cluster size, scaled to the number of rows of each alignment. ``labels``: (msa_id, row_idx, cluster)."""
    size = labels.groupBy(msa_id, "cluster").agg(F.count("*").alias("k"))
    per = labels.groupBy(msa_id).agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("c"))
    return labels.join(size, [msa_id, "cluster"]).join(per, msa_id).select(msa_id, "row_idx", (F.col("n") / (F.col("c") * F.col("k"))).alias("wgt"))


def keep_columns(msa: DataFrame, columns: DataFrame) -> DataFrame:
    """Alignment reduced to the listed (msa_id, col)."""
    cut = pieces(msa, "row_idx", "name")
    block = F.floor(F.col("col") / BLOCK).cast("int")
    listed = columns.select("msa_id", block.alias("block"), (F.col("col") % BLOCK).cast("int").alias("col")).groupBy("msa_id", "block").agg(
        F.array_sort(F.collect_list("col")).alias("kept"))
    # all columns of a piece, once each: the piece stays as it is
    whole = (F.size("kept") == F.length("aligned")) & (F.element_at("kept", -1) == F.length("aligned") - 1) & (F.size(F.array_distinct("kept")) == F.size("kept"))
    some = F.array_join(F.transform("kept", lambda c: F.substring(F.col("aligned"), c + 1, F.lit(1))), "")
    left = cut.join(listed.hint("merge"), ["msa_id", "block"]).select(
        "msa_id", "row_idx", "name", F.struct("block", F.when(whole, F.col("aligned")).otherwise(some).alias("piece")).alias("p"))
    ordered = F.array_sort(F.collect_list("p"))
    return left.groupBy("msa_id", "row_idx", "name").agg(F.array_join(ordered["piece"], "").alias("aligned")).filter("aligned <> ''")


def fragments(msa: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows spanning less than ``threshold`` of the alignment, end gaps marked as missing."""
    span = F.length(F.regexp_replace("aligned", "^[-._~]+|[-._~]+$", ""))
    is_frag = span < threshold * F.length("aligned")
    lead = F.length("aligned") - F.length(F.regexp_replace("aligned", "^[-._~]+", ""))
    tail = F.length("aligned") - F.length(F.regexp_replace("aligned", "[-._~]+$", ""))
    core = F.substring(F.col("aligned"), lead + 1, F.length("aligned") - lead - tail)
    marked = F.concat(F.repeat(F.lit("~"), lead), core, F.repeat(F.lit("~"), tail))
    return msa.withColumn("is_fragment", is_frag).withColumn("aligned", F.when(is_frag & (span > 0), marked).otherwise(F.col("aligned")))


def mean_identity(msa: DataFrame, alphabet: str = "ACDEFGHIKLMNPQRSTVWYX") -> DataFrame:
    """Average pairwise identity per alignment, without forming pairs.

    A pair sharing a residue in a column adds one over its shorter length. Counting rows per (column, residue, length)
    and running from long to short gives that sum: each length meets all longer rows, and its own rows pairwise.
    """
    length = F.length(F.regexp_replace("aligned", f"[^{alphabet}]", ""))
    sized = msa.withColumn("n", length)
    counts = _counts(pieces(sized, "n"), "n").filter(F.contains(F.lit(alphabet), F.col("sym")))
    longer = Window.partitionBy("msa_id", "block", "col", "sym").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    met = F.coalesce(F.sum("k").over(longer), F.lit(0)) + (F.col("k") - 1) / 2
    total = counts.withColumn("part", F.col("k") * met / F.col("n")).groupBy("msa_id").agg(F.sum("part").alias("s"))
    rows = msa.groupBy("msa_id").agg(F.count("*").alias("r")).filter("r > 1")
    pairs = (F.col("r") * (F.col("r") - 1) / 2).cast("bigint")
    return rows.join(total, "msa_id", "left").select(
        "msa_id", (F.coalesce("s", F.lit(0.0)) / pairs).alias("mean_id"), pairs.alias("pairs"))


def connectivity(msa: DataFrame, at_least: float) -> DataFrame:
    """Share of row pairs at or above an identity."""
    hit = F.when(identity(F.col("a"), F.col("b")) >= at_least, 1.0).otherwise(0.0)
    return pairs_within(msa).groupBy("msa_id").agg(F.avg(hit).alias("connectivity"))


def redundancy_filter(msa: DataFrame, max_id: float) -> DataFrame:
    """Keep rows in order unless they reach ``max_id`` identity with an earlier kept row.

    The greedy pass is a fixed point: all rows are judged at once against the rows currently kept, until stable.
    """
    from seqpart.session import cut_lineage

    close = pairs_within(msa).filter(identity(F.col("a"), F.col("b")) >= max_id).select("msa_id", "i", "j")
    close = cut_lineage(close)
    state = cut_lineage(msa.select("msa_id", "row_idx", F.lit(True).alias("kept")))
    while True:  # the first k rows are final after k rounds
        alive = state.filter("kept").select("msa_id", F.col("row_idx").alias("i"))
        blocked = close.join(alive, ["msa_id", "i"]).select("msa_id", F.col("j").alias("row_idx")).distinct().withColumn("_b", F.lit(True))
        nxt = state.join(blocked, ["msa_id", "row_idx"], "left").select(
            "msa_id", "row_idx", F.col("_b").isNull().alias("kept"), F.col("kept").alias("_was"))
        nxt = cut_lineage(nxt)
        if nxt.filter("kept <> _was").isEmpty():
            return msa.join(nxt.filter("kept").select("msa_id", "row_idx"), ["msa_id", "row_idx"])
        state = nxt.drop("_was")


def trace_identity(query: Column, target: Column, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> tuple[Column, Column]:
    """Identity of an aligned pair over match and insert states, and the number of those states.

    Columns where the target has a residue count (match or insert); deletions do not; degenerate residues never match.
    """
    sides = F.zip_with(F.split(query, ""), F.split(target, ""), lambda x, y: F.struct(x.alias("q"), y.alias("t")))
    used = F.size(F.filter(sides, lambda s: (s["t"] != "") & ~s["t"].isin(*GAPS)))
    same = F.size(F.filter(sides, lambda s: (s["t"] != "") & (s["q"] == s["t"]) & F.contains(F.lit(alphabet), s["t"])))
    return F.when(used > 0, same / used), used.cast("bigint")


def extract_rows(msa: DataFrame) -> DataFrame:
    """Unaligned sequences of alignment rows."""
    return msa.select("msa_id", "row_idx", "name", F.regexp_replace("aligned", "[-._~]", "").alias("seq"))
