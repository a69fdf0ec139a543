"""Residue alphabets as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: symbol order, degeneracies and amino background of the data model ---------------------
AMINO = "ACDEFGHIKLMNPQRSTVWY"
AMINO_SYMBOLS = "ACDEFGHIKLMNPQRSTVWY-BJZOUX*~"
DNA_SYMBOLS = "ACGT-RYMKSWHBVDN*~"
AMINO_DEGENERATE = {"B": "ND", "J": "IL", "Z": "QE", "O": "K", "U": "C", "X": AMINO}
DNA_DEGENERATE = {
    "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT",
    "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT",
}
AMINO_BACKGROUND = {
    "A": 0.0787945, "C": 0.0151600, "D": 0.0535222, "E": 0.0668298, "F": 0.0397062,
    "G": 0.0695071, "H": 0.0229198, "I": 0.0590092, "K": 0.0594422, "L": 0.0963728,
    "M": 0.0237718, "N": 0.0414386, "P": 0.0482904, "Q": 0.0395639, "R": 0.0540978,
    "S": 0.0683364, "T": 0.0540687, "V": 0.0673417, "W": 0.0114135, "Y": 0.0304133,
}
DNA_PAIR_FROM = "ACGTRYMKSWHBVDN"
DNA_PAIR_TO = "TGCAYRKMSWDVBHN"
# ------------------------------------------------------------------------------------------------------------

BOTH_CASES = AMINO + AMINO.lower()


def residues(text: Column | str) -> Column:
    """Canonical residues of free text. Filtering comes before ``upper`` so that sharp s cannot become SS."""
    text = F.col(text) if isinstance(text, str) else text
    return F.upper(F.regexp_replace(text, f"[^{BOTH_CASES}]", ""))


def nucleotides(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", ""))


def letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def digitize(seq: Column, symbols: str = AMINO_SYMBOLS) -> Column:
    """Array of 0-based symbol codes; ``_`` and ``.`` are gaps, -1 marks an illegal character."""
    clean = F.translate(F.upper(seq), "_.", "--")
    return F.transform(letters(clean), lambda c: (F.instr(F.lit(symbols), c) - 1).cast("int"))


def textize(codes: Column, symbols: str = AMINO_SYMBOLS) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit(symbols), c + 1, F.lit(1))), "")


def degenerate_to_x(seq: Column, degenerate: str = "BJZOU", any_symbol: str = "X") -> Column:
    return F.translate(seq, degenerate, any_symbol * len(degenerate))


def reverse_complement(seq: Column) -> Column:
    both_from, both_to = DNA_PAIR_FROM + DNA_PAIR_FROM.lower(), DNA_PAIR_TO + DNA_PAIR_TO.lower()
    return F.reverse(F.translate(F.translate(seq, "Uu", "Tt"), both_from, both_to))


def dealign(aligned: Column) -> Column:
    return F.regexp_replace(aligned, "[-_.~]", "")


def residue_length(aligned: Column) -> Column:
    """Length without gap, nonresidue and missing-data symbols."""
    return F.length(F.regexp_replace(aligned, "[-_.*~]", ""))


def illegal_count(seq: Column, symbols: str = AMINO_SYMBOLS) -> Column:
    allowed = symbols.replace("-", "") + symbols.lower().replace("-", "")
    return F.length(F.regexp_replace(seq, f"[{allowed}_.\\-]", ""))


def match_probability(x: Column, y: Column, degenerate: dict[str, str] = DNA_DEGENERATE) -> Column:
    """Chance that two possibly degenerate symbols denote the same residue, all members equally likely."""
    table = F.create_map(*[F.lit(v) for pair in degenerate.items() for v in pair])
    xs = F.split(F.coalesce(F.element_at(table, x), x), "")
    ys = F.split(F.coalesce(F.element_at(table, y), y), "")
    keep = lambda a: F.filter(a, lambda c: c != "")
    shared = F.size(F.array_intersect(keep(xs), keep(ys)))
    return shared / (F.size(keep(xs)) * F.size(keep(ys)))


def member_scores(members: str, background: dict[str, float]) -> tuple[Column, Column]:
    """Plain and background-weighted mean of the score columns named by the members of a degenerate symbol."""
    plain = sum((F.col(a) for a in members), F.lit(0.0)) / len(members)
    weighted = sum((F.col(a) * background[a] for a in members), F.lit(0.0)) / sum(background[a] for a in members)
    return plain, weighted


def symbol_counts(seq: Column, symbols: str) -> dict[str, Column]:
    """Occurrences of each letter as separate columns: one byte search per symbol, no explode."""
    return {s: F.length(seq) - F.length(F.replace(seq, F.lit(s), F.lit(""))) for s in symbols}


def guess_alphabet(df: DataFrame, text: Column, out: str = "alphabet") -> DataFrame:
    """Add the alphabet by letter statistics: ``amino``, ``dna``, ``rna`` or ``unknown``.

    Counts are columns of a first projection so that each letter group is counted once.
    """
    giveaway, shared, protein = "EFIJLOPQZ", "ACG", "DHKMRSVWY"
    groups = {"_n1": giveaway, "_n2": shared, "_n3": protein, "_nt": "T", "_nu": "U", "_nn": "N", "_nx": "X"}
    c = F.col
    upper = df.withColumn("_u", F.upper(F.regexp_replace(text, "[^A-Za-z]", "")))
    kinds = lambda letters_: reduce(lambda a, b: a + b, [F.contains(c("_u"), F.lit(x)).cast("int") for x in letters_])
    counted = upper.select(
        "*", F.length("_u").alias("_n"),
        *[(F.length("_u") - F.length(F.translate("_u", g, ""))).alias(name) for name, g in groups.items()],
        kinds("ACGT").alias("_k4t"), kinds("ACGU").alias("_k4u"), kinds(giveaway + shared + protein + "NT").alias("_k"),
    )
    small = 0.02 * c("_n")
    guess = (
        F.when(c("_n") <= 10, "unknown")
        .when((c("_n") > 2000) & (c("_nn") == c("_n")), "dna")
        .when(c("_n1") > 0, "amino")
        .when((c("_n") - c("_n2") - c("_nt") - c("_nn") <= small) & (c("_k4t") == 4), "dna")
        .when((c("_n") - c("_n2") - c("_nu") - c("_nn") <= small) & (c("_k4u") == 4), "rna")
        .when((c("_n") - c("_n1") - c("_n2") - c("_n3") - c("_nn") - c("_nt") - c("_nx") <= small)
              & (c("_n3") > c("_n2")) & (c("_k") >= 15), "amino")
        .otherwise("unknown")
    )
    return counted.select(*[c(x) for x in df.columns], guess.alias(out))


def checksum(seq: Column) -> Column:
    """Jenkins one-at-a-time hash of the residue bytes, as an unsigned 32-bit value in a bigint."""
    mask = F.lit(0xFFFFFFFF)
    codes = F.transform(letters(seq), lambda c: F.ascii(c).cast("bigint"))

    def mix(h: Column, c: Column) -> Column:
        h = (h + c).bitwiseAND(mask)
        h = (h + F.shiftleft(h, 10)).bitwiseAND(mask)
        return h.bitwiseXOR(F.shiftright(h, 6))

    def close(h: Column) -> Column:
        h = (h + F.shiftleft(h, 3)).bitwiseAND(mask)
        h = h.bitwiseXOR(F.shiftright(h, 11))
        return (h + F.shiftleft(h, 15)).bitwiseAND(mask)

    return F.aggregate(codes, F.lit(0).cast("bigint"), mix, close)


def header_id(header: Column, long_ids: bool = False) -> Column:
    """First token of a header, or field 2 of ``xx|ID|...`` when long ids are in use."""
    short = F.element_at(F.split(header, "[ \\t]"), 1)
    if not long_ids:
        return short
    return F.when(F.substring(header, 3, 1) == "|", F.element_at(F.split(header, "[|]"), 2)).otherwise(short)
