"""Structure strings read from all conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqpart.operators import structure

from . import query
from .tables import table

# Letters as symbols: x and q open crossing pairs, vowels nested ones, others are unpaired. A text's string is followed by its turned
# string, so that it is valid; the plain string stands beside it, valid only without openings.
_FROM, _TO = "aeouxqbcdfghijklmnprstvwyz", "<([{XQ.,_-:~.,_-:~.,_-:~.,"
_SS = f"""t AS (SELECT (CAST(conv_id AS BIGINT) << 32) + turn AS k, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{_FROM}', '{_TO}') AS x FROM conversations),
  s AS (SELECT 2 * k AS id, x || reverse(translate(x, '<([{{XQ', '>)]}}xq')) AS ss FROM t UNION ALL SELECT 2 * k + 1, x FROM t)"""


def structures(spark, sf):
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    at = F.shiftleft(F.col("conv_id").cast("bigint"), 32) + F.col("turn")
    t = table(spark, sf, "conversations").select(at.alias("at"), F.translate(letters, _FROM, _TO).alias("x"))
    both = F.array(F.struct((F.col("at") * 2).alias("id"), F.concat("x", structure.turned(F.col("x"))).alias("ss")), F.struct((F.col("at") * 2 + 1).alias("id"), F.col("x").alias("ss")))
    return t.select(F.inline(both))


# The turned half mirrors the first: position i pairs with 2 n + 1 - i.
@query("x16_structure_pairs", f"""WITH {_SS}, c AS (SELECT id, length(ss) AS n, ss, unnest(range(1, length(ss) // 2 + 1)) AS i FROM s WHERE id % 2 = 0)
  SELECT id, i, n + 1 - i AS j, CASE WHEN ss[i] IN ('X', 'Q') THEN ss[i] ELSE '' END AS stack FROM c WHERE regexp_full_match(ss[i], '[<(\\[{{XQ]')""")
def structure_pairs(spark, sf):
    return structure.pairs(structures(spark, sf)).select("id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "stack")


@query("x16_structure_validity", f"""WITH {_SS} SELECT id, id % 2 = 0 OR NOT regexp_matches(ss, '[<(\\[{{XQ]') AS valid FROM s""")
def structure_validity(spark, sf):
    return structure.validity(structures(spark, sf))


@query("x16_structure_round_trip", f"""WITH {_SS} SELECT id, translate(ss, '([{{)]}},_-:~', '<<<>>>.....') AS ss, regexp_replace(ss, '[A-Za-z]', '.', 'g') AS nested,
  translate(ss, '<([{{>)]}},_-:~', '>>>><<<<.....') AS old FROM s WHERE id % 2 = 0""")
def structure_round_trip(spark, sf):
    """Strings of the valid structures, written anew from their pairs, beside their other forms."""
    s = structures(spark, sf).filter("id % 2 = 0")
    again = structure.notation(structure.pairs(s), s.select("id", F.length("ss").alias("n")))
    forms = s.select("id", structure.nested_only(F.col("ss")).alias("nested"), structure.old_form(F.col("ss")).alias("old"))
    return again.join(forms, "id").select("id", "ss", "nested", "old")
