"""Structure strings against stacks."""

import random

from pyspark.sql import functions as F

from seqpart.operators import structure


def stacked(ss):
    """[(i, j, stack)] by stacks; None if the string isn't valid."""
    if ss is None:
        return None
    held, out = {}, []
    closes = dict(zip(structure.CLOSING, structure.OPENING))
    for pos, c in enumerate(ss, start=1):
        if c in structure.OPENING or c in structure.CAPITALS:
            held.setdefault(c if c in structure.CAPITALS else "", []).append((pos, c))
        elif c in closes or c in structure.SMALL:
            name = "" if c in closes else c.upper()
            if not held.get(name):
                return None
            at, was = held[name].pop()
            if was != closes.get(c, name):
                return None
            out.append((at, pos, name))
        elif c not in structure.UNPAIRED:
            return None
    return None if any(held.values()) else sorted(out)


def test_pairs_validity_and_forms(spark):
    rng = random.Random(3)
    said = ["", None, "<<>>", "<(>)", "<A>a", "a<>A", ">", "<", "<>>", "><", "A", "Aa", "AaBb", "<é>", "<.,_-:~>", "([{<>}])", "<>" * 500, "<" * 900 + ">" * 900, "< >", "><<>"]
    said += ["".join(rng.choice("<>()Aa.") for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(said)), "id long, ss string").withColumn("pos", F.lit("own")).repartition(4)
    want = {i: stacked(s) for i, s in enumerate(said)}
    valid = {r.id: r.valid for r in structure.validity(df).collect()}
    assert valid == {i: w is not None for i, w in want.items()} and sum(valid.values()) > 20
    paired = structure.pairs(df)
    got = {}
    for r in paired.collect():
        got.setdefault(r.id, []).append((r.i, r.j, r.stack))
    assert {i: sorted(x) for i, x in got.items()} == {i: w for i, w in want.items() if w}
    sound = df.join(structure.validity(df).filter("valid"), "id").select("id", "ss")
    again = {r.id: r.ss for r in structure.notation(paired, sound.select("id", F.length("ss").alias("n"))).collect()}
    plain = str.maketrans("([{)]}:,_-~", "<<<>>>.....")
    assert again == {i: said[i].translate(plain) for i, ok in valid.items() if ok}
    back = sound.select("id", structure.turned(structure.turned(F.col("ss"))).alias("twice"), structure.turned(F.col("ss")).alias("ss"),
                        structure.from_old_form(structure.old_form(structure.nested_only(F.col("ss")))).alias("old"))
    assert all(r.twice == said[r.id] and stacked(r.ss) is not None and stacked(r.old) is not None for r in back.collect())


def test_strings_are_dealt_before_the_explode(spark):
    """One shuffle, of strings: none lies between the explode and the windows."""
    df = spark.createDataFrame([(1, "<A>a"), (2, "<>")], "id long, ss string")
    plan = structure._met(structure.brackets(df))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate posexplode")]
    assert "Exchange" not in above and above.count("Window") >= 2
