"""Readers, writers, streams."""

import os

import pytest
from pyspark.sql import functions as F

from seqpart.functions.strings import fasta_record
from seqpart.operators import split as sp
from seqpart.operators.seeds import seed_incidence
from seqpart.sources import alignments, fasta, flat, sniff, text_tables
from seqpart.streaming.incremental import StreamingSplit

FASTA = ">a first one\nACDEF\nGHI\n\n> b\nKLM*\n>c\n" + "A" * 60 + "\n" + "C" * 60 + "\n"


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_scan_and_sink(spark, tmp_path):
    got = fasta.with_record_index(fasta.read_fasta(spark, _write(tmp_path / "x.fa", FASTA))).orderBy("idx").collect()
    assert [(r.idx, r.name, r.descr, r.n) for r in got] == [(0, "a", "first one", 8), (1, "b", "", 4), (2, "c", "", 120)]
    df = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    fasta.write_fasta(df, str(tmp_path / "out"), F.col("descr"))
    again = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert {(r.name, r.descr, r.seq) for r in again.collect()} == {(r.name, r.descr, r.seq) for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 120, 121])
def test_wrap(spark, n):
    text = spark.range(1).select(fasta_record(F.lit("x"), F.lit(""), F.lit("A" * n))).first()[0]
    lines = text.split("\n")[1:]
    assert "".join(lines) == "A" * n and all(len(x) == 60 for x in lines[:-1])


def test_illegal_and_capacity(spark, tmp_path):
    path = _write(tmp_path / "bad.fa", ">a\nAC1D\n")
    with pytest.raises(Exception, match="illegal residue"):
        fasta.read_fasta(spark, path).collect()
    with pytest.raises(ValueError):
        fasta.check_capacity(spark.range(5), 4)
    fasta.check_capacity(spark.range(5), 5)


def test_flat_files(spark, tmp_path):
    embl = "ID   X1 standard; 8\nAC   A001;\nDE   one\nDE   two\nSQ   SEQUENCE 8\n     acdef ghi    8\n//\nID   X2\nSQ   S\n     kl\n//\n"
    rows = {r.name: r for r in flat.read_embl(spark, _write(tmp_path / "e.embl", embl)).collect()}
    assert rows["X1"].seq == "ACDEFGHI" and rows["X1"].acc == "A001" and rows["X1"].descr == "one two" and rows["X2"].seq == "KL"
    gb = "LOCUS       G1 9 bp\nDEFINITION  first\n            second\nVERSION     G1.2\nORIGIN\n        1 acgta cgta\n//\n"
    (g,) = flat.read_genbank(spark, _write(tmp_path / "g.gb", gb)).collect()
    assert (g.name, g.acc, g.descr, g.seq) == ("G1", "G1.2", "first second", "ACGTACGTA")
    (d,) = flat.read_daemon(spark, _write(tmp_path / "d.txt", "@--seqdb 1\n>q1 d\nACD\n//\n")).collect()
    assert (d.options, d.name, d.seq) == ("--seqdb 1", "q1", "ACD")


ALN = [("s1", "ACDE-FGH" * 9), ("s2", "AC-EKFGH" * 9)]
STO = "# STOCKHOLM 1.0\n#=GF ID test\n#=GS s1 AC P1\n\ns1 ACDE-F\ns2 AC-EKF\n#=GC RF xx.xxx\n\ns1 GH\ns2 GH\n//\n"


def test_stockholm(spark, tmp_path):
    entries = alignments._entries(spark, _write(tmp_path / "a.sto", STO + STO.replace("s1", "z1")), "\n//")
    got = {(r.name, r.aligned, r.row_idx) for r in alignments.parse_stockholm(entries).collect()}
    assert ("s1", "ACDE-FGH", 0) in got and ("z1", "ACDE-FGH", 0) in got and ("s2", "AC-EKFGH", 1) in got
    notes = {(r.kind, r.key, r.tag, r.text) for r in alignments.stockholm_annotation(entries).collect()}
    assert {("GF", "", "ID", "test"), ("GS", "s1", "AC", "P1"), ("GC", "", "RF", "xx.xxx")} <= notes


@pytest.mark.parametrize("fmt", ["stockholm", "psiblast", "selex", "afa", "clustal", "phylip"])
def test_alignment_round_trip(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("m", i, n, a) for i, (n, a) in enumerate(ALN)], alignments.ROWS)
    text = alignments.format_alignment(rows, fmt).orderBy("at").collect()
    path = _write(tmp_path / "x.aln", "\n".join(r.value for r in text) + "\n")
    got = alignments.read_alignments(spark, path, fmt).orderBy("row_idx").collect()
    assert [(r.row_idx, r.name, r.aligned) for r in got] == [(i, n, a) for i, (n, a) in enumerate(ALN)]


def test_sequential_phylip_and_a2m(spark, tmp_path):
    seq = "2 8\nfirst     ACDE\nFGHI\nsecond    KLMN\nPQRS\n"
    got = alignments.read_alignments(spark, _write(tmp_path / "p.phy", seq), "phylips").orderBy("row_idx").collect()
    assert [(r.name, r.aligned) for r in got] == [("first", "ACDEFGHI"), ("second", "KLMNPQRS")]
    a2m = ">a\nACdeF\n>b\nAC-\n>c\nACgF\n"
    got = {r.name: r.aligned for r in alignments.read_alignments(spark, _write(tmp_path / "x.a2m", a2m), "a2m").collect()}
    assert got == {"a": "ACdeF", "b": "AC..-", "c": "ACg.F"}


def test_tables_and_sniffing(spark, tmp_path):
    m = _write(tmp_path / "m.txt", "# scores\n   A  C\nA  4 -1\nC -1  9\n")
    assert {(r.a, r.b, r.score) for r in text_tables.read_score_matrix(spark, m).collect()} == {("A", "A", 4), ("A", "C", -1), ("C", "A", -1), ("C", "C", 9)}
    text_tables.write_score_matrix(text_tables.read_score_matrix(spark, m), str(tmp_path / "m2"), "AC")
    assert text_tables.read_score_matrix(spark, str(tmp_path / "m2")).count() == 4
    bg = _write(tmp_path / "bg.txt", "amino\nA 0.5\nC 0.5 # c\n")
    assert {(r.residue, r.f) for r in text_tables.read_background(spark, bg).collect()} == {("A", 0.5), ("C", 0.5)}
    assert sniff.sniff_path(spark, _write(tmp_path / "unknown", "\n>x\nAC\n")) == "fasta"
    assert sniff.sniff_path(spark, "x/y.sto.gz") == "stockholm"


def test_streamed_split_equals_batch_split(spark, tmp_path):
    seqs = [("ACDEFGHIKL" * 2)[i % 7:][:14] if i % 3 else "MNPQRSTVWY"[i % 4:] + "ACD" * (i % 5 + 1) for i in range(24)]
    rows = [(i, f"r{i}", s) for i, s in enumerate(seqs)]
    schema, opts = "idx bigint, name string, seq string", sp.SplitOptions(10**6, 10**6, 2)
    job = StreamingSplit(spark, str(tmp_path / "state"), 6, opts)
    folder = tmp_path / "in"
    os.makedirs(folder)
    for lo in (0, 12):
        spark.createDataFrame(rows[lo:lo + 12], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        job.start(stream, str(tmp_path / "ckpt")).awaitTermination()
    records = spark.createDataFrame(rows, schema)
    want = {r.idx: r.split for r in sp.split(records, seed_incidence(records, 6), opts=opts).collect()}
    assert {r.idx: r.split for r in job.result().collect()} == want


def test_records_follow_file_names_not_sizes(spark, tmp_path):
    (tmp_path / "many").mkdir()
    _write(tmp_path / "many" / "a.fa", ">a1\nACD\n>a2\nACD\n")
    _write(tmp_path / "many" / "b.fa", "".join(f">b{i}\n{'ACDEFGHIK' * 40}\n" for i in range(3000)))
    got = fasta.with_record_index(fasta.read_fasta(spark, str(tmp_path / "many"))).orderBy("idx").select("idx", "name").collect()
    assert [r.name for r in got] == ["a1", "a2"] + [f"b{i}" for i in range(3000)]
    assert [r.idx for r in got] == list(range(3002))


def test_batches_restart_at_each_limit(spark):
    from seqpart.operators.windows import batches_by_residues

    df = spark.createDataFrame([(i, n) for i, n in enumerate([30, 30, 90, 5, 5, 5, 5, 200, None, 10])], "idx bigint, n bigint")
    got = batches_by_residues(df, "idx", "n", 60, 3).orderBy("idx").collect()
    assert [r.batch for r in got] == [0, 0, 1, 2, 2, 2, 3, 3, 4, 4]
    assert batches_by_residues(df.limit(0), "idx", "n", 60, 3).collect() == []


def test_groups_without_a_fit_stay_with_null(spark):
    from seqpart.operators.fits import gumbel_fit

    df = spark.createDataFrame([("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None)] + [("ok", float(i * i % 17)) for i in range(50)], "k string, x double")
    got = {r.k: r.mu for r in gumbel_fit(df, ["k"], "x").collect()}
    assert set(got) == {"one", "same", "none", "ok"}
    assert got["ok"] is not None and got["one"] is got["same"] is got["none"] is None


def test_places_over_several_parts(spark):
    import random

    from pyspark.sql import functions as F

    from seqpart.plans.sizing import with_place

    values = list(range(5000))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(7)
    assert all(r.place == 5000 - r.v for r in with_place(df, -F.col("v")).collect())
