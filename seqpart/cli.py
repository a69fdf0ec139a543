"""Command line: filter, split and cascade over FASTA files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpart.operators import decisions, similarity as sim, split as sp
from seqpart.operators.cascade import CascadeOptions, cascade
from seqpart.session import build_session
from seqpart.sources.fasta import check_capacity, read_fasta, with_record_index, write_fasta


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqpart")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("filter", help="compare queries with targets")
    f.add_argument("queries")
    f.add_argument("targets")
    f.add_argument("--format", type=int, default=1, choices=range(5))
    f.add_argument("--all_hits", action="store_true")
    f.add_argument("--no_self", action="store_true")
    f.add_argument("--flip", action="store_true")
    f.add_argument("--plow", type=float, default=0.0)
    f.add_argument("--phigh", type=float, default=0.0)
    f.add_argument("--qblock", type=int)
    f.add_argument("--tblock", type=int)
    s = sub.add_parser("split", help="split a database into train, test and val")
    s.add_argument("database")
    for name, value in (("test_limit", 5000), ("val_limit", 5000), ("init_chunk", 1), ("seed", 42), ("resume", 0)):
        s.add_argument(f"--{name}", type=int, default=value)
    s.add_argument("--halt", type=int)
    s.add_argument("--strict", action="store_true")
    for name in ("train", "test", "val"):
        s.add_argument(f"--load_{name}")
    c = sub.add_parser("cascade", help="remove records of one side by a series of engines")
    c.add_argument("--order", required=True)
    c.add_argument("--db-file", required=True)
    c.add_argument("--fixed-file", required=True)
    c.add_argument("--remove", default="db", choices=("db", "fixed"))
    for q in (f, s):
        q.add_argument("--task_id", type=int, help="number of an array task, part of the output's name")
        q.add_argument("--shard_id", default="", help="name of a shard, put after the task's number")
    for q in (f, s, c):
        q.add_argument("--output", required=True)
        q.add_argument("-E", type=float, default=0.01)
        q.add_argument("-Z", type=float)
    return p


def _load(spark, path: str) -> DataFrame:
    return with_record_index(read_fasta(spark, path)).select("idx", "name", "descr", "seq")


def _output(args: argparse.Namespace) -> str:
    """Where a task writes: tasks and shards of one command never share a folder."""
    task = args.shard_id if args.task_id is None else f"_{args.task_id}{args.shard_id}"
    return args.output.rstrip("/") + task


def run(argv: list[str]) -> int:
    args = _parser().parse_args(argv)
    spark = build_session("seqpart", shuffle_partitions=200)
    if args.command == "cascade":
        opts = CascadeOptions(order=args.order, remove=args.remove, e=args.E, z=81514348.0 if args.Z is None else args.Z)
        left, status = cascade(_load(spark, args.db_file), _load(spark, args.fixed_file), opts)
        write_fasta(left, args.output, F.col("descr"))
        print(status)
        return 0
    if args.command == "filter":
        q, t = _load(spark, args.queries), _load(spark, args.targets)
        for frame, cap in ((q, args.qblock), (t, args.tblock)):
            if cap is not None:
                check_capacity(frame, cap)
        opts = sim.SearchOptions(e=args.E, z=next(v for v in (args.Z, args.tblock, 81514348.0) if v is not None), pid_low=args.plow, pid_high=args.phigh, flip=args.flip,
                                 no_self=args.no_self)
        hits = sim.profile_hits(q, t, opts).select("q_key", "t_key", "d_idx", "pid", "ln_e", "trace_len")
        rows = decisions.expand(hits, q, t, opts.no_self) if args.all_hits else decisions.first_hits(hits, q, t, opts.no_self)
        decisions.report(args.format, q, rows).write.mode("overwrite").text(_output(args))
        return 0
    db = _load(spark, args.database)
    opts = sp.SplitOptions(args.test_limit, args.val_limit, args.init_chunk, args.seed, args.resume, args.halt, args.strict)
    loaded = [(s, getattr(args, f"load_{s}")) for s in ("train", "test", "val") if getattr(args, f"load_{s}")]
    parts = [_load(spark, path).withColumn("split", F.lit(s)) for s, path in loaded]
    everything, preload = db, None
    if parts:
        old = parts[0]
        for at, part in enumerate(parts[1:], start=1):
            old = old.unionByName(part.withColumn("idx", F.col("idx") + at * 2**40))
        old = old.withColumn("idx", -1 - F.col("idx"))
        preload, everything = old.select("idx", "split"), db.unionByName(old.drop("split"))
    hits = sim.profile_hits(everything, everything, sim.SearchOptions(e=args.E, z=81514348.0 if args.Z is None else args.Z))
    # content-level hits are hubs: a record listens to every sequence its own sequence hits and publishes its own
    keyed = everything.select("idx", sim.sequence_key(F.col("seq")).alias("key"))
    listens = keyed.join(hits.select(F.col("q_key").alias("key"), F.col("t_key").alias("hub")).distinct(), "key").select("idx", "hub")
    placed = sp.split(db, listens, keyed.select("idx", F.col("key").alias("hub")), opts, preload=preload)
    write_fasta(db.join(placed, "idx"), _output(args), F.col("descr"), by="split")
    sp.split_stats(placed, db.count()).show(truncate=False)
    return 0


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()
