"""Command line: rewrite a benchmark, audit pairs, merge shards, write a report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from duoscope import backends
from duoscope.operators import audit, generation, shards
from duoscope.sinks import files, report
from duoscope.sources import results
from duoscope.specs.dialects import load_dialect


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="duoscope")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="rewrite a table of samples (id, question, benchmark)")
    a = sub.add_parser("audit", help="ask both prompts of a table of pairs")
    for x in (g, a):
        x.add_argument("--input", required=True)
        x.add_argument("--output", required=True)
        x.add_argument("--start", type=int, default=0)
        x.add_argument("--end", type=int)
        x.add_argument("--backend", default="echo", choices=sorted(backends.BACKENDS))
        x.add_argument("--model", default="echo")
        x.add_argument("--base-url", default="")
        x.add_argument("--parallel", type=int)
        x.add_argument("--no-save", action="store_true")
        x.add_argument("--quiet", action="store_true")
    g.add_argument("--dialect", required=True)
    g.add_argument("--spec-dir")
    c = sub.add_parser("combine", help="merge audited shards, first row per id")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--output", required=True)
    c.add_argument("--mode", default="audit", choices=["audit", "generation"])
    d = sub.add_parser("cleanup", help="list which audit files to keep: the most successful per model, benchmark and dialect; nothing is deleted")
    d.add_argument("--input", required=True)
    r = sub.add_parser("report", help="write a page from a table of audit summaries")
    r.add_argument("--input", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--title", default="Dialect audit")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("duoscope").getOrCreate()
    if args.command in ("generate", "audit"):
        options = {"url": args.base_url, "model": args.model} if args.backend != "echo" else {}
        client = backends.make_client(args.backend, **options)
        rows = shards.slice_rows(spark.read.parquet(args.input), ["id"], ["benchmark"], args.start, args.end)
        if args.command == "generate":
            good, failed, counts = backends.generate(rows, load_dialect(args.dialect, args.spec_dir), client, parallel=args.parallel)
            if not args.no_save:
                files.write_pairs(good, f"{args.output}/pairs")
                files.write_pairs(failed, f"{args.output}/failed_pairs")
        else:
            good, counts = backends.run_audit(rows, args.model, client, args.parallel)
            if not args.no_save:
                files.write_audits(good, args.output)
        if not args.quiet:
            counts.show(100, truncate=False)
            if args.command == "audit":
                audit.mismatches(good).select("id", "expected_answer", "original_answer", "transformed_answer").orderBy("id").limit(10).show(truncate=60)
    elif args.command == "combine":
        parts = [spark.read.parquet(p).withColumn("_shard", F.lit(i)) for i, p in enumerate(args.inputs)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        keys = ["benchmark", "dialect"] if args.mode == "generation" else ["benchmark", "dialect", "model"]
        first = shards.dedup_first_id(shards.require_same(whole, keys), ["id"], ["_shard"])
        if args.mode == "generation":
            first.drop("_shard").write.mode("overwrite").parquet(f"{args.output}/pairs")
            status = first if "status" in first.columns else first.withColumn("status", F.lit("passed"))
            generation.counts(status, keys).write.mode("overwrite").parquet(f"{args.output}/summary")
            return 0
        first.drop("_shard").write.mode("overwrite").parquet(f"{args.output}/pairs")
        audit.confusion(first, ["benchmark", "dialect", "model"]).write.mode("overwrite").parquet(f"{args.output}/summary")
    elif args.command == "cleanup":
        rows = results.audit_rows(spark, args.input)
        quality = rows.groupBy("file_name", "model", "benchmark", "dialect").agg(F.count("*").alias("pairs"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("error").isNull()).alias("successful"))
        shards.most_successful(quality.withColumn("file_id", F.col("file_name")), ["model", "benchmark", "dialect"]).select("file_name", "pairs", "errors", "successful", "keep").orderBy("file_name").show(1_000, truncate=False)
    else:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(report.html(spark.read.parquet(args.input), args.title))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
