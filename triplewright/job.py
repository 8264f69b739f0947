"""Command-line job: N-Triples in, new instance, type and sameAs triples out.

    spark-submit --conf spark.checkpoint.dir=<shared folder> --py-files triplewright.zip run_job.py INPUT OUTPUT
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .plans.materialize import materialize
from .plans.workspace import Workspace
from .settings import Settings, session_conf
from .sources.ntriples import stage_lines
from .sources.sinks import write_result


def run(spark: SparkSession, args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="triplewright")
    parser.add_argument("input", help="N-Triples file, folder or glob; or a Parquet table with --from parquet")
    parser.add_argument("output", help="folder for new_instances, new_types, new_sameas and run_report")
    parser.add_argument("--from", dest="source", choices=("ntriples", "parquet"), default="ntriples")
    parser.add_argument("--format", choices=("ntriples", "parquet"), default="ntriples")
    parser.add_argument("--sameas", choices=("links", "pairs"), default="links")
    parser.add_argument("--lexical-only", action="store_true", help="drop language tags and datatypes")
    parser.add_argument("--generalized", action="store_true", help="keep literal subjects in N-Triples output")
    parser.add_argument("--schema", action="store_true", help="also write the closed hierarchies to new_schema")
    parser.add_argument("--rejects", help="folder for lines that are not triples")
    options = parser.parse_args(args)

    start, ws, rejected = time.time(), Workspace(spark), 0
    if options.source == "parquet":
        triples = spark.read.parquet(options.input)
    else:
        settings = Settings.of(spark)
        triples, rejects = stage_lines(spark.read.text(options.input), ws, options.lexical_only, settings.rows_per_file)
        rejected = rejects.count()
        if options.rejects:
            rejects.write.parquet(options.rejects)
    result = materialize(triples, workspace=ws)
    counts = write_result(result, options.output, options.format, options.sameas, options.generalized, options.schema)
    report = [(r.name, r.value) for r in result.metrics().collect()]  # one row for each name
    report += [("rejected_lines", rejected), ("rounds", len(result.rounds))]
    report += [(f"round_{n}", found) for n, found in enumerate(result.rounds, 1)]
    for name, (written, left_out) in counts.items():
        report += [(f"{name}_written", written), (f"{name}_left_out", left_out)]
    report.append(("seconds", round(time.time() - start)))
    spark.createDataFrame(report, "name string, value long").coalesce(1).write.parquet(f"{options.output}/run_report")
    for name, value in report:
        print(f"{name}: {value}")


def main() -> None:
    spark = SparkSession.builder.appName("triplewright").config(map=session_conf()).getOrCreate()
    try:
        run(spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
