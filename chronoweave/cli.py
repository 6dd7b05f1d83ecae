"""Command line: statements from files or arguments, queries, checks, evaluation, DOT export, interactive use."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import evaluation
from chronoweave.session import TemporalSession
from chronoweave.sources import graphs_io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronoweave", description="Temporal reasoning over statements.")
    p.add_argument("-i", "--input", help="file of statements, read as one block")
    p.add_argument("-s", "--statement", action="append", default=[], help="a statement; may be repeated")
    p.add_argument("-q", "--query", nargs=2, metavar=("SOURCE", "TARGET"), help="relation between two events")
    p.add_argument("-c", "--check", action="store_true", help="report contradictions")
    p.add_argument("-e", "--evaluate", metavar="FILE", help="evaluate a benchmark file, or 'generated'")
    p.add_argument("--save", metavar="FOLDER", help="also write the evaluation's metrics and report there")
    p.add_argument("--export-dot", metavar="FILE", help="write the graph as DOT")
    p.add_argument("--interactive", action="store_true", help="read statements and commands from standard input")
    p.add_argument("-v", "--verbose", action="store_true", help="also print events and relations")
    return p


def _show(session: TemporalSession) -> None:
    for r in session.events.orderBy("doc_id", "ord").collect():
        print(f"{r.event_id}: {r.description} [{r.start_time} - {r.end_time}]")
    for r in session.dot().where(F.col("line").contains("->")).orderBy("doc_id", "line_no").collect():
        print(r.line.strip())


def _answer(session: TemporalSession, source: str, target: str) -> None:
    print(f"{source} -> {target}: {session.query(source, target) or 'unknown'}")
    if why := session.explain(source, target):
        print(f"  {why}")


def interactive(session: TemporalSession) -> None:
    for line in sys.stdin:
        line = line.strip()
        if line in ("exit", "quit"):
            return
        if line == "reset":
            session.reset()
        elif line == "graph":
            _show(session)
        elif line.startswith("query ") and len(line.split()) == 3:
            _answer(session, *line.split()[1:])
        elif line:
            session.add_statement(line)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(args)
    for path in (options.input, options.evaluate if options.evaluate != "generated" else None):
        if path and not os.path.exists(path):
            print(f"no such file: {path}", file=sys.stderr)
            return 1
    spark = spark or SparkSession.builder.appName("chronoweave").getOrCreate()
    session = TemporalSession(spark)
    if options.evaluate:
        detail = session.evaluate(None if options.evaluate == "generated" else options.evaluate)
        for r in evaluation.report(detail).collect():
            print(r.line)
        if options.save:
            evaluation.save(detail, options.save)
        return 0
    if options.input:
        rows = graphs_io.read_text(spark, options.input)
        session.add_statements(rows.withColumn("doc_id", F.lit("inline")))
    for text in options.statement:
        session.add_statement(text)
    if options.interactive:
        interactive(session)
    if options.verbose:
        _show(session)
    if options.query:
        _answer(session, *options.query)
    if options.check:
        found = session.conflicts().collect()
        print("consistent" if not found else "\n".join(r.message for r in found))
    if options.export_dot:
        with open(options.export_dot, "w", encoding="utf-8") as out:
            out.writelines(f"{r.line}\n" for r in session.dot().orderBy("doc_id", "line_no").collect())
    return 0


if __name__ == "__main__":
    sys.exit(main())
