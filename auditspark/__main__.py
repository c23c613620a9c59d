"""Runs queries and experiments: ``python -m auditspark list | run NAME... | smoke | stages | stage T1 F3 ...``.

A stage reads transactions from ``--transactions`` (a folder), L5 a PaySim file from ``--paysim``;
without a folder the rows are generated.
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback


def _stages(parser: argparse.ArgumentParser, given: argparse.Namespace) -> int:
    from auditspark.plans import report, stages

    known = [*stages.STAGES, "L5"]
    if given.stage == "stages":
        print("\n".join(known))
        return 0
    if unknown := set(given.names) - set(known):
        parser.error(f"no such stage: {', '.join(sorted(unknown))}")
    if "L5" in given.names and not given.paysim:
        parser.error("L5 needs --paysim")

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = stages.Run(model=given.model, folds=given.folds, tuning=given.tuning)
    rows, clock = None, report.Clock()
    for name in given.names:
        with clock.step(name):
            if name == "L5":
                tables = stages.paysim_tables(spark, given.paysim, run)
            else:
                rows = stages.rows(spark, given.transactions, given.entities) if rows is None else rows
                tables = stages.STAGES[name](rows, run)
            for table, df in tables.items():
                if given.out:
                    report.save_table(df, given.out, table)
                else:
                    df.show(50, truncate=False)
    clock.table(spark).show(truncate=False)
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="auditspark", description=__doc__)
    parser.add_argument("stage", choices=("list", "run", "smoke", "stages", "stage"))
    parser.add_argument("names", nargs="*")
    parser.add_argument("--data", default="/root/testdata/sf0.001", help="folder of the tables")
    parser.add_argument("--out", help="folder for result tables; without it they are shown")
    parser.add_argument("--transactions", help="folder of transactions for stages; without it rows are generated")
    parser.add_argument("--paysim", help="PaySim file for the stage L5")
    parser.add_argument("--entities", type=int, default=3000, help="entities that are generated")
    parser.add_argument("--model", default="gbt", help="baseline of the stages")
    parser.add_argument("--folds", type=int, help="at most so many folds of each protocol")
    parser.add_argument("--tuning", type=int, default=0, help="settings tried for each baseline")
    given = parser.parse_args(args)

    from auditspark.plans import catalog, report

    queries = catalog.queries()
    if given.stage == "list":
        print("\n".join(queries))
        return 0
    if given.stage.startswith("stage"):
        return _stages(parser, given)
    if unknown := set(given.names) - set(queries):
        parser.error(f"no such query: {', '.join(sorted(unknown))}")

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(report.environment(spark))
    failed = []
    for name in given.names or (queries if given.stage == "smoke" else ()):
        began = time.perf_counter()
        try:
            df = queries[name](spark, given.data)
            if given.out:
                report.save_table(df, given.out, name)
            elif given.stage == "run":
                df.show(20, truncate=False)
            else:
                df.count()
            print(f"{name}: {time.perf_counter() - began:.1f} s")
        except Exception:  # noqa: BLE001  a smoke run reports every failure
            traceback.print_exc()
            failed.append(name)
    if failed:
        print("failed:", *failed)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
