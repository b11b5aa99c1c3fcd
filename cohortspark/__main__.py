"""Command line: python -m cohortspark VERB ... over folders of Parquet tables."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("cohortspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _views(spark, folder: str) -> None:
    for p in sorted(Path(folder).glob("*.parquet")):
        spark.read.parquet(str(p)).createOrReplaceTempView(p.name[: -len(".parquet")])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohortspark")
    verbs = parser.add_subparsers(dest="verb", required=True)
    add = lambda name, *names: [v := verbs.add_parser(name), [v.add_argument(n) for n in names]][0]
    add("list")
    add("query", "name", "folder", "out")
    add("sql", "file", "folder")
    federated = add("federated", "file", "folder")
    federated.add_argument("--min-cell", type=int, default=5)
    add("import-responses", "files", "out")
    add("read-questionnaire", "file")
    add("report", "folder")
    export = add("export", "folder", "out")
    export.add_argument("--overwrite", action="store_true")
    a = parser.parse_args(args)

    from cohortspark.plans import catalogue, problem_queries, refresh, report
    from cohortspark.sources import instruments, study_files

    queries = catalogue.QUERIES | problem_queries.QUERIES
    if a.verb == "list":
        print("\n".join(sorted(queries)))
        return 0
    if a.verb == "read-questionnaire":
        import json

        print(json.dumps(instruments.read_questionnaire(Path(a.file).read_text()), indent=1))
        return 0
    spark = _session()
    if a.verb == "query":
        queries[a.name](spark, a.folder).write.parquet(a.out)
    elif a.verb == "sql":
        _views(spark, a.folder)
        for df in study_files.run_sql_file(spark, Path(a.file).read_text()):
            df.show(1000, truncate=False)
    elif a.verb == "federated":
        from cohortspark.operators.disclosure import run_federated

        _views(spark, a.folder)
        try:
            print(run_federated(spark, Path(a.file).read_text(), a.min_cell).as_json())
        except ValueError as e:
            print(f"refused: {e}", file=sys.stderr)
            return 1
    elif a.verb == "import-responses":
        from pyspark.sql import functions as F

        from cohortspark.operators.response_atoms import answer_atoms

        answer_atoms(study_files.read_responses(spark, a.files).withColumn("rec_no", F.monotonically_increasing_id())).write.parquet(a.out)
    elif a.verb == "report":
        for name in ("report_overview", "report_scores", "boolean_proportion", "numeric_statistics", "report_choices"):
            print(report.markdown(queries[name](spark, a.folder), name.removeprefix("report_").replace("_", " "), 5000))
    elif a.verb == "export":
        tables = {p.name[: -len(".parquet")]: spark.read.parquet(str(p)) for p in sorted(Path(a.folder).glob("*.parquet"))}
        print(refresh.export(tables, a.out, overwrite=a.overwrite)[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
