"""Command line: ``analyze`` a table, or ``risk-run`` a policy on it."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import audit, workflow
from .sources import load_csv, load_excel, load_parquet, load_v02_json


def _load(spark: SparkSession, path: str) -> DataFrame:
    readers = {".csv": load_csv, ".xlsx": load_excel, ".parquet": load_parquet}
    suffix = Path(path).suffix
    if suffix not in readers:
        raise ValueError(f"unsupported input: {suffix or path}")
    return readers[suffix](spark, path)


def _failed(what: object, code: int) -> int:
    print(f"error: {what}", file=sys.stderr)
    return code


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 done, 2 wrong arguments; a failed ``analyze`` 1; a failed ``risk-run`` 2 for wrong input, 3 for files, 70 else."""
    parser = argparse.ArgumentParser(prog="gristmill")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze")
    a.add_argument("input")
    a.add_argument("-o", "--output", required=True)
    a.add_argument("--format", choices=("markdown", "html"), default="markdown")
    a.add_argument("--target")
    a.add_argument("--task", choices=("classification", "regression"))
    a.add_argument("--id-column", action="append", default=[])
    a.add_argument("--group-by")
    a.add_argument("--include-model", action="store_true")
    r = commands.add_parser("risk-run")
    r.add_argument("input")
    r.add_argument("-o", "--output", required=True)
    r.add_argument("--format", choices=("markdown", "html"), default="markdown")
    r.add_argument("--policy-json")
    r.add_argument("--warning-json")
    r.add_argument("--row-key", help="column that orders rows of one time; a warning document needs it")
    r.add_argument("--audit", action="store_true")
    r.add_argument("--no-overwrite", action="store_true")
    r.add_argument("--label")
    r.add_argument("--score")
    r.add_argument("--probability")
    given = parser.parse_args(arguments)
    session = spark or SparkSession.builder.appName("gristmill").getOrCreate()
    try:
        df = _load(session, given.input)
        if given.command == "analyze":
            run = workflow.run_analysis(df, target=given.target, task=given.task, id_columns=given.id_column, group_by=given.group_by, include_model=given.include_model)
            made = workflow.generate_analysis_report(run, given.output, format=given.format)
        else:
            score = (given.label, given.score, given.probability) if given.label and given.score else None
            documents = [Path(x) if x else None for x in (given.policy_json, given.warning_json)]
            policy, warning = load_v02_json(*documents, key=given.row_key, outcome_column=given.label, probability_column=given.probability) if any(documents) else (None, None)
            result = workflow.run_risk_workflow(workflow.RiskRequest(df, audit.AuditRoles() if given.audit else None, score=score, strategy=policy, lifecycle=warning))
            made = workflow.generate_risk_report(result, given.output, format=given.format, overwrite=not given.no_overwrite)
    except (ValueError, TypeError) as error:
        return _failed(error, 1 if given.command == "analyze" else 2)
    except OSError as error:
        return _failed(error, 1 if given.command == "analyze" else 3)
    except Exception:
        if given.command == "analyze":
            raise
        return _failed("internal error", 70)
    print(made.path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
