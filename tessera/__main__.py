"""Command line for the reference's flow: load -> run a task -> export; or profile a table.

    python -m tessera run data.csv --task Regression --model "Ridge Regression" --target price --out out/
    python -m tessera profile data.csv --out out/profile

``run`` writes ``results/`` (CSV part files), ``report/`` (one JSON document)
and ``model/`` (the fitted PipelineModel) under ``--out`` and prints the
report. ``profile`` writes the tidy ``(section, name, value)`` table as CSV.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tessera")
    sub = ap.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run", help="run one task end to end")
    run.add_argument("path")
    run.add_argument("--task", required=True)
    run.add_argument("--model", required=True)
    run.add_argument("--target")
    run.add_argument("--test-size", type=float, default=0.2)
    run.add_argument("--seed", type=int, default=42)
    run.add_argument("--key", action="append", default=None, help="unique key column (repeatable)")
    run.add_argument("--exclude", action="append", default=[], help="column kept out of the features")
    run.add_argument("--param", action="append", default=[], help="name=value passed in params")
    run.add_argument("--format", default=None, help="csv or parquet (default: from the extension)")
    run.add_argument("--out", required=True)
    prof = sub.add_parser("profile", help="dataset profile (shape, dtypes, missing, preview)")
    prof.add_argument("path")
    prof.add_argument("--format", default=None)
    prof.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    from tessera.session import get_spark
    from tessera.sinks import save_model, write_report_json, write_results_csv
    from tessera.sources.parquet import load, source_name

    spark = get_spark()
    df = load(spark, args.path, args.format)
    out = args.out.rstrip("/")
    if args.cmd == "profile":
        from tessera.operators.profile import profile_frame

        write_results_csv(profile_frame(spark, df, source_name(args.path)), f"{out}", single_file=True)
        return 0

    from tessera.plans.tasks import run_task

    params = {}
    for item in args.param:
        name, _, value = item.partition("=")
        try:
            params[name] = json.loads(value)
        except ValueError:
            params[name] = value
    res = run_task(df, args.task, args.model, args.target, args.test_size, args.seed, params=params,
                   key_cols=args.key, exclude=args.exclude)
    write_results_csv(res.results, f"{out}/results")
    write_report_json(spark, res.report, f"{out}/report")
    save_model(res.model, f"{out}/model")
    print(json.dumps(res.report, indent=2, default=str))
    res.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
