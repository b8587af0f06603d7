"""Command lines: python -m parley.plans.cli {lsm,rlsm,merge-lsm,merge-rlsm} --help"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from parley.operators.merge import rounds_long, static_with_rolling
from parley.plans.runs import Options, run_lsm, run_rlsm
from parley.schema import CATEGORIES, EPS, ROLLING_WINDOW, WINDOW_MINUTES, ZERO_TOL
from parley.sources.sinks import save
from parley.sources.transcripts import read_table


def flag(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "t", "yes", "y")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="parley")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("lsm", "rlsm"):
        p = commands.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--dic", required=True)
        p.add_argument("--results", required=True)
    p = commands.choices["lsm"]
    p.add_argument("--round", type=int, choices=(1, 2))
    p.add_argument("--temporal", action="store_true")
    p.add_argument("--window", type=float, default=WINDOW_MINUTES)
    p = commands.choices["rlsm"]
    p.add_argument("--na_policy", default="bilateral_only", choices=("bilateral_only", "nanmean"))
    p.add_argument("--eps", type=float, default=EPS)
    p.add_argument("--zero_tol", type=float, default=ZERO_TOL)
    p.add_argument("--unitize", default="off", choices=("off", "approx", "strict"))
    p.add_argument("--merge_gap", type=float, default=0.0)
    p.add_argument("--strip_tags", type=flag, default=True)
    p.add_argument("--bracket_mode", default="unwrap", choices=("unwrap", "drop_all", "off"))
    p.add_argument("--enable_micro_ppron", action="store_true")
    p.add_argument("--rw", action="store_true")
    p.add_argument("--rw_window_size", type=int, default=ROLLING_WINDOW)
    p.add_argument("--rw_include_current", type=flag, default=True)
    p.add_argument("--rw_min_window_tokens", type=int, default=0)
    p = commands.add_parser("merge-lsm")
    p.add_argument("--lsm_1st", required=True)
    p.add_argument("--lsm_2nd", required=True)
    p.add_argument("--out", required=True)
    p = commands.add_parser("merge-rlsm")
    p.add_argument("--rlsm", required=True)
    p.add_argument("--rw", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--param-window", type=int)
    p.add_argument("--include-current", type=flag)
    p.add_argument("--min-window-tokens", type=int)
    p.add_argument("--na-policy")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("parley").getOrCreate()
    if a.command == "lsm":
        return run_lsm(spark, a.data, a.dic, a.results, a.round, a.temporal, a.window)
    if a.command == "rlsm":
        options = Options(
            a.na_policy, a.eps, a.zero_tol, a.unitize != "off", a.merge_gap, a.strip_tags, a.bracket_mode, a.enable_micro_ppron,
            a.rw, a.rw_window_size, a.rw_include_current, a.rw_min_window_tokens
        )
        return run_rlsm(spark, a.data, a.dic, a.results, options)
    if a.command == "merge-lsm":
        out, name = rounds_long(read_table(spark, a.lsm_1st), read_table(spark, a.lsm_2nd), CATEGORIES), "lsm_long"
    else:
        out, name = static_with_rolling(
            read_table(spark, a.rlsm), read_table(spark, a.rw), a.param_window, window=a.param_window,
            include_current=a.include_current, min_tokens=a.min_window_tokens, policy=a.na_policy
        ), "rlsm_merged"
    return [name] if save(out, a.out, name) else []


if __name__ == "__main__":
    main()
