"""``python -m pagetrail.cli train DATA OUTPUT``: train and export classifiers for all workloads of a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pagetrail.plans.training import NS, Options, summary, train


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagetrail")
    p = top.add_subparsers(dest="command", required=True).add_parser("train")
    p.add_argument("data_dir")
    p.add_argument("output_dir")
    p.add_argument("--workloads", nargs="*")
    p.add_argument("--horizon-seconds", type=float)
    p.add_argument("--capacity-pages", type=int)
    p.add_argument("--residency-cap-seconds", type=float)
    p.add_argument("--target-rows", type=int, default=2_000_000)
    p.add_argument("--balanced", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--n-bins", type=int, default=10)
    p.add_argument("--max-iterations", type=int, default=100)
    p.add_argument("--early-stopping", action="store_true", help="learn in epochs, up to the one with the best area over the holdout")
    p.add_argument("--max-epochs", type=int, default=50)
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--weight-scale", type=int, default=10_000)
    p.add_argument("--disc-sample-size", type=int, default=200_000)
    p.add_argument("--eval-rows", type=int, default=300_000)
    p.add_argument("--holdout-frac", type=float, default=0.2)
    p.add_argument("--seed", type=int, default=42)
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("pagetrail").getOrCreate()
    ns = lambda s: None if s is None else int(s * NS)
    options = Options(horizon=ns(a.horizon_seconds), capacity_pages=a.capacity_pages, residency_cap=ns(a.residency_cap_seconds), target_rows=a.target_rows, balanced=a.balanced, n_bins=a.n_bins, max_iterations=a.max_iterations, early_stopping=a.early_stopping, max_epochs=a.max_epochs, threshold=a.threshold, weight_scale=a.weight_scale, disc_sample_size=a.disc_sample_size, eval_rows=a.eval_rows, holdout_frac=a.holdout_frac, random_state=a.seed)
    summary(spark, train(spark, a.data_dir, a.output_dir, workloads=a.workloads, options=options)).show(truncate=False)


if __name__ == "__main__":
    main()
