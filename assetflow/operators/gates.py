"""Run summaries, strata rollups and the acceptance gates for paired experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from assetflow.functions.checks import exit_code, run_status


def run_summary(outcomes: DataFrame, run: str = "run") -> DataFrame:
    """Counters, bytes and seconds per run from its page outcomes."""
    status = F.col("status")
    counted = {
        "processed": status == "complete",
        "skipped": status == "skipped",
        "deferred": status == "deferred",
        "failed": status == "error",
    }
    done = F.col("status") == "complete"
    sums = outcomes.groupBy(run).agg(
        *[F.count_if(test).alias(name) for name, test in counted.items()],
        F.coalesce(F.sum(F.when(done, F.col("output_bytes"))), F.lit(0)).alias("output_bytes"),
        F.coalesce(F.sum(F.when(done, F.col("seconds"))), F.lit(0.0)).alias("seconds"),
    )
    return sums.withColumns(
        {
            "run_status": run_status(F.col("failed"), F.col("deferred")),
            "exit_code": exit_code(F.col("failed"), F.col("deferred")),
            "worklist_kept": (F.col("failed") > 0) | (F.col("deferred") > 0),
        }
    )


def strata_rollup(outcomes: DataFrame, strata: Sequence[str] = ("route", "tile")) -> DataFrame:
    """Pages, bytes and mean seconds by stratum with subtotals (``level``: grouping id)."""
    return outcomes.rollup(*strata).agg(
        F.grouping_id().cast("long").alias("level"),
        F.count(F.lit(1)).alias("pages"),
        F.sum("output_bytes").alias("output_bytes"),
        F.avg("seconds").alias("mean_seconds"),
    )


def peak_memory(pages: DataFrame, limit_bytes: int, run: str = "run", value: str = "peak_reserved_bytes") -> DataFrame:
    """Highest reservation per run and how many pages break the limit or carry no evidence."""
    return pages.groupBy(run).agg(
        F.max(value).alias("peak_reserved_bytes"),
        F.count_if(F.col(value) > limit_bytes).alias("over_limit"),
        F.count_if(F.col(value).isNull() | (F.col(value) < 1)).alias("without_evidence"),
    )


def coverage_stats(facts: DataFrame, threshold: int = 1000) -> DataFrame:
    """One row: exact-threshold, grayscale, colour and odd-dimension counts, pixel extremes."""
    w, h = F.col("width"), F.col("height")
    return facts.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.least(w, h) == threshold).alias("exact_threshold"),
        F.count_if(F.col("grayscale")).alias("grayscale"),
        F.count_if(~F.col("grayscale")).alias("rgb_or_color"),
        F.count_if((w % 2 != 0) | (h % 2 != 0)).alias("odd_dimension"),
        F.min(w * h).alias("minimum_selected_pixels"),
        F.max(w * h).alias("maximum_selected_pixels"),
    )


def round_times(rounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean wall time of both sides side by side."""
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("wall_ms")))
    return rounds.groupBy(*by).agg(mean("a").alias("base_ms"), mean("b").alias("candidate_ms"))


def paired_gate(
    rounds: DataFrame,
    min_gain: float = 0.03,
    max_cv: float = 0.03,
    max_regression: float = 0.02,
    strata: Sequence[str] = ("route", "tile"),
) -> DataFrame:
    """Accept or reject a candidate (side ``b``) against the base (side ``a``), one row.

    Gain is 1 - mean paired ratio over rounds; both sides need a coefficient of variation
    below ``max_cv``; no stratum may be slower by more than ``max_regression``.  Use a
    ``min_gain`` of 0.05 for graph, runtime, precision or operator changes.
    """
    per_round = round_times(rounds, ["round"])
    ratio = F.try_divide(F.col("candidate_ms"), F.col("base_ms"))
    cv = lambda c: F.try_divide(F.stddev_samp(c), F.avg(c))
    overall = per_round.agg(
        F.count(F.lit(1)).alias("rounds"),
        (1 - F.avg(ratio)).alias("gain"),
        cv("base_ms").alias("base_cv"),
        cv("candidate_ms").alias("candidate_cv"),
    )
    worst = round_times(rounds, strata).agg(F.max(ratio - 1).alias("worst_stratum_regression"))
    steady = (F.col("base_cv") < max_cv) & (F.col("candidate_cv") < max_cv)
    verdict = (
        F.when(~F.coalesce(steady, F.lit(False)), "unstable")
        .when(F.col("worst_stratum_regression") > max_regression, "stratum_regression")
        .when(F.col("gain") < min_gain, "insufficient_gain")
        .otherwise("accept")
    )
    return overall.crossJoin(worst).withColumn("verdict", verdict)  # one row each


def early_stop(rounds: DataFrame, candidate: Sequence[str] = ("route", "tile"), limit: int = 2) -> DataFrame:
    """Per candidate and round: slower rounds so far and whether to stop.

    Rows are first folded to one per candidate and round, which bounds the window.
    """
    times = round_times(rounds, [*candidate, "round"])
    slower = F.coalesce(F.col("candidate_ms") > F.col("base_ms"), F.lit(False)).cast("long")
    running = Window.partitionBy(*candidate).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return times.withColumn("slower", slower).select(
        *candidate,
        "round",
        (F.col("slower") == 1).alias("slower"),
        F.sum("slower").over(running).alias("slower_rounds"),
        (F.sum("slower").over(running) >= limit).alias("stop"),
    )


def bytes_balance(outputs: DataFrame, job: DataFrame, run: str = "run") -> DataFrame:
    """Summed output sizes against the job counter: equal on a first run, zero on an incremental one.

    ``job``: run, run_kind, output_bytes.
    """
    produced = outputs.groupBy(run).agg(F.sum("output_bytes").alias("produced_bytes"))
    expected = F.when(F.col("run_kind") == "first", F.coalesce("produced_bytes", F.lit(0))).otherwise(F.lit(0))
    return job.join(produced, run, "left").select(
        run, "run_kind", "output_bytes", expected.alias("expected_bytes"), (F.col("output_bytes") == expected).alias("balanced")
    )
