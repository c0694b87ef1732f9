"""Plan and change feeds as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast.operators import condense
from lagcast.operators.condense import CHANGE_FIELDS
from lagcast.streaming.partials import run_fold


def partial_changes(changes: DataFrame) -> DataFrame:
    """Newest ``(ord, value)`` per attribute and stop; folds of folds are folds."""

    def newest(name: str):
        return F.max(F.when(F.col(name).isNotNull(), F.struct("ord", name))).alias(name)

    return changes.groupBy("stop_id").agg(*[newest(n) for n in CHANGE_FIELDS])


def merged_changes(partials: DataFrame) -> DataFrame:
    return partials.groupBy("stop_id").agg(*[F.max(n)[n].alias(n) for n in CHANGE_FIELDS])


def partial_rows(rows: DataFrame, newest: bool) -> DataFrame:
    """First or last whole row of each stop, with its position kept."""
    pick = F.max_by if newest else F.min_by
    fields = [c for c in rows.columns if c != "stop_id"]
    return rows.groupBy("stop_id").agg(pick(F.struct(*fields), "ord").alias("r")).select("stop_id", "r.*")


def fold_change_stream(changes: DataFrame) -> DataFrame:
    """Last known value per attribute and stop of a change stream."""
    return run_fold(changes, partial_changes, merged_changes, "changes")


def first_plan_stream(plan: DataFrame) -> DataFrame:
    """First labelled plan row per stop of a plan stream."""
    return run_fold(
        plan.filter("labelled"), lambda b: partial_rows(b, False), lambda p: condense.first_plan(p), "plans"
    )


def live_board_stream(plan: DataFrame, changes: DataFrame) -> DataFrame:
    """Live board from two streams: first plan rows with the latest whole change."""
    plans = run_fold(plan, lambda b: partial_rows(b, False), lambda p: partial_rows(p, False), "board-plan")
    latest = run_fold(changes, lambda b: partial_rows(b, True), lambda p: partial_rows(p, True), "board-change")
    return condense.live_board(plans, latest)


def condense_stream(plan: DataFrame, changes: DataFrame, stations=None) -> DataFrame:
    """Stop events from both streams with the daily folding rules."""
    return condense.condense(first_plan_stream(plan), fold_change_stream(changes), stations)
