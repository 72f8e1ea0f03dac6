"""Operator decisions on exchange groups and the lists built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrain.functions.status import DECISION_SECONDS, effective_decision
from fleetgrain.functions.text import is_blank
from fleetgrain.functions.times import at_lit, fresh
from fleetgrain.operators.ordered import hour_chunk, max_before

FINAL = ("executed", "rejected")
# List order of effective states.
STATUS_ORDER = ("claimed", "in_analysis", "new", "expired", "rejected", "executed")


def _rank() -> Column:
    """Decisions only move up: in_analysis, claimed, then a final state."""
    status = F.col("status")
    return F.when(status == "in_analysis", 1).when(status == "claimed", 2).when(status.isin(*FINAL), 3)


def _reason_ok() -> Column:
    rejected = F.col("status") == "rejected"
    return F.when(rejected, ~is_blank(F.col("reason"))).otherwise(F.col("reason").isNull())


def classify_events(events: DataFrame) -> DataFrame:
    """Adds `outcome`: applied, repeat, conflict or invalid.

    Because every allowed transition raises the rank and no other does, an
    event applies exactly when its rank exceeds all valid ranks before it.
    """
    ranked = events.withColumn("_rank", F.when(_reason_ok(), _rank())).withColumn(
        "_chunk", hour_chunk(F.col("occurred_at"))
    )
    # the current state is the earliest event of the highest rank so far
    level = F.when(
        F.col("_rank").isNotNull(),
        F.struct("_rank", (-F.unix_micros("occurred_at")).alias("t"), (-F.col("event_id")).alias("e"), "status"),
    )
    seen = max_before(
        ranked, ["execution_key"], "_chunk", [F.col("occurred_at"), F.col("event_id")], level, "_state"
    )
    outcome = (
        F.when(F.col("_rank").isNull(), "invalid")
        .when(F.col("_state").isNull() | (F.col("_rank") > F.col("_state._rank")), "applied")
        .when(F.col("status") == F.col("_state.status"), "repeat")
        .otherwise("conflict")
    )
    return seen.withColumn("outcome", outcome).drop("_rank", "_chunk", "_state")


def decision_state(events: DataFrame) -> DataFrame:
    """Current decision per exchange group: one aggregation, no ordering of the log."""
    valid = events.withColumn("_rank", F.when(_reason_ok(), _rank())).filter("_rank IS NOT NULL")
    first = F.struct("_rank", -F.unix_micros("occurred_at"), -F.col("event_id"))
    return (
        valid.groupBy("execution_key")
        .agg(F.max_by(F.struct("status", "occurred_at", "actor", "reason"), first).alias("d"))
        .select(
            "execution_key", "d.status", F.col("d.occurred_at").alias("updated_at"),
            F.trim("d.actor").alias("updated_by"), F.trim("d.reason").alias("rejection_reason"),
            F.when(F.col("d.status") == "executed", F.col("d.occurred_at")).alias("executed_at"),
            F.when(F.col("d.status") == "executed", F.trim("d.actor")).alias("executed_by"),
        )
    )


def validate_current_groups(requested: DataFrame, groups: DataFrame) -> DataFrame:
    """Decisions whose group is part of the current prescription."""
    return requested.join(groups.select("execution_key"), "execution_key", "left_semi")


def with_effective_status(groups: DataFrame, decisions: DataFrame, at: Column | str) -> DataFrame:
    status = decisions.select("execution_key", F.col("status").alias("decision_status"))
    return groups.join(status, "execution_key", "left").withColumn(
        "effective_status",
        effective_decision(F.col("decision_status"), F.col("first_departure_at"), at_lit(at)),
    )


def rank_groups(groups: DataFrame, decisions: DataFrame, at: Column | str) -> DataFrame:
    """Groups by state, then earliest departure, then saved delay descending."""
    order = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("effective_status"))
    return (
        with_effective_status(groups, decisions, at)
        .withColumn("status_rank", order.cast("int"))
        .orderBy("status_rank", "first_departure_at", F.desc("saved_delay_seconds"))
    )


def assignment_rows(
    assigned: DataFrame, grouped: DataFrame, decisions: DataFrame, show_all: bool = False
) -> DataFrame:
    """Plan rows with group and decision; changed only by default, final ones last."""
    rows = assigned if show_all else assigned.filter("changed")
    groups = grouped.select("terminal_id", "vehicle_prefix", "group_id", "execution_key")
    status = decisions.select("execution_key", F.col("status").alias("decision_status"))
    return (
        rows.join(groups, ["terminal_id", "vehicle_prefix"], "left")
        .join(status, "execution_key", "left")
        .withColumn("is_final", F.coalesce(F.col("decision_status").isin(*FINAL), F.lit(False)))
        .orderBy("is_final", "departure_at", "vehicle_prefix")
    )


def recent_decisions(decisions: DataFrame, at: Column | str, limit: int | None = None) -> DataFrame:
    """Last 24 hours, newest first; the first `limit` where a list of that length is asked for."""
    recent = decisions.filter(fresh(F.col("updated_at"), at_lit(at), DECISION_SECONDS)).orderBy(F.desc("updated_at"), "execution_key")
    return recent if limit is None else recent.limit(limit)


def urgent_actions(steps: DataFrame, decisions: DataFrame, limit: int = 4) -> DataFrame:
    """Next departures among steps of groups without a final decision."""
    final = decisions.filter(F.col("status").isin(*FINAL))
    open_steps = steps.join(final.select("execution_key"), "execution_key", "left_anti")
    return open_steps.orderBy("departure_at", "terminal_id", "vehicle_prefix").limit(limit)


def first_departures(steps: DataFrame) -> DataFrame:
    return steps.groupBy("execution_key").agg(F.min("departure_at").alias("first_departure_at"))


def newest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")
