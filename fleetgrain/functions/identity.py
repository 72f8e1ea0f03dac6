"""Content keys: metric keys and execution keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ascii_json(json: Column) -> Column:
    """Escape characters beyond ASCII as \\uXXXX, only where there are any."""
    escaped = F.array_join(
        F.transform(
            F.split(json, ""),
            lambda ch: F.when(
                F.ascii(ch) > 127,
                F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(ch)), 4, "0"))),
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(json.rlike(r"[^\x00-\x7F]"), escaped).otherwise(json)


def metric_key(
    scope: Column, origin: Column, destination: Column, route: Column, direction: Column
) -> Column:
    """SHA-256 of the canonical JSON: sorted names, no blanks, nulls kept."""
    body = F.to_json(
        F.struct(
            destination.cast("string").alias("destination_stop_id"),
            direction.cast("int").alias("direction_id"),
            origin.cast("string").alias("origin_stop_id"),
            route.cast("string").alias("route_id"),
            scope.alias("scope"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.sha2(_ascii_json(body), 256)


def execution_key(terminal: Column, steps: Column) -> Column:
    """SHA-256 over the terminal and ordered (commitment, assigned, departure) steps."""
    actions = F.array_join(
        F.transform(
            steps,
            lambda s: F.concat(
                s["commitment"], F.lit(">"), s["assigned"], F.lit("@"),
                F.date_format(s["departure_at"], "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
            ),
        ),
        "|",
    )
    return F.sha2(F.concat(terminal, F.lit("|"), actions), 256)
