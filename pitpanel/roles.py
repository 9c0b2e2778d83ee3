"""Role binding: operators name roles, a binding names columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Roles:
    entity: str = "gsis_id"
    group: str = "team"
    rival: str = "opponent_team"
    cohort: str = "position"
    era: str = "season"
    period: str = "week"
    event: str = "game_id"
    # Numeric expression that never falls as (era, period) grows; cuts hot keys into runs.
    clock_sql: str = "CAST(season AS DOUBLE) * 100 + week"
    extra: dict = field(default_factory=dict)

    @property
    def order(self) -> list[str]:
        return [self.era, self.period, self.event]

    @property
    def clock(self) -> Column:
        return F.expr(self.clock_sql)

    def with_(self, **changes) -> "Roles":
        return replace(self, **changes)


PLAYER_PANEL = Roles()

ORDERS_PANEL = Roles(
    entity="custkey",
    group="nation",
    rival="nation",
    cohort="segment",
    era="era",
    period="ordered_at",
    event="orderkey",
    clock_sql="CAST(unix_micros(CAST(ordered_at AS TIMESTAMP)) AS DOUBLE)",
)
