"""Registered queries: a Spark builder and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunloom.workload.relations import SQL, Relations


#: added before rounding, in both engines: a mean that ends in an exact half would
#: otherwise go up or down by the last bit, which depends on the order of summation
NUDGE = 1e-9


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Relations], DataFrame]
    sql: str | None
    needs: tuple[str, ...]
    floats: tuple[str, ...]
    ints: tuple[str, ...]
    dates: tuple[str, ...]
    decimals: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(self.build(Relations(spark, sf_dir)), self.decimals)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        parts = [f"{n} as ({SQL[n]})" for n in with_dependencies(self.needs)]
        swaps = [f"round({c} + {NUDGE}, {self.decimals}) + 0.0 as {c}" for c in self.floats]
        swaps += [f"cast({c} as bigint) as {c}" for c in self.ints]
        swaps += [f"cast({c} as varchar) as {c}" for c in self.dates]
        replace = f" replace ({', '.join(swaps)})" if swaps else ""
        head = "with " + ",\n".join(parts) + "\n" if parts else ""
        return f"{head}select *{replace} from (\n{self.sql.strip()}\n)"


# which relations each relation reads
DEPENDS = {
    "e": (),
    **{n: ("e",) for n in ("inverter", "meteo", "poi", "status", "failures", "pred")},
    "inverter_s": ("inverter",), "meteo_s": ("meteo",), "poi_s": ("poi",), "status_s": ("status",),
    "inverter_h": ("inverter_s",), "meteo_h": ("meteo_s",), "poi_h": ("poi_s",), "status_h": ("status_s",),
    "inverter_d": ("inverter_h",), "meteo_d": ("meteo_h",), "poi_d": ("poi_h",), "status_d": ("status_h",),
    "plant_h": ("inverter_h", "meteo_h", "poi_h", "status_s"),
    "plant_d": ("inverter_d", "meteo_d", "poi_d", "status_d"),
    "anomalies": ("pred",), "forecasts": ("pred",),
    "series_h": ("inverter",),
    "episodes": ("inverter_s",), "failure_d": ("episodes",),
    "thresholds": ("inverter_s",),
    "gaps": ("inverter",),
}


def with_dependencies(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS[n]:
            add(d)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def comparable(df: DataFrame, decimals: int) -> DataFrame:
    """Plain types with rounded doubles, so that two engines can be compared."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), decimals) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, needs: str = "", floats: str = "", ints: str = "", dates: str = "", decimals: int = 6):
    """Register a builder under a name."""
    def register(build: Callable[[Relations], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(name, build, sql, tuple(needs.split()), tuple(floats.split()), tuple(ints.split()), tuple(dates.split()), decimals)
        return build
    return register
