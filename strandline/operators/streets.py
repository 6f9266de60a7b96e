"""Street attributes: lanes, friction, costs per vehicle, and demand weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: weights of the friction components and friction strength of each vehicle, and tag values that count
VEHICLES = {
    "van": {"lanes_scarcity": 0.20, "restricted_access": 0.25, "bus_only": 0.10, "pedestrian_zone": 0.15, "slope": 0.10, "no_stopping": 0.20, "lambda": 1.0},
    "cargo_bike": {"lanes_scarcity": 0.05, "restricted_access": 0.20, "bus_only": 0.05, "pedestrian_zone": 0.05, "slope": 0.45, "no_stopping": 0.20, "lambda": 0.5},
}
RESTRICTED = ("no", "private", "delivery")
BUS = "designated|yes|lane|bus_only"
ON_FOOT = ("pedestrian", "footway", "path", "living_street", "track")
NO_STOPPING = "no_stopping|no_parking"
COMPONENTS = ("lanes_scarcity", "restricted_access", "bus_only", "pedestrian_zone", "slope", "no_stopping")


def lanes(tag: Column) -> Column:
    """The greatest whole part of the numbers of a tag like '2;3'; null without any, or if a part is no number."""
    parts = F.transform(F.filter(F.split(tag, r"[;|,]"), lambda p: F.trim(p) != ""), lambda p: F.trim(p).try_cast("double"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), F.floor(F.array_max(parts)).cast("int"))


def friction(segments: DataFrame, access: tuple = ("access",), bus: tuple = ("bus",), parking: tuple = ("parking",)) -> DataFrame:
    """segments with a column f_<component> in 0..1 for each of COMPONENTS.

    Reads lanes, highway, grade and the tag columns named; what is missing counts as no
    friction, but for lanes, of which two are assumed.
    """
    n = F.coalesce(lanes(F.col("lanes")), F.lit(2))

    def one_of(columns, test):
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(test(F.lower(c)), F.lit(False))
        return found.cast("double")

    return (segments.withColumn("f_lanes_scarcity", 1 - F.least(n, F.lit(3)) / 3.0)
            .withColumn("f_restricted_access", one_of(access, lambda c: c.isin(*RESTRICTED)))
            .withColumn("f_bus_only", one_of(bus, lambda c: c.rlike(BUS)))
            .withColumn("f_pedestrian_zone", one_of(("highway",), lambda c: c.isin(*ON_FOOT)))
            .withColumn("f_slope", F.least(F.abs(F.coalesce("grade", F.lit(0.0))), F.lit(0.12)) / 0.12)
            .withColumn("f_no_stopping", one_of(parking, lambda c: c.rlike(NO_STOPPING))))


def base_cost(length: Column, speed: Column, travel_time: Column) -> Column:
    """Seconds: the travel time, or length at the speed (1 km/h at least, 30 if missing)."""
    return F.coalesce(travel_time, F.coalesce(length, F.lit(0.0)) / (F.greatest(F.coalesce(speed, F.lit(30.0)), F.lit(1.0)) * 1000.0 / 3600.0))


def costs(segments: DataFrame, vehicles: dict = VEHICLES) -> DataFrame:
    """segments with c_base, and for each vehicle phi_<v> (weighted friction) and c_eff_<v> = c_base * (1 + lambda * phi)."""
    out = segments.withColumn("c_base", base_cost(F.col("length"), F.col("speed_kph"), F.col("travel_time")))
    for v, weights in vehicles.items():
        phi = sum((F.col(f"f_{c}") * weights[c] for c in COMPONENTS), F.lit(0.0))
        out = out.withColumn(f"phi_{v}", phi).withColumn(f"c_eff_{v}", F.col("c_base") * (1 + weights["lambda"] * phi))
    return out


def overridden(base: Column, phi: Column, strength: float) -> Column:
    """Cost under another friction strength: base * (1 + strength * phi), a missing phi counting as 0."""
    return base * (1 + strength * F.coalesce(phi, F.lit(0.0)))


def demand_weight(cells: DataFrame, alpha: float, fallback: int = 250) -> DataFrame:
    """cells (cell_id, pop, poi, ...) with w = alpha * pop / max + (1 - alpha) * poi / max, those above 0 only.

    If no cell is above 0, the first `fallback` cells by id stay with weight 1.
    """
    top = cells.agg(F.max("pop").alias("_p"), F.max("poi").alias("_q"))
    part = lambda c, m: F.when(F.col(m) > 0, F.coalesce(F.col(c), F.lit(0)) / F.col(m)).otherwise(0.0)
    w = cells.join(F.broadcast(top)).withColumn("w", alpha * part("pop", "_p") + (1 - alpha) * part("poi", "_q")).drop("_p", "_q")
    some = w.where("w > 0")
    if some.isEmpty():
        return cells.orderBy("cell_id").limit(fallback).withColumn("w", F.lit(1.0))
    return some


def inventory(df: DataFrame, by: list[str], values: list[str], flags: list[str]) -> DataFrame:
    """by, n, and of each value its median, mean and sample deviation, of each flag its share."""
    stats = [x for v in values for x in (F.percentile(v, F.lit(0.5)).alias(f"{v}_median"), F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *stats, *[F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")).alias(f"{f}_share") for f in flags])


def tertile(order: list, by: list[str]) -> Column:
    """1, 2 or 3 by position (ties in the order given): up to a third, up to two thirds, the rest."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.row_number().over(w.orderBy(*order)) / F.count("*").over(w)
    return F.when(share <= 1 / 3, 1).when(share <= 2 / 3, 2).otherwise(3)
