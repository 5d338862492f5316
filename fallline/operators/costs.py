"""What an edge costs a skier, as column expressions over an edge's attributes.

Conditions and skier are plain values that hold for one query; what differs between edges, and the
time at which one is reached, are columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .meeting import wind_factor, worst_first

# Fixed values of the cost model: seconds, metres, degrees, km/h, degrees Celsius.
RIDE_S = 360.0
LIFT_HOURS = (7, 21)
BASE_WAIT_S = {"gondola": 180.0, "cableCar": 180.0, "funicular": 180.0, "chairLift": 90.0, "tBar": 45.0, "platter": 45.0, "jBar": 45.0, "dragLift": 30.0, "ropeTow": 30.0, "magicCarpet": 15.0}
OTHER_WAIT_S = 90.0
HOUR_FACTOR = {8: 0.5, 9: 0.8, 10: 1.5, 11: 1.5, 12: 1.2, 13: 1.3, 14: 1.3, 15: 0.9}
LIFT_SPEED_MS = {"cableCar": 8.0, "funicular": 8.0, "gondola": 5.0, "chairLift": 2.5, "tBar": 3.0, "platter": 2.5, "ropeTow": 2.0, "magicCarpet": 1.0}
OTHER_LIFT_MS = 3.0
#: By skill: hardest difficulty, comfortable gradient, weight of steeper ones, loss per cm of fresh snow.
SKILLS = {"beginner": (0, 15.0, 0.8, 0.04), "intermediate": (1, 25.0, 0.6, 0.025), "advanced": (3, 35.0, 0.4, 0.012), "expert": (3, 45.0, 0.2, 0.005)}
SNOW_FACTOR = {"hardPack": 0.8, "softPack": 1.05, "slush": 0.75, "normal": 1.0}
#: Coefficients of variation of an edge's time where nothing was observed.
SPREAD = {"lift": 0.30, "run": 0.15, "traverse": 0.10}


@dataclass(frozen=True)
class Conditions:
    hour: float = 9.8
    weekend: bool = False
    temperature_c: float = -5.0
    base_m: float = 2000.0
    wind_kph: float = 20.0
    visibility_km: float = 10.0
    fresh_cm: float = 0.0


@dataclass(frozen=True)
class Skier:
    skill: str = "intermediate"
    speeds: tuple[float, ...] = (4.0, 6.0, 5.0, 3.0)
    moguls: float = 0.6
    ungroomed: float = 0.7
    gladed: float = 0.5
    icy: float = 0.5


def looked_up(key: Column, table: dict, other: float | None = None) -> Column:
    found = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]
    return found if other is None else F.coalesce(found, F.lit(other))


def lift_wait(kind: Column, capacity: Column, hour: Column, weekend: Column) -> Column:
    """Seconds in a lift's queue by its kind, size, the hour and the day, ten minutes at most."""
    size = F.when(capacity >= 6, 0.7).when(capacity >= 4, 0.85).otherwise(1.0)
    at = looked_up(F.floor(hour).cast("int"), HOUR_FACTOR, 1.0)
    return F.least(looked_up(kind, BASE_WAIT_S, OTHER_WAIT_S) * size * at * F.when(weekend, 1.4).otherwise(1.0), F.lit(600.0))


def ride_time(length_m: Column, kind: Column) -> Column:
    return length_m / looked_up(kind, LIFT_SPEED_MS, OTHER_LIFT_MS)


def lift_time(e: dict[str, Column], c: Conditions, offset_s: Column) -> Column:
    """Queue and ride; null when closed or reached out of hours. A live wait far from the usual one is not taken at its word."""
    hour = F.lit(c.hour) + offset_s / 3600
    usual = lift_wait(e["lift_type"], e["capacity"], hour, F.lit(c.weekend))
    live = e["wait_min"] * 60
    odd = (usual > 0) & ((live * 3 < usual) | (live > usual * 3))
    wait = F.when(e["wait_min"].between(0, 60), F.when(odd, 0.7 * live + 0.3 * usual).otherwise(live)).otherwise(usual)
    open_ = e["is_open"] & (F.floor(hour) >= LIFT_HOURS[0]) & (F.floor(hour) < LIFT_HOURS[1])
    return F.when(open_, (F.coalesce(e["ride_s"], F.lit(RIDE_S)) + wait) * wind_factor(F.lit(c.wind_kph)))


def sun_factor(exposure: Column, temperature: Column) -> Column:
    """The speed of snow by how much sun it has had: only losses count."""
    kind = F.when((exposure > 0.7) & (temperature > -1), "slush").when((exposure < 0.2) & (temperature < -3), "hardPack").when(exposure > 0.3, "softPack").otherwise("normal")
    return looked_up(kind, SNOW_FACTOR)


def exposure(altitude: Column, azimuth: Column, aspect: Column, variance: Column, cloud: Column) -> Column:
    """How much sun a slope gets, 0 to 1: none by night, half where its aspect is unknown."""
    off = F.abs(azimuth - aspect)
    off = F.least(off, 360 - off)
    facing = F.greatest(F.cos(F.radians(off)), F.lit(0.0))
    value = facing * F.sin(F.radians(altitude)) * (1 - variance * 0.7) * (1 - cloud / 100.0 * 0.7)
    return F.when(altitude <= 0, 0.0).when(aspect.isNull(), 0.5).otherwise(value)


def run_time(e: dict[str, Column], c: Conditions, s: Skier, gates: bool = True) -> Column:
    """Seconds down a run; null when closed, too hard or too slow. `observed_ms` and `observations` are the skier's own."""
    hardest, comfort, weight, per_cm = SKILLS[s.skill]
    level = F.coalesce(e["difficulty"], F.lit(1))
    own = F.get(F.array(*(F.lit(x) for x in s.speeds)), level)
    base = F.when((e["observations"] >= 3) & (e["observed_ms"] > 0), e["observed_ms"]).when(own > 0, own).otherwise(1.5)
    damp = F.when(base < 5.0, 0.7).otherwise(1.0)
    soft = lambda x: 1 - (1 - x) * damp
    here = F.when(e["mid_m"] > 0, F.lit(c.temperature_c) - 6.5 * (e["mid_m"] - c.base_m) / 1000).otherwise(F.lit(c.temperature_c))
    over = e["gradient"] - comfort
    ramp = F.least((e["gradient"] - 0.9 * comfort) / max(0.1 * comfort, 1.0), F.lit(1.0))
    steep = F.greatest(F.lit(0.3), 1 - (ramp + F.greatest(over, F.lit(0.0)) / 90.0) * weight)
    trail = F.array(
        F.when(e["moguls"], soft(F.lit(s.moguls))),
        F.when(e["groomed"].isNull(), soft(F.lit((s.ungroomed + 1) / 2))).when(~e["groomed"], soft(F.lit(s.ungroomed))),
        F.when(e["gladed"], soft(F.lit(s.gladed))),
        F.when((here < -3) & F.lit(s.icy < 1), soft(F.lit(0.7 + 0.3 * s.icy))),
        F.when(e["gradient"] > 0.9 * comfort, steep),
    )
    snowy = F.lit(c.fresh_cm > 5) & ~F.coalesce(e["groomed"], F.lit(False))
    weather = F.array(
        F.when(~e["gladed"] & F.lit(c.wind_kph > 30), F.lit(1 / (1 + max(c.wind_kph - 30, 0) * 0.01))),
        F.when(F.lit(c.visibility_km < 5), 1 / (1 + (5 - c.visibility_km) * 0.05 * F.when(e["gradient"] > 25, 1.5).otherwise(1.0))),
        F.when(snowy, 1 / (1 + c.fresh_cm * per_cm * F.when(e["groomed"].isNull(), 0.5).otherwise(1.0))),
        F.when(here < -15, 0.80).when(here < -8, 0.85).when(here < -3, 0.95),
    )
    bonus = F.when(F.coalesce(e["groomed"], F.lit(False)) & F.lit(c.fresh_cm > 0), F.lit(min(1 + c.fresh_cm * 0.002, 1.06))).otherwise(1.0)
    speed = base * F.greatest(worst_first(F.array_compact(trail)), F.lit(0.35)) * F.greatest(worst_first(F.array_compact(weather)), F.lit(0.60)) * bonus
    fit = (level <= hardest) & ~(e["gladed"] & F.lit(s.gladed == 0)) if gates else F.lit(True)
    return F.when(e["is_open"] & fit & (speed > 0.1), e["length_m"] / speed)


def traverse_time(e: dict[str, Column], c: Conditions) -> Column:
    """Seconds across: slower in deep snow, and for each metre uphill."""
    return F.when(e["is_open"], e["length_m"] / (1.5 * (0.7 if c.fresh_cm > 20 else 1.0)) + 6 * F.greatest(e["vertical_m"], F.lit(0.0)))


ATTRIBUTES = ("is_open", "lift_type", "capacity", "wait_min", "ride_s", "difficulty", "length_m", "vertical_m", "gradient", "groomed", "moguls", "gladed", "mid_m", "observed_ms", "observations")


def seconds(c: Conditions, s: Skier, offset_s: Column, gates: bool = True) -> Column:
    """What the edge of a row costs when it is reached so many seconds from the start; null where it cannot be taken."""
    e = {k: F.col(k) for k in ATTRIBUTES}
    return F.when(F.col("kind") == "lift", lift_time(e, c, offset_s)).when(F.col("kind") == "run", run_time(e, c, s, gates)).when(F.col("kind") == "traverse", traverse_time(e, c))


def variance(time: Column) -> Column:
    """Of the time an edge takes: from what was observed, else by its kind."""
    seen = (F.col("observations") >= 3) & (F.col("observed_ms") > 0) & (F.col("observed_var") > 0)
    usual = time * looked_up(F.col("kind"), SPREAD)
    return F.when(time <= 0, 0.0).when(seen, (time / F.col("observed_ms")) ** 2 * F.col("observed_var")).otherwise(usual * usual)
