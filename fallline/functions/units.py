"""Measures as text, metric or imperial, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET = 3.28084


def whole(x: Column, unit: str) -> Column:
    """Cut toward zero, with its unit."""
    return F.concat(x.cast("long").cast("string"), F.lit(unit))


def temperature(celsius: Column, metric: bool = True) -> Column:
    return F.format_string("%.0f°C", celsius) if metric else F.format_string("%.0f°F", celsius * 9 / 5 + 32)


def elevation(metres: Column, metric: bool = True) -> Column:
    return whole(metres, "M") if metric else whole(metres * FEET, "FT")


def distance(metres: Column, metric: bool = True) -> Column:
    """Kilometres or miles with one digit from one on, metres or feet below."""
    if metric:
        return F.when(metres >= 1000, F.format_string("%.1fKM", metres / 1000)).otherwise(whole(metres, "M"))
    return F.when(metres * FEET >= 5280, F.format_string("%.1fMI", metres * FEET / 5280)).otherwise(whole(metres * FEET, "FT"))


def wind(kph: Column, metric: bool = True) -> Column:
    return F.format_string("%.0f KPH", kph) if metric else F.format_string("%.0f MPH", kph * 0.621371)


def snowfall(cm: Column, metric: bool = True) -> Column:
    """Null for half a centimetre or less."""
    return F.when(cm > 0.5, F.format_string("%.0fCM NEW", cm) if metric else F.format_string("%.0fIN NEW", cm / 2.54))


def duration(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds."""
    s = seconds.cast("long")
    text = lambda x: x.cast("long").cast("string")
    minutes = F.floor(s / 60)
    hours = F.concat(text(F.floor(minutes / 60)), F.lit("h "), text(minutes % 60), F.lit("m"))
    return F.when(minutes >= 60, hours).when(minutes > 0, F.concat(text(minutes), F.lit("m "), text(s % 60), F.lit("s"))).otherwise(F.concat(text(s), F.lit("s")))
