"""Column functions that calculate: fuel, walking, water, batteries, temperatures, units, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MPG_US, MPG_UK, MILE_KM, GALLON_US, GALLON_UK, POUND_KG = 235.215, 282.481, 1.609344, 3.785411784, 4.54609, 0.45359237
#: To metres, kilograms, litres.
UNITS: dict[str, tuple[str, float]] = {
    "mm": ("length", 0.001), "cm": ("length", 0.01), "m": ("length", 1.0), "km": ("length", 1000.0), "in": ("length", 0.0254), "ft": ("length", 0.3048), "yd": ("length", 0.9144), "mi": ("length", 1609.344),
    "g": ("mass", 0.001), "kg": ("mass", 1.0), "oz": ("mass", 0.028349523125), "lb": ("mass", 0.45359237), "ml": ("volume", 0.001), "l": ("volume", 1.0), "gal": ("volume", 3.785411784),
}


def consumption(mpg: Column, uk: bool = False) -> Column:
    """Litres for 100 km; null for 0."""
    return F.lit(MPG_UK if uk else MPG_US) / F.nullif(mpg, F.lit(0.0))


def hiking_minutes(km: Column, climb_m: Column, kmh: float = 5.0, climb_mh: float = 600.0) -> Column:
    return km / kmh * 60 + climb_m / climb_mh * 60


def trip_fuel(km: Column, per_100: Column, price: Column) -> Column:
    return km * per_100 / 100 * price


def water_litres(people: Column, days: Column, each: Column) -> Column:
    return people * days * each


def watt_hours(mah: Column, volts: Column | None = None) -> Column:
    """At the stated voltage if it is one of a cell (3.0 to 4.5), else at 3.7."""
    v = F.lit(3.7) if volts is None else F.when(volts.between(3.0, 4.5), volts).otherwise(3.7)
    return mah * v / 1000


def charges(bank: Column, phone: Column, efficiency: float = 0.65) -> Column:
    """Whole charges."""
    return F.floor(bank * efficiency / phone + 1e-9)


def celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9


def fahrenheit(c: Column) -> Column:
    return c * 9 / 5 + 32


def boiling(metres: Column) -> Column:
    """Water's boiling point in °C at a height of 0 to 9000 m, else null."""
    kpa = 101.325 * F.pow(1 - 2.25577e-5 * metres, F.lit(5.25588))
    return F.when(metres.between(0, 9000), 1730.63 / (8.07131 - F.log10(kpa * 7.50062)) - 233.426)


def convert(value: Column, unit: str, to: str) -> Column:
    (kind, a), (other, b) = UNITS[unit], UNITS[to]
    return value * a / b if kind == other else F.lit(None).cast("double")


def exchange(amount: Column, rate: Column, percent_fee: float = 0.0) -> Column:
    return amount * rate * (1 - percent_fee / 100)


def clock(start: Column, minutes: Column, offset: Column) -> Column:
    """struct(day, minute) after minutes of travel from minute `start` into an offset of so many minutes."""
    at = start + minutes + offset
    return F.struct(F.floor(at / 1440).cast("int").alias("day"), F.pmod(at, F.lit(1440)).cast("int").alias("minute"))


def between(start: Column, end: Column) -> Column:
    """Minutes from one time of day to the next occurrence of another."""
    return F.pmod(end - start, F.lit(1440))


def fuel_range(litres: Column, per_100_km: Column) -> Column:
    """Kilometres on a tank, null unless both figures are above zero."""
    return F.when((litres > 0) & (per_100_km > 0), litres / per_100_km * 100)


def travel_hours(km: Column, km_per_hour: Column, stops: Column | None = None) -> Column:
    """struct(moving, whole) in hours: whole adds the minutes of stops, or ten minutes an hour where none are given."""
    moving = F.when(km_per_hour > 0, km / km_per_hour)
    return F.struct(moving.alias("moving"), (moving * 7 / 6 if stops is None else moving + stops / 60).alias("whole"))


def per_unit(price: Column, amount: Column) -> Column:
    return F.when(amount > 0, price / amount)


def scaled(amount: Column, servings: Column, wanted: Column) -> Column:
    """An ingredient for another number of servings."""
    return F.when(servings > 0, amount * wanted / servings)


def percent(base: Column, rate: Column) -> Column:
    return base * rate / 100


def zone_clock(instant: Column, zone: Column) -> Column:
    """struct(day, minute, ahead): the date and minute of the day that clocks of a zone show at an instant in UTC, and how many minutes they are ahead of it, summer time included."""
    local = F.from_utc_timestamp(instant, zone)
    minute = (F.hour(local) * 60 + F.minute(local)).alias("minute")
    return F.struct(F.to_date(local).alias("day"), minute, ((F.unix_timestamp(local) - F.unix_timestamp(instant)) / 60).cast("int").alias("ahead"))
