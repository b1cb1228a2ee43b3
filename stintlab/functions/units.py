"""Units and text forms of channels, clocks and lap times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres a second for one of each speed unit, and g for one of each acceleration unit.
#: An undeclared speed counts as km/h and an undeclared acceleration as g.
SPEED_UNITS = {"m/s": 1.0, "km/h": 1 / 3.6, "mph": 0.44704, "kn": 0.514444, "": 1 / 3.6}
ACCELERATION_UNITS = {"g": 1.0, "m/s2": 1 / 9.80665, "m/s^2": 1 / 9.80665, "m/s²": 1 / 9.80665, "": 1.0}
_SPEED_NAMES = {
    "km/h": "km/h", "kmh": "km/h", "kph": "km/h", "km/hr": "km/h", "mph": "mph", "mi/h": "mph", "m/s": "m/s",
    "kn": "kn", "kt": "kn", "knots": "kn", "": "",
}
#: Units of a direction.
DEGREE_UNITS = ("", "deg", "degree", "degrees", "°")
#: Words for a direction and for where it comes from.
DIRECTIONS = ("heading", "course", "bearing")
DIRECTION_SOURCES = ("gps", "calc", "rcz", "obd")


def _lookup(key: Column, table: dict) -> Column:
    out = F.when(F.lit(False), F.lit(next(iter(table.values()))))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out


def speed_unit(name: Column) -> Column:
    """The canonical name of a speed unit, or null."""
    return _lookup(F.lower(F.trim(name)), _SPEED_NAMES)


def speed_in_mps(value: Column, unit: Column) -> Column:
    return value * _lookup(speed_unit(unit), SPEED_UNITS)


def acceleration_in_g(value: Column, unit: Column) -> Column:
    return value * _lookup(F.replace(F.lower(F.trim(unit)), F.lit(" "), F.lit("")), ACCELERATION_UNITS)


def same_speed_unit(a: Column, b: Column) -> Column:
    """Whether two speeds may be subtracted: the same unit however written, or none on either side."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    known = [F.when(speed_unit(u).isin("km/h", "mph"), speed_unit(u)).otherwise(u) for u in (x, y)]
    return F.when((x == "") | (y == ""), (x == "") & (y == "")).otherwise(known[0] == known[1])


def is_speed(name: Column) -> Column:
    """Whether a channel is a speed by its name."""
    return (F.lower(name) == "speed") | F.lower(name).startswith("velocity")


def is_temperature(name: Column) -> Column:
    return F.lower(name).contains("temp")


def is_direction(name: Column, unit: Column) -> Column:
    """Whether a channel is a compass direction, in degrees: its name's words are one of the directions, a receiver before it
    or not, and behind it at most a source or a unit, then a unit."""
    words = F.filter(F.split(F.lower(F.trim(name)), "[-_ ()]+"), lambda w: w != "")
    first = F.when((F.get(words, F.lit(0)) == "gps") & (F.size(words) > 1), 1).otherwise(0)
    left = F.size(words) - first - 1
    after, last = (F.get(words, first + k) for k in (1, 2))
    behind = (left == 0) | (left == 1) & after.isin(*DIRECTION_SOURCES, *DEGREE_UNITS) | (left == 2) & after.isin(*DIRECTION_SOURCES, "deg", "degrees") & last.isin(*DEGREE_UNITS)
    return F.get(words, first).isin(*DIRECTIONS) & behind & F.lower(F.trim(unit)).isin(*DEGREE_UNITS)


def turns_near(value: Column, reference: Column) -> Column:
    """The whole turns, in degrees, that bring a direction within half a turn of another; halves go away from zero."""
    turns = (value - reference) / 360.0
    return -360.0 * F.signum(turns) * F.floor(F.abs(turns) + 0.5)


def declared_unit(own: Column, name: Column, headers: Column) -> Column:
    """A channel's unit: its own, else what follows its name on the first of the header's lines that begins so."""
    words = F.transform(headers, lambda h: F.split(F.trim(h), r"\s+"))
    line = F.filter(words, lambda w: (F.size(w) >= 2) & (F.lower(w[0]) == F.lower(name)))
    rest = F.when(F.size(line) > 0, F.array_join(F.slice(F.get(line, F.lit(0)), 2, 1000), " "))
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), rest, F.lit(""))


def effective_unit(declared: Column, name: Column, assumed: Column) -> Column:
    """The unit that analysis reads: of a speed without a declared one, the one assumed for it."""
    known = F.when(speed_unit(declared).isin("km/h", "mph"), speed_unit(declared)).otherwise(F.trim(declared))
    guess = F.when(speed_unit(assumed).isin("km/h", "mph"), speed_unit(assumed)).otherwise(F.lit(""))
    return F.when(~is_speed(name), declared).otherwise(F.coalesce(F.nullif(known, F.lit("")), guess))


#: Edges of a spread's bands in seconds, and tolerances of two recordings of one quantity by unit.
SPREAD_BANDS = (0.10, 0.25, 0.50, 1.00)
TOLERANCES = {"km/h": 2.0, "kmh": 2.0, "kph": 2.0, "%": 3.0, "g": 0.05, "c": 2.0, "°c": 2.0, "degc": 2.0, "rpm": 100.0}


def _digits(text: Column, least: int, most: int) -> Column:
    """Whether a text is that many of the ten digits."""
    return F.length(text).between(least, most) & (F.translate(text, "0123456789", "") == "")


def setup_number(text: Column) -> Column:
    """Up to three digits and up to two decimals after a point, white space apart, or null."""
    parts = F.split(F.regexp_replace(text, r"\s", ""), "[.]")
    whole, rest = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    fits = (F.size(parts) <= 2) & _digits(whole, 0, 3) & _digits(rest, 0, 2) & (F.length(whole) + F.length(rest) > 0)
    return F.when(fits, F.concat(F.lit("0"), whole, F.lit("."), rest, F.lit("0")).cast("double"))


def spread_band(seconds: Column) -> Column:
    """How many of the fixed edges a spread exceeds."""
    return sum((F.when(seconds > e, 1).otherwise(0) for e in SPREAD_BANDS), F.lit(0))


def conflict_tolerance(unit: Column, overlap_range: Column) -> Column:
    """The difference above which two recordings of one quantity conflict: by unit, else 5 % of the range."""
    return F.coalesce(_lookup(F.lower(F.trim(unit)), TOLERANCES), F.greatest(F.lit(1e-9), F.abs(overlap_range) * 0.05))


def celsius(value: Column, unit: Column) -> Column:
    unit = F.upper(F.trim(unit))
    return F.when(unit.isin("C", "°C"), value).when(unit.isin("F", "°F"), (value - 32) / 1.8).when(unit == "K", value - 273.15)


def parse_clock(text: Column) -> Column:
    """Seconds of ``HH:MM:SS.f``, ``HHMMSS.f`` or plain seconds; null for anything else."""
    point = F.split(text, "[.]")
    whole, rest = F.get(point, F.lit(0)), F.get(point, F.lit(1))
    sound = (F.size(point) == 1) | (F.size(point) == 2) & _digits(rest, 1, 1000)
    places = F.split(whole, ":")
    packed = _digits(whole, 6, 6)
    h, m, s = (F.when(packed, F.substring(whole, 2 * k + 1, 2)).otherwise(F.get(places, F.lit(k))) for k in range(3))
    clock = packed | (F.size(places) == 3) & _digits(h, 1, 2) & _digits(m, 2, 2) & _digits(s, 2, 2)
    # a day's hours, an hour's minutes, a minute's seconds
    h, m, s = h.try_cast("int"), m.try_cast("int"), F.concat_ws(".", s, rest).try_cast("double")
    total = F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)
    return F.when(sound & clock, total).when(sound & _digits(whole, 1, 1000), text.try_cast("double"))


def lap_time_text(seconds: Column) -> Column:
    """``m:ss.mmm`` of whole milliseconds, halves away from zero."""
    ms = F.round(seconds * 1000).cast("long")
    return F.concat(
        F.floor(ms / 60000).cast("string"), F.lit(":"), F.lpad(F.floor(ms % 60000 / 1000).cast("string"), 2, "0"),
        F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def association_strength(rho: Column) -> Column:
    size = F.abs(rho)
    return F.when(size.isNull(), None).when(size >= 0.6, "strong").when(size >= 0.3, "moderate").otherwise("weak")
