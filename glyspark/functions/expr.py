"""Column functions; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
#: Formats of date literals, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "dd-MM-yyyy HH:mm", "yyyy-MM-dd HH:mm:ss")
#: Weekday names, Monday first.
WEEKDAYS = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")


def value(name: str = "glucose") -> Column:
    return F.col(name).cast("double")


def micros(time: Column | str = "time") -> Column:
    """Microseconds since the epoch of a naive time (the session's time zone is UTC)."""
    time = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(time.cast("timestamp"))


def by_time(by) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("time")


def day(time: str = "time") -> Column:
    return F.to_date(time)


def minute_of_day(time: str = "time") -> Column:
    return F.hour(time) * 60 + F.minute(time)


def second_of_day(time: str = "time") -> Column:
    return minute_of_day(time) * 60 + F.second(time)


def clock(minute: Column) -> Column:
    """HH:MM of a minute of the day."""
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def decimal_hour(time: str = "time") -> Column:
    return F.round(F.hour(time) + F.minute(time) / F.lit(60.0), 2)


def weekday_name(time: str = "time") -> Column:
    return F.element_at(F.array(*(F.lit(d) for d in WEEKDAYS)), F.weekday(time) + 1)


def percent(condition: Column) -> Column:
    """Share of rows where the condition holds, in percent; an aggregate."""
    return F.try_divide(F.sum(F.when(condition, 1).otherwise(0)) * F.lit(100.0), F.count(F.lit(1)))


def between(low: float, high: float, g: Column | None = None) -> Column:
    """Both bounds count."""
    return (value() if g is None else g).between(float(low), float(high))


def half_even(x: Column, digits: int = 2) -> Column:
    """Rounding of the scaled value, halves to even."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def skewness(x: Column) -> Column:
    """Bias-corrected; null below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess; null below four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def bg_risk(g: Column) -> Column:
    """Symmetrised glucose; null for values that are not positive."""
    return F.lit(1.509) * (F.pow(F.ln(g), F.lit(1.084)) - F.lit(5.381))


def low_risk(g: Column) -> Column:
    f = bg_risk(g)
    return F.when(f < 0, F.lit(10.0) * f * f).otherwise(F.lit(0.0))


def high_risk(g: Column) -> Column:
    f = bg_risk(g)
    return F.when(f > 0, F.lit(10.0) * f * f).otherwise(F.lit(0.0))


def grade(g: Column) -> Column:
    """GRADE of a reading in mg/dL; 50 outside [37, 630]."""
    return F.when(g.between(37.0, 630.0), F.lit(425.0) * F.pow(F.log10(F.log10(g / F.lit(18.0))) + F.lit(0.16), 2)).otherwise(F.lit(50.0))


def m_term(g: Column, reference: float = 90) -> Column:
    return F.pow(F.abs(F.lit(10.0) * F.log10(g / F.lit(float(reference)))), 3)


def in_segment(start: str, hours: float, time: str = "time") -> Column:
    """Time of day in [start, start + hours); wraps at midnight, and a whole day is empty."""
    h, m = map(int, start.split(":"))
    lo = (h * 60 + m) * 60
    hi = int(lo + hours * 3600) % 86_400
    s = second_of_day(time)
    return (s >= lo) & (s < hi) if lo <= hi else (s >= lo) | (s < hi)


def period(frequency: str, time: str = "time") -> Column:
    """Start of the period: D day, M month, W week from Tuesday, W-ISO week from Monday."""
    d = F.to_date(time)
    if frequency == "D":
        return d
    if frequency == "M":
        return F.trunc(d, "MM")
    if frequency == "W":
        return F.date_add(F.trunc(F.date_sub(d, 1), "WEEK"), 1)
    if frequency == "W-ISO":
        return F.trunc(d, "WEEK")
    raise ValueError("frequency must be 'D', 'W', 'W-ISO' or 'M'")


def parse_date(text: Column, formats=DATE_FORMATS) -> Column:
    """The first format that fits; null if none."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats))
