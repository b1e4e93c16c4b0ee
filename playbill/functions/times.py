"""Time functions. Instants are UTC without zone; the local zone is UTC-3 all year."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_HOURS = 3
GRACE_MINUTES = 15
FIRST_EDITION = datetime(2026, 4, 27, 3)

# Spanish names; weekdays from Monday.
WEEKDAYS = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")
WEEKDAYS_SHORT = ("lun", "mar", "mié", "jue", "vie", "sáb", "dom")
PLURAL = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábados", "domingos")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
MONTHS_SHORT = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sept", "oct", "nov", "dic")


def lit(t: datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{t:%Y-%m-%d %H:%M:%S}'")


def shift(ts: Column, **parts: int) -> Column:
    return ts + F.make_interval(**{k: F.lit(v) for k, v in parts.items()})


def local(ts: Column) -> Column:
    return ts - F.expr(f"INTERVAL {OFFSET_HOURS} HOURS")


def local_day(ts: Column) -> Column:
    return F.to_date(local(ts))


def catchable(ts: Column, now: datetime) -> Column:
    """Not over: a showing may be entered until GRACE_MINUTES after its start. The bare column keeps the filter in the scan."""
    return ts >= lit(now - timedelta(minutes=GRACE_MINUTES))


def today_start(now: datetime) -> datetime:
    day = now - timedelta(hours=OFFSET_HOURS)
    return datetime(day.year, day.month, day.day) + timedelta(hours=OFFSET_HOURS)


def next_monday(now: datetime) -> datetime:
    return today_start(now) + timedelta(days=7 - (now - timedelta(hours=OFFSET_HOURS)).weekday())


def week_start(now: datetime) -> datetime:
    return next_monday(now) - timedelta(days=7)


#: Name -> bounds, lower inclusive and upper exclusive, of the named windows.
WINDOWS = {
    "hoy": lambda now: (today_start(now), today_start(now) + timedelta(days=1)),
    "finde": lambda now: (max(today_start(now), next_monday(now) - timedelta(days=3)), next_monday(now)),
    "semana": lambda now: (today_start(now), today_start(now) + timedelta(days=7)),
    "prox": lambda now: (today_start(now) + timedelta(days=7), today_start(now) + timedelta(days=90)),
}


def window_bounds(name: str | None, now: datetime) -> tuple[datetime, datetime]:
    return WINDOWS.get(name or "hoy", WINDOWS["hoy"])(now)


def edition(monday: Column) -> Column:
    return F.greatest(F.lit(1), F.round(F.datediff(monday, lit(FIRST_EDITION)) / 7).cast("int") + 1)


def edition_sentence(number: Column, screenings: Column, venues: Column) -> Column:
    n = lambda c, one, many: F.concat(c.cast("string"), F.when(c == 1, f" {one}").otherwise(f" {many}"))
    return F.concat(F.lit("Edición número "), number.cast("string"), F.lit(". "), n(screenings, "función", "funciones"), F.lit(" en "), n(venues, "sala", "salas"), F.lit("."))


def local_iso(ts: Column) -> Column:
    return F.concat(F.date_format(local(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"-0{OFFSET_HOURS}:00"))


def _of(names, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), number)


def weekday_name(day: Column, names=WEEKDAYS) -> Column:
    return _of(names, F.weekday(day) + 1)


def month_name(day: Column, names=MONTHS) -> Column:
    return _of(names, F.month(day))


def day_label(day: Column) -> Column:
    return F.concat(weekday_name(day), F.lit(" "), F.dayofmonth(day), F.lit(" de "), month_name(day))


def day_short(day: Column) -> Column:
    return F.concat(F.dayofmonth(day), F.lit(" "), F.initcap(month_name(day, MONTHS_SHORT)))


def day_chip(day: Column, now: datetime) -> Column:
    today = F.to_date(F.lit(f"{now - timedelta(hours=OFFSET_HOURS):%Y-%m-%d}"))
    return F.when(day == today, "Hoy").otherwise(F.concat(F.initcap(weekday_name(day, WEEKDAYS_SHORT)), F.lit(" "), F.dayofmonth(day)))


def week_label(monday: Column) -> Column:
    sunday = F.date_add(monday, 6)
    same = F.concat(F.lit("Semana del "), F.dayofmonth(monday), F.lit(" al "), F.dayofmonth(sunday), F.lit(" de "), month_name(monday))
    across = F.concat(F.lit("Semana del "), F.dayofmonth(monday), F.lit(" de "), month_name(monday), F.lit(" al "), F.dayofmonth(sunday), F.lit(" de "), month_name(sunday))
    return F.when(F.month(monday) == F.month(sunday), same).otherwise(across)


def date_range_label(first: Column, last: Column) -> Column:
    m = lambda d: month_name(d, MONTHS_SHORT)
    return (
        F.when(first == last, F.concat(F.dayofmonth(first), F.lit(" "), m(first)))
        .when(m(first) == m(last), F.concat(F.dayofmonth(first), F.lit("–"), F.dayofmonth(last), F.lit(" "), m(first)))
        .otherwise(F.concat(F.dayofmonth(first), F.lit(" "), m(first), F.lit(" – "), F.dayofmonth(last), F.lit(" "), m(last)))
    )


def weekday_set_label(days: Column) -> Column:
    """The label of a sorted array of distinct weekdays (0: Monday)."""
    n, first, last = F.size(days), F.element_at(days, 1), F.element_at(days, -1)
    name = lambda d, names=WEEKDAYS: _of(names, d + 1)
    listed = F.transform(days, lambda d: name(d))
    return (
        F.when(n == 0, "")
        .when(n == 7, "Todos los días")
        .when((n == 5) & (last == 4), "De lunes a viernes")
        .when(n == 1, F.concat(F.lit("Los "), name(first, PLURAL)))
        .when(n == 2, F.concat(F.initcap(name(first)), F.lit(" y "), name(last)))
        .when(last - first == n - 1, F.concat(F.lit("De "), name(first), F.lit(" a "), name(last)))
        .otherwise(F.concat(F.initcap(F.element_at(listed, 1)), F.lit(", "), F.array_join(F.slice(listed, 2, F.greatest(n - 2, F.lit(1))), ", "), F.lit(" y "), F.element_at(listed, -1)))
    )


def cinema_clock(ts: Column) -> Column:
    """Minutes of the cinema day: what starts before 5 o'clock comes after 23:59."""
    h = F.hour(ts)
    return F.when(h < 5, h + 24).otherwise(h) * 60 + F.minute(ts)


def end_time(ts: Column, runtime: Column, unknown: int = 120) -> Column:
    return ts + F.make_interval(mins=F.coalesce(F.nullif(runtime, F.lit(0)), F.lit(unknown)))
