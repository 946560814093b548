"""Timeframes: names, lengths and calendar arithmetic on epoch milliseconds (UTC)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from candela.errors import TimeframeUnsupported

SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000
WEEK = 7 * DAY
#: The Unix epoch is a Thursday; the first Monday after it is four days later.
FIRST_MONDAY = 4 * DAY
_UNITS = {"s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY}
_UNIT_NAMES = {"s": "second", "m": "minute", "h": "hour", "D": "day", "W": "week", "M": "month"}
#: Spellings that live canonical bars may have.
CANONICAL = ("1s", "1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "12h", "1D", "1W", "1M")


def canonical(name: str) -> str:
    """``D/1d`` -> ``1D``, ``W`` -> ``1W``, ``M`` and ``1M`` -> ``1M`` (a month; ``5M`` is five minutes), ``60`` -> ``60m``."""
    text = name.strip()
    if text in ("M", "1M"):
        return "1M"
    if text.upper() in ("D", "1D"):
        return "1D"
    if text.upper() in ("W", "1W"):
        return "1W"
    if text.isascii() and text.isdigit() and int(text) > 0:
        return f"{int(text)}m"
    found = re.fullmatch(r"([0-9]+)([smhd])", text, re.IGNORECASE)
    if found and int(found[1]) > 0 and found[2].lower() != "d":
        return f"{int(found[1])}{found[2].lower()}"
    raise TimeframeUnsupported(name)


def milliseconds(name: str) -> int:
    """Length of a timeframe; a month has none."""
    known = canonical(name)
    if known == "1M":
        raise TimeframeUnsupported("1M has no fixed length")
    return WEEK if known == "1W" else DAY if known == "1D" else int(known[:-1]) * _UNITS[known[-1]]


@dataclass(frozen=True)
class Timeframe:
    canonical: str
    multiplier: int
    unit: str
    duration_ms: int | None
    raw: str = field(default="", compare=False)

    @classmethod
    def parse(cls, name: str) -> Timeframe:
        """As ``canonical``, without seconds."""
        known = canonical(name)
        if known.endswith("s"):
            raise TimeframeUnsupported(name)
        return cls(known, int(known[:-1]), _UNIT_NAMES[known[-1]], None if known == "1M" else milliseconds(known), name)


def as_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def bucket(ms: Column, name: str, anchor: str = "monday") -> Column:
    """Start of the bucket that holds a time. Weeks start on Monday, or with ``anchor='epoch'`` on Thursday; months on the 1st."""
    known = canonical(name)
    if known == "1M":
        return F.unix_millis(F.date_trunc("month", as_timestamp(ms)))
    length = milliseconds(known)
    shift = FIRST_MONDAY if known == "1W" and anchor == "monday" else 0
    # The remainder rather than a quotient: exact for any long, also before 1970.
    return ms - F.pmod(ms - F.lit(shift), F.lit(length))


def close_time(ms: Column, name: str) -> Column:
    """Last millisecond of the candle that opens at ``ms``; of a day, week or month: that of the calendar unit around it."""
    known = canonical(name)
    if known == "1M":
        return F.unix_millis(F.to_timestamp(F.date_add(F.last_day(as_timestamp(ms)), 1))) - 1
    return (bucket(ms, known) if known in ("1D", "1W") else ms) + milliseconds(known) - 1


def next_open(ms: Column, name: str) -> Column:
    return close_time(ms, name) + 1


def canonical_column(name: Column) -> Column:
    """``canonical`` for a column; null where a name isn't a timeframe."""
    text = F.trim(name)
    number = F.regexp_extract(text, r"^0*([0-9]+)", 1)
    good = F.regexp_extract(text, r"^0*([1-9][0-9]*)", 1) != ""
    return (
        F.when(text.isin("M", "1M"), "1M")
        .when(F.upper(text).isin("D", "1D"), "1D")
        .when(F.upper(text).isin("W", "1W"), "1W")
        .when(text.rlike("^[0-9]+$") & good, F.concat(number, F.lit("m")))
        .when(text.rlike("^[0-9]+[smhSMH]$") & good, F.concat(number, F.lower(F.right(text, F.lit(1)))))
    )


def milliseconds_column(name: Column) -> Column:
    known = canonical_column(name)
    unit = F.right(known, F.lit(1))
    each = F.when(unit == "s", SECOND).when(unit == "m", MINUTE).when(unit == "h", HOUR).when(unit == "D", DAY).when(unit == "W", WEEK)
    return F.when(known != "1M", F.regexp_extract(known, "^([0-9]+)", 1).cast("long") * each)


def close_time_column(ms: Column, name: Column) -> Column:
    """``close_time`` where each row has a timeframe of its own; null where its name isn't one."""
    known = canonical_column(name)
    calendar = [(x, close_time(ms, x)) for x in ("1D", "1W", "1M")]
    found = F.when(known == calendar[0][0], calendar[0][1]).when(known == calendar[1][0], calendar[1][1]).when(known == calendar[2][0], calendar[2][1])
    return found.otherwise(ms + milliseconds_column(name) - 1)


def epoch_ms(value: Column) -> Column:
    """Seconds up to 1e12, milliseconds above."""
    return F.when(F.abs(value) <= 1_000_000_000_000, value * 1000).otherwise(value)


def parse_time_ms(text: Column) -> Column:
    """Whole numbers as ``epoch_ms``; ISO-8601 with Z, an offset, or none (UTC)."""
    whole = text.rlike(r"^\s*-?[0-9]{1,18}\s*$")
    return F.when(whole, epoch_ms(F.trim(text).try_cast("long"))).otherwise(F.unix_millis(F.try_to_timestamp(text)))


def micros_to_ms(value: Column) -> Column:
    """Microseconds (1e14 and above) as milliseconds."""
    return F.when(value >= 100_000_000_000_000, F.floor(value / 1000)).otherwise(value)


def default_intrabar(name: str) -> str:
    known = canonical(name)
    if known in ("1D", "1W", "1M"):
        return "60m"
    return "1m" if milliseconds(known) <= HOUR else "5m"


def interval_name(name: str, exchange: str) -> str:
    """The name of a timeframe in an exchange's requests (binance: 1h, 1d, 1w, 1M; bybit: minutes, D, W, M)."""
    known = canonical(name)
    supported = {"1m", "3m", "5m", "15m", "30m", "60m", "1h", "120m", "2h", "240m", "4h", "360m", "6h", "720m", "12h", "1D", "1W", "1M"}
    if known not in supported | ({"1s"} if exchange == "binance" else set()):
        raise TimeframeUnsupported(f"{exchange}: {name}")
    if known[-1] in "DWM":
        return (known if known == "1M" else known.lower()) if exchange == "binance" else known[-1]
    if exchange == "binance":
        minutes = milliseconds(known) // MINUTE
        return known if known == "1s" else f"{minutes // 60}h" if minutes >= 60 else f"{minutes}m"
    return str(milliseconds(known) // MINUTE)


#: How public candle requests name minutes, hours and a day, and the lengths (minutes) each exchange offers.
PUBLIC_NAMES = {
    "okx": ("{n}m", "{n}H", "1D", (1, 3, 5, 15, 30, 60, 240, 1440)),
    "kucoin": ("{n}min", "{n}hour", "1day", (1, 3, 5, 15, 30, 60, 240, 1440)),
    "bitget": ("{n}min", "{n}h", "1day", (1, 3, 5, 15, 30, 60, 240, 1440)),
    "bitget-mix": ("{n}m", "{n}H", "1D", (1, 3, 5, 15, 30, 60, 240, 1440)),
    "kraken-futures": ("{n}m", "{n}h", "1d", (1, 5, 15, 30, 60, 240, 1440)),
    "gateio": ("{n}m", "{n}h", "1d", (1, 5, 15, 30, 60, 240, 1440)),
    "htx": ("{n}min", "{n}hour", "1day", (1, 5, 15, 30, 60, 240, 1440)),
    "mexc": ("{n}m", "{n}h", "1d", (1, 5, 15, 30, 60, 240, 1440)),
    "mexc-contract": ("Min{n}", "Hour{n}", "Day1", (1, 5, 15, 30, 60, 240, 1440)),
    "coinbase": ("{s}", "{s}", "86400", (1, 5, 15, 60, 360, 1440)),
}


def public_interval(name: str, exchange: str) -> str:
    """The name of a timeframe in a public request; an hour is 60 minutes where hours start at four."""
    minute, hour, day, offered = PUBLIC_NAMES[exchange]
    known = canonical(name)
    minutes = milliseconds(known) // MINUTE if known != "1M" else 0
    if minutes not in offered or milliseconds(known) % MINUTE:
        raise TimeframeUnsupported(f"{exchange}: {name}")
    if minutes == 1440:
        return day
    in_minutes = minutes < 60 or (minutes == 60 and exchange in ("htx", "mexc-contract"))
    return (minute if in_minutes else hour).format(n=minutes if in_minutes else minutes // 60, s=minutes * 60)


def requested_limit(name: str, start_ms: int, end_ms: int, most: int) -> int:
    """Bars that a range holds, at least one and at most a page."""
    return min(most, max(1, -(-(end_ms - start_ms) // milliseconds(name))))


def pages(name: str, start_ms: int, end_ms: int, most: int) -> list[tuple[int, int]]:
    """A range cut into requests of at most ``most`` bars."""
    step = milliseconds(name) * most
    return [(at, min(at + step, end_ms)) for at in range(start_ms, end_ms, step)]


def is_calendar(name: Column) -> Column:
    """Whether a timeframe follows the calendar: days, weeks or months."""
    return canonical_column(name).isin("1D", "1W", "1M")


def iso_text(time_ms: Column) -> Column:
    """A time as ISO-8601 text in UTC, with milliseconds where there are any."""
    at = F.timestamp_millis(time_ms)
    return F.when(time_ms % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
