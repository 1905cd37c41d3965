"""Text, number, time and label normalisation as Column expressions."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Accepted spellings of the two actions.
ALLOW_WORDS = ("ALLOW", "ALLOWED", "ACCEPT", "ACCEPTED", "PERMIT", "PASS")
BLOCK_WORDS = ("BLOCK", "BLOCKED", "DENY", "DENIED", "DROP", "DROPPED", "REJECT", "REJECTED")

# Labels that mark normal traffic.
NORMAL_LABELS = ("normal", "benign", "legitimate", "0", "false")

# Service names of well-known destination ports.
SERVICES = {
    20: "FTP", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3",
    123: "NTP", 143: "IMAP", 443: "HTTPS", 445: "SMB", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL",
    8080: "HTTP alternative",
}

# CSV cells that mean "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Shapes of a time of day after a date, taken apart by groups: hour, minute, second, fraction, half of the day, zone.
_CLOCK = (
    r"(?:(?:[T ,]+|:)(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,9}))?)?\s*([aApP][mM])?"
    r"\s*(Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?)?$"
)
_DAY_NAME = r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+)?"
# two digits that a colon follows are an hour
_YEAR = r"(\d{4}|\d{2}(?![:\d]))"
_MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Shapes of a date and the places of year, month and day among its three groups. Month first where both could be meant,
# unless that is no date.
_DATES = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3)),
    (r"^(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    (r"^(3[2-9]|[4-9]\d)[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3)),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.]" + _YEAR, (3, 1, 2)),
    (r"^(\d{4})[- /]([A-Za-z]{3,9})[- /](\d{1,2})", (1, 2, 3)),
    (_DAY_NAME + r"(\d{1,2})(?:st|nd|rd|th)?[- /]([A-Za-z]{3,9})[,.]?[- /]" + _YEAR, (3, 2, 1)),
    (_DAY_NAME + r"([A-Za-z]{3,9})\.?(?:\s+|[-/])(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+|[-/])" + _YEAR, (3, 1, 2)),
)
# A time of day that stands first, or between day and year as ctime writes it, goes to the end.
_PLAIN_CLOCK = r"\d{1,2}:\d{1,2}(?::\d{1,2}(?:[.,]\d{1,9})?)?(?:\s*[aApP][mM])?(?:\s*(?:Z|z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
_MOVED = (
    (rf"^({_PLAIN_CLOCK})[ ,]+(\S.*)$", "$2 $1"),
    (_DAY_NAME + rf"([A-Za-z]{{3,9}}\.?\s+\d{{1,2}}),?\s+({_PLAIN_CLOCK})\s+(\d{{4}})$", "$1 $3 $2"),
)
# The usual form, which needs no rewriting.
_USUAL = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}[T ]\d{1,2}:\d{1,2}(?::\d{1,2}(?:[.,]\d{1,9})?)?\s*(?:Z|[+-]\d{2}:?\d{2})?$"
# The form that Spark casts to the same timestamp.
_CAST = r"^[1-9]\d{3}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?\z"
# Forms that lack something, rewritten in this order: "at" before the time, zone names (which are read past), hours without
# minutes, dates without a day or month.
_COMPLETED = (
    (r"(?:^|\s+)at\s+(?=\d)", " "),
    (r"^ ", ""),
    (r"(:\d{2}(?:[.,]\d+)?|[aApP][mM])\s+(?!UTC|GMT)[A-Z]{3,5}$", "$1"),
    (r"(?<![:\d.,])(\d{1,2})\s*([aApP][mM])\b", "$1:00 $2"),
    (r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}[T ]\d{2}|\d{8}T\d{2})$", "$1:00"),
    (r"^(\d{4})[-/.](\d{1,2})$", "$1-$2-1"),
    (r"^(\d{1,2})[-/](\d{4})$", "$2-$1-1"),
    (r"^([A-Za-z]{3,9})\.?[ ,-]+(\d{4})$", "$2 $1 1"),
    (r"^(\d{4})[ -]([A-Za-z]{3,9})$", "$1 $2 1"),
)
#: Microseconds in one unit of a numeric epoch time.
EPOCH_UNITS = {"s": 1_000_000.0, "ms": 1000.0, "us": 1.0, "ns": 0.001}

# what trimming removes: ASCII and Unicode white space
WHITESPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col_or(df: DataFrame, name: str, default, kind: str) -> Column:
    """The column when the frame has it, else a typed neutral value."""
    return F.col(name) if name in df.columns else F.lit(default).cast(kind)


def strip(c: Column) -> Column:
    # most texts begin and end with printable ASCII, which is cheaper to see than to trim by a set
    bare = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(bare, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def normal_action(c: Column) -> Column:
    word = F.upper(strip(c))
    return F.when(word.isin(*ALLOW_WORDS), "ALLOW").when(word.isin(*BLOCK_WORDS), "BLOCK").otherwise(word)


def whole_part(text: Column) -> Column:
    """Stripped text of a whole number to long; anything else becomes NULL."""
    return text.try_cast("bigint")


def real_part(text: Column) -> Column:
    """Stripped text of a plain decimal number to double; anything else becomes NULL."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _shape(text: Column, date: str, places: tuple[int, int, int]) -> Column:
    """Fields of a text of one shape as an array of text, taken apart by one replacement; NULL where it has another."""
    fields = "\x01".join(f"${i}" for i in (*places, 4, 5, 6, 7, 8, 9))
    return F.when(text.rlike(date + _CLOCK), F.split(F.regexp_replace(text, date + _CLOCK, fields), "\x01"))


def _rewritten(text: Column) -> Column:
    """Times of day, compact and incomplete forms brought to the shapes that are taken apart."""
    # yyyyMMddHHmmss and yyyyMMddTHHmm[ss] get separators first
    spread = F.regexp_replace(text, r"^(\d{8})[T ]?(\d{2})(\d{2})(\d{2})?(?=$|[.,Z+-])", "$1T$2:$3:$4")
    spread = F.regexp_replace(spread, r":(?=$|[.,Z+-])", "")
    for form, order in (*_COMPLETED, *_MOVED):
        spread = F.regexp_replace(spread, form, order)
    return F.when(text.rlike(_USUAL), text).otherwise(spread)


def timestamp_of(text: Column, epoch_unit: str | None = None) -> Column:
    """Mixed-format text to a naive UTC timestamp; unparseable values become NULL.

    The first shape that fits gives the fields, which make one timestamp; a text of no shape is never parsed. Compact
    dates may run into their time of day. Years of two digits lie within fifty years of today's. Offsets become UTC, names
    of zones other than UTC and GMT are read past. A missing day is the first, missing minutes are none. Plain numbers are
    epoch times if a unit is given.
    """
    unit = EPOCH_UNITS[epoch_unit] if epoch_unit else None

    def once(c: Column, use: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(c), use), 1)

    def made(p: Column, spread: Column) -> Column:
        whole = lambda c: F.when(c != "", c).otherwise("0").cast("int")
        word = F.lower(F.substring(p[1], 1, 3))
        named = F.array_position(F.array(*[F.lit(m) for m in _MONTH_NAMES]), word).cast("int")
        read = F.array(p[0].try_cast("int"), F.when(p[1].rlike("^[0-9]+$"), p[1].try_cast("int")).otherwise(named), p[2].try_cast("int"))

        def dated(d: Column) -> Column:
            # a first number over twelve can only be the day
            swap = (d[1] > 12) & (d[2] <= 12) & spread.rlike(r"^([0-2]?\d|3[01])[-/.]")
            return F.when(swap, F.array(d[0], d[2], d[1])).otherwise(d)

        def midnight(d: Column) -> Column:
            now = F.year(F.current_date())
            near = once(d[0] + now - now % 100, lambda y: y + F.when(y >= now + 50, -100).when(y < now - 50, 100).otherwise(0))
            year = F.when(F.length(p[0]) == 2, near).otherwise(d[0])
            return F.try_make_timestamp(year, d[1], d[2], F.lit(0), F.lit(0), F.lit(0)).cast("timestamp_ntz")

        def timed(date: Column, c: Column) -> Column:
            half = F.lower(p[7])
            good_hour = F.when(half == "", c[0] < 24).otherwise(c[0].between(1, 12))
            hour = F.when(half == "", c[0]).otherwise(c[0] % 12 + F.when(half == "pm", 12).otherwise(0))
            zone = F.regexp_replace(F.upper(p[8]), ":", "")
            offset = (F.substring(zone, 2, 2).cast("int") * 60 + whole(F.substring(zone, 4, 2))) * F.when(zone.startswith("-"), -1).otherwise(1)
            offset = F.when(F.upper(p[8]).isin("", "Z", "UTC", "GMT"), 0).otherwise(offset)
            seconds = (hour * 60 + c[1] - offset) * 60 + c[2]
            valid = date.isNotNull() & good_hour & (c[1] < 60) & (c[2] < 60)
            return F.when(valid, F.timestamp_micros(micros(date) + seconds.cast("bigint") * 1_000_000 + c[3]).cast("timestamp_ntz"))

        # the fraction is cut to microseconds
        clock = F.array(*map(whole, (p[3], p[4], p[5], F.rpad(F.substring(p[6], 1, 6), 6, "0"))))
        return once(once(once(read, dated), midnight), lambda date: once(clock, lambda c: timed(date, c)))

    def fields(spread: Column) -> Column:
        parts = F.coalesce(*[_shape(spread, date, places) for date, places in _DATES])
        return once(parts, lambda p: F.when(p.isNotNull(), made(p, spread)))

    # the text is rewritten once and the fields are taken from it once
    parsed = F.when(text.rlike(_CAST), text.try_cast("timestamp_ntz")).otherwise(once(_rewritten(text), fields))
    if unit is None:
        return parsed
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.coalesce(F.timestamp_micros(F.round(number * unit).try_cast("bigint")).cast("timestamp_ntz"), parsed)


def non_negative(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when whole is 0."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def micros(c: Column) -> Column:
    """Epoch microseconds of a naive UTC timestamp."""
    return F.unix_micros(c.cast("timestamp"))


def slot(us: Column, width_us: int) -> Column:
    """Index of the epoch-aligned interval of the given width that holds ``us``."""
    width = F.lit(width_us).cast("bigint")
    return F.call_function("div", us - F.pmod(us, width), width)


def bucket_start(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned tumbling window that holds ``ts``."""
    return F.window(ts, f"{minutes} minutes")["start"]


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def service_name(port: Column) -> Column:
    return F.coalesce(literal_map(SERVICES)[port.cast("int")], F.lit("Unknown"))


def hour_in(ts: Column, start: int, end: int) -> Column:
    """Hour of day in [start, end), wrapping around midnight unless start < end."""
    hour = F.hour(ts)
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def outside_working_hours(ts: Column, start: int, end: int) -> Column:
    hour = F.hour(ts)
    return ~hour.between(start, end - 1) if start < end else hour.between(end, start - 1)


def joined(values: Column, separator: str = ", ") -> Column:
    """Distinct values in text order, without empty and "nan" items, as one string."""
    text = F.filter(F.transform(values, lambda v: v.cast("string")), lambda v: (v != "") & (v != "nan"))
    return F.array_join(F.array_sort(F.array_distinct(text)), separator)


def split_items(text: Column, separator: str = ",") -> Column:
    """Items of a joined cell, trimmed, without empty ones; ``separator`` is taken literally."""
    parts = F.transform(F.split(text, "\\Q" + separator + "\\E"), strip)
    return F.filter(parts, lambda v: v != "")


def timestamp_text(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``, with six fraction digits only when there is a fraction."""
    whole = F.date_trunc("second", ts).cast("timestamp_ntz") == ts
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def fixed1(c: Column) -> Column:
    """One decimal, rounded half-even on the exact binary value."""
    return F.regexp_replace(F.call_function("format_number", c.cast("double"), F.lit("0.0")), ",", "")


def general(c: Column) -> Column:
    """Six significant digits without trailing zeros, exponent form below 1e-4 and from 1e6."""
    x = c.cast("double")
    exact = F.when((x == F.floor(x)) & (F.abs(x) < 1e18), x.cast("decimal(38,0)"))
    # decimals are rounded half-even on their digits, which for whole numbers are the exact value
    pattern = F.lit("0.#####E0")
    sci = F.coalesce(F.call_function("format_number", exact, pattern), F.call_function("format_number", x, pattern))
    mantissa, exponent = F.split_part(sci, F.lit("E"), F.lit(1)), F.split_part(sci, F.lit("E"), F.lit(2)).cast("int")
    plain = F.call_function("format_number", sci.cast("decimal(30,10)"), F.lit("0.##########"))
    shown = F.concat(
        mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0")
    )
    return F.when(exponent.between(-4, 5), plain).otherwise(shown)
