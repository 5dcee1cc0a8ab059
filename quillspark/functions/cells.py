"""Column functions that type cells and handle numbers, dates and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]+)?(?:[eE][+-]?[0-9]{1,3})?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?$"
EPOCH = "1899-12-30"


def is_number(text: Column) -> Column:
    """A sign, at most 15 digits in the mantissa, no needless leading zero, a fraction, an exponent."""
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "[eE].*$", ""), "[^0-9]", ""))
    return text.rlike(NUMBER) & (digits <= 15)


def serial(at: Column) -> Column:
    """Days since 1899-12-30, the time of day as a fraction."""
    seconds = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.datediff(F.to_date(at), F.lit(EPOCH).cast("date")) + seconds / 86400.0


def parse_date(text: Column) -> Column:
    """An ISO date or date and time as a timestamp, null unless the whole text is one that exists."""
    padded = F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).when(F.length(text) == 16, F.concat(text, F.lit(":00"))).otherwise(text)
    return F.when(text.rlike(DATE), F.try_to_timestamp(F.replace(padded, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")))


def infer_kind(text: Column) -> Column:
    """empty, bool, date, number or text: what a CSV cell is taken for."""
    t = F.trim(text)
    return F.when(t == "", "empty").when(F.lower(t).isin("true", "false"), "bool").when(parse_date(t).isNotNull(), "date").when(is_number(t), "number").otherwise("text")


def infer_number(text: Column) -> Column:
    """The number that a cell holds: a date's serial day, or the number itself."""
    t = F.trim(text)
    at = parse_date(t)
    return F.when(at.isNotNull(), serial(at)).when(is_number(t), F.expr("try_cast(1 as double)") * t.try_cast("double"))


def format_number(n: Column) -> Column:
    """Whole numbers plainly; others with at most six decimals, cut off, and no trailing zeros."""
    cut = F.signum(n) * F.floor(F.abs(n) * 1_000_000) / 1_000_000
    text = F.regexp_replace(F.regexp_replace(cut.cast("decimal(30,6)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("bigint").cast("string")).otherwise(text)


def nice_step(span: Column, ticks: int) -> Column:
    """1, 2, 5 or 10 times a power of ten: the least that is not under span / ticks."""
    raw = span / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / power
    return F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10) * power


# The bit of each permission, counted from 0.
PERMISSION_BITS = {"print": 2, "modify": 3, "copy": 4, "annotate": 5, "fill_forms": 8, "extract": 9, "assemble": 10, "print_high": 11}


def permission_mask(allowed: dict[str, Column]) -> Column:
    """The signed 32-bit mask; reserved high bits are set."""
    out = F.lit(0xFFFFF000 - (1 << 32) | 0xC0)
    for name, bit in PERMISSION_BITS.items():
        out = out.bitwiseOR(F.when(allowed[name], 1 << bit).otherwise(0))
    return out


def has_permission(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(1 << PERMISSION_BITS[name])) != 0


def rk_number(rk: Column) -> Column:
    """The double of a 32-bit RK value: bit 1 says that the upper 30 bits are a signed number (else the upper bits of a double), bit 0 that it counts hundredths."""
    whole = F.shiftright(rk.cast("int"), 2).cast("double")
    bits = F.shiftleft((rk.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFC))), 32)
    sign = F.when(bits < 0, -1.0).otherwise(1.0)
    power = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047))
    part = bits.bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    double = F.when(power == 0, sign * part * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise(sign * (1 + part) * F.pow(F.lit(2.0), power - 1023))
    value = F.when(rk.bitwiseAND(F.lit(2)) != 0, whole).otherwise(double)
    return F.when(rk.bitwiseAND(F.lit(1)) != 0, value / 100).otherwise(value)


def serial_date(serial_: Column) -> Column:
    """The day of a serial number."""
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(serial_).cast("int"))
