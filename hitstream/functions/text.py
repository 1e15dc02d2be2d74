"""Strings, dates, JSON and maps as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"^health_(\d{8}_\d{6})(?:_(\d{8}))?\.jsonl(?:\.gz)?$"


def to_long(value: Column, default: int | None = None) -> Column:
    """Tolerant integer: whole numbers only ('3.5' is none), null or ``default`` otherwise."""
    out = F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("long"))
    return out if default is None else F.coalesce(out, F.lit(default).cast("long"))


def to_double(value: Column, default: float | None = None) -> Column:
    out = F.trim(value).try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(default))


def iso_ms(value: Column) -> Column:
    """Milliseconds of an ISO-8601 time (Z or offset); null on error. A time without zone is UTC."""
    zoned = F.when(value.rlike(r"(Z|[+-]\d\d:?\d\d)$"), value).otherwise(F.concat(value, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def log_ms(day: Column, fraction: Column, zone: str = "UTC") -> Column:
    """Milliseconds of a log time ``yyyy/MM/dd HH:mm:ss`` with a fraction padded or cut to three digits, in a stated zone."""
    base = F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(day, F.lit("yyyy/MM/dd HH:mm:ss")), zone))
    # a text without zone is read in the session's zone; the difference of the two readings is undone by epoch arithmetic
    wall = F.try_to_timestamp(F.concat(F.regexp_replace(day, "/", "-"), F.lit("Z")))
    utc = F.unix_millis(F.to_utc_timestamp(wall, zone)) if zone != "UTC" else F.unix_millis(wall)
    return F.when(base.isNotNull(), utc + F.rpad(F.substring(F.coalesce(fraction, F.lit("0")), 1, 3), 3, "0").cast("long"))


def local_text(ms: Column, offset_hours: int = 8, pattern: str = "yyyy/MM/dd HH:mm:ss") -> Column:
    """Local wall time at a fixed offset; '-' for times that are not positive."""
    shifted = F.timestamp_millis(ms + F.lit(offset_hours * 3_600_000))
    return F.when(ms > 0, F.date_format(F.to_utc_timestamp(shifted, F.lit("UTC")), pattern)).otherwise(F.lit("-"))


def bucket_ms(ms: Column, seconds: int) -> Column:
    return F.floor(ms / (seconds * 1000)) * (seconds * 1000)


def run_id(name: Column) -> Column:
    """Run of a health file name; null for other names."""
    return F.nullif(F.regexp_extract(name, STAMP, 1), F.lit(""))


def run_day(name: Column) -> Column:
    """Day of a health file name; by default the run's."""
    return F.coalesce(F.nullif(F.regexp_extract(name, STAMP, 2), F.lit("")), F.substring(run_id(name), 1, 8))


def sanitise_key(label: Column) -> Column:
    """Band label as a key: spaces to underscores, comparison signs spelt out."""
    out = label
    for sign, word in ((" ", "_"), ("≥", "ge"), ("<", "lt"), (">", "gt")):
        out = F.replace(out, F.lit(sign), F.lit(word))
    return out


def strip_stamp(stem: Column) -> Column:
    return F.regexp_replace(stem, r"_\d{8}_\d{6}$", "")


def tag_offsets(payload: Column, tag: str) -> Column:
    """Byte offsets of a two-byte tag (hex) in a payload."""
    n = F.octet_length(payload)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1))
    return F.filter(F.transform(at, lambda i: F.when(F.hex(F.substring(payload, i, F.lit(2))) == tag.upper(), i - 1)), lambda x: x.isNotNull())


def int_keys(counts: Column) -> Column:
    """Map with integer keys from one with string keys; keys that are no integers are left out."""
    pairs = F.transform(F.map_entries(counts), lambda e: F.struct(to_long(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["key"].isNotNull()))


def detail_score(missing: Column, expected: Column, attached: Column) -> Column:
    """10 for a list of missing DUs, 5 each for known expected and attached counts."""
    return F.when(F.size(missing) > 0, 10).otherwise(0) + F.when(expected > 0, 5).otherwise(0) + F.when(attached > 0, 5).otherwise(0)


def split_fields(line: Column) -> Column:
    """Fields between white space or commas."""
    return F.split(F.trim(F.regexp_replace(line, r"[\s,]+", " ")), " ")


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def midpoint(a: Column, b: Column) -> Column:
    return a + F.floor((b - a) / 2)


def fixed(value: Column, digits: int = 9) -> Column:
    return F.format_string(f"%.{digits}f", value)


LOCAL_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def local_ms(value: Column, offset_hours: int = 8, formats: tuple[str, ...] = LOCAL_FORMATS) -> Column:
    """Milliseconds of a local wall time at a fixed offset, in the first format that fits; null if none does."""
    zoned = [F.try_to_timestamp(F.concat(value, F.lit("Z")), F.lit(f + "XXX")) for f in formats]
    return F.unix_millis(F.coalesce(*zoned)) - F.lit(offset_hours * 3_600_000)


def labelled(value: Column, labels: dict, default: Column | None = None) -> Column:
    """The label of a value; ``default`` (else its text) for others."""
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(value == F.lit(k), F.lit(v)).otherwise(out)
    return F.coalesce(out, value.cast("string") if default is None else default)


def padded(number: Column, digits: int, prefix: str = "") -> Column:
    """``prefix`` and the number with leading zeros; longer numbers are not cut."""
    return F.format_string(f"{prefix}%0{digits}d", number.cast("long"))


def big_endian(data: Column, at: Column | int, size: int) -> Column:
    """Unsigned integer of ``size`` bytes at byte offset ``at`` (from 0), most significant first; of eight bytes as the long with the same bits."""
    start = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    digits = F.hex(F.substring(data, start, F.lit(size)))
    if size < 8:
        return F.conv(digits, 16, 10).cast("long")
    half = lambda i: F.conv(F.substring(digits, i, 8), 16, 10).cast("long")
    return F.when(F.length(digits) == 16, F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def big_endian_bytes(value: Column, size: int) -> Column:
    """The last ``size`` bytes of a long, most significant first."""
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))
