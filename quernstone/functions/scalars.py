"""Scalar functions as column expressions: time, packed versions, enumerations, tag sets, coercion, hashes, bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date patterns by resolution, year to second.
TIME_PATTERNS = {"y": "yyyy", "m": "yyyy-MM", "d": "yyyy-MM-dd", "H": "yyyy-MM-dd HH", "M": "yyyy-MM-dd HH:mm", "S": "yyyy-MM-dd HH:mm:ss"}
# What each resolution truncates to.
TIME_UNITS = {"y": "year", "m": "month", "d": "day", "H": "hour", "M": "minute", "S": "second"}
# The bits of a packed version, platform:8 v1:8 v2:16 v3:16 v4:16.
VERSION_FIELDS = {"platform": (56, 0xFF), "v1": (48, 0xFF), "v2": (32, 0xFFFF), "v3": (16, 0xFFFF), "v4": (0, 0xFFFF)}
# Tags, and bytes of a tag set, that the original's buffer holds.
MAX_TAGS, MAX_TAG_BYTES = 100, 4096


def time_format(ts: Column, resolution: str = "S", offset_seconds: int = 0) -> Column:
    """ts (a timestamp without zone) as text, moved by a fixed offset that never follows daylight saving."""
    shifted = ts + F.make_dt_interval(secs=F.lit(offset_seconds)) if offset_seconds else ts
    return F.date_format(shifted, TIME_PATTERNS[resolution])


def epoch_format(seconds: Column, resolution: str = "S", offset_seconds: int = 0) -> Column:
    """Epoch seconds (64 bits) as text at a fixed offset from UTC, whatever the session's zone."""
    wall = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds + offset_seconds)
    return F.date_format(wall, TIME_PATTERNS[resolution])


def truncate_time(ts: Column, resolution: str) -> Column:
    return F.date_trunc(TIME_UNITS[resolution], ts)


def version_field(packed: Column, name: str) -> Column:
    shift, mask = VERSION_FIELDS[name]
    return F.shiftrightunsigned(packed, shift).bitwiseAND(mask)


def version_format(packed: Column, platforms: dict[int, str], resolution: int = 4) -> Column:
    """platform[/v1[.v2[.v3[.v4]]]], as many numbers as resolution (0 to 4) says. A platform without a name shows its code."""
    platform = enum_decode(version_field(packed, "platform"), platforms)
    if not resolution:
        return platform
    numbers = F.concat_ws(".", *(version_field(packed, f"v{i}").cast("string") for i in range(1, resolution + 1)))
    return F.concat(platform, F.lit("/"), numbers)


def decimal_version(packed: Column) -> Column:
    """v1 v2 v3 v4 as the digits of one number, five for each of the last three."""
    v1, v2, v3, v4 = (version_field(packed, f"v{i}") for i in range(1, 5))
    return v1 * 10**15 + v2 * 10**10 + v3 * 10**5 + v4


def enum_decode(code: Column, names: dict[int, str] | list[str]) -> Column:
    """The name of a code; a code without one as text."""
    pairs = list(enumerate(names)) if isinstance(names, list) else list(names.items())
    if not pairs:
        return code.cast("string")
    table = F.create_map(*(F.lit(x) for k, v in pairs for x in (int(k), v)))
    return F.coalesce(F.try_element_at(table, code.cast("int")), code.cast("string"))


def tags(tagset: Column, separators: str = ",;", strict_compat: bool = False) -> Column:
    """The tags of a set as an array: split at any separator, empty ones left out. strict_compat: MAX_TAGS of the first MAX_TAG_BYTES bytes at most."""
    escaped = "".join("\\" + c for c in separators)
    text = F.substring(tagset.cast("binary"), 1, MAX_TAG_BYTES).cast("string") if strict_compat else tagset
    found = F.filter(F.split(text, f"[{escaped}]"), lambda t: t != "")
    return F.slice(found, 1, MAX_TAGS) if strict_compat else found


def coerce(value: Column, kind: str) -> Column:
    """A value of any numeric column as a field of this kind: unknown (always null), bool, int (toward zero), float, string. Null stays null."""
    if kind == "unknown":
        return F.lit(None).cast("string")
    if kind == "bool":
        return value != 0
    if kind in ("int", "ts", "version"):
        return value.cast("long")
    return value.cast("double" if kind == "float" else "string")


def stable_hash(*columns: Column, salt: int = 0) -> Column:
    """A 64-bit hash of columns for strata and buckets; another salt gives another hash."""
    return F.xxhash64(*columns, F.lit(salt).cast("long"))


def stratum(n: int, *columns: Column, salt: int = 0) -> Column:
    return F.pmod(stable_hash(*columns, salt=salt), F.lit(n).cast("long"))


def set_bit(bits: Column, i: int) -> Column:
    return bits.bitwiseOR(F.shiftleft(F.lit(1).cast("long"), i))


def clear_bit(bits: Column, i: int) -> Column:
    return bits.bitwiseAND(F.bitwise_not(F.shiftleft(F.lit(1).cast("long"), i)))


def test_bit(bits: Column, i: int) -> Column:
    return F.bit_get(bits, F.lit(i)) == 1


test_bit.__test__ = False  # not a test for pytest


def assign_bit(bits: Column, i: int, on: Column) -> Column:
    return F.when(on, set_bit(bits, i)).otherwise(clear_bit(bits, i))


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
