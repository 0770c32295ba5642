"""Names, numbers and colours as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def finite_number(text: Column) -> Column:
    """A finite double, or null."""
    v = text.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def number_list(text: Column) -> Column:
    """A semicolon list as doubles; blanks are passed over, what is no number is null."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: p.try_cast("double"))


def track_set_of(track_id: Column) -> Column:
    """What stands before the first colon, where something does."""
    at = F.instr(track_id, ":")
    return F.when(at > 1, F.substring(track_id, F.lit(1), at - 1))


def region_name(z: Column, y: Column, x: Column, dims: tuple[int, int, int]) -> Column:
    """One-based Z-Y-X of a centre, padded to the widest axis."""
    at = [F.greatest(F.lit(0), F.least(F.lit(d - 1), F.floor(c + F.lit(0.5)))) + 1 for c, d in zip((z, y, x), dims, strict=True)]
    return F.concat_ws("-", *(F.lpad(a.cast("string"), len(str(max(dims))), "0") for a in at))


def hex_color(text: Column, fallback: str = "#ffffff") -> Column:
    """rgb and rrggbb, with or without #, in lower case as #rrggbb; anything else is the fallback."""
    t = F.regexp_replace(F.lower(F.trim(text)), "^#", "")
    short = F.concat(F.lit("#"), *(F.repeat(F.substring(t, i, 1), 2) for i in (1, 2, 3)))
    return F.when(t.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), t)).when(t.rlike("^[0-9a-f]{3}$"), short).otherwise(fallback)


def file_base(text: Column, fallback: str = "channel-export") -> Column:
    """A name for an export: known extensions go, runs of reserved characters become a dash, white space an underscore."""
    t = F.regexp_replace(F.trim(text), r"(?i)(\.tiff?|\.zip)$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\\/:*?\"<>|]+", "-"), r"\s+", "_")
    return F.when(t != "", t).otherwise(fallback)


def natural_key(name: Column) -> Column:
    """Sorts like people do: case aside, runs of digits by their number, which its count of digits leads (up to 9,999)."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 4, "0"), digits(p))).otherwise(p)), "")


def zero_based(timepoint: Column) -> Column:
    """One-based timepoints less one; below one is an error."""
    return F.when(timepoint >= 1, timepoint - 1).otherwise(F.raise_error(F.lit("timepoints begin at 1")).cast("double"))


def intensity_text(value: Column, is_integer: bool, zero: str = "0.000") -> Column:
    """Whole for integer types; else one decimal from a thousand on, three from one on, four significant digits below; zero has none."""
    size = F.abs(value)
    digits = F.greatest(F.lit(0), 3 - F.floor(F.log10(F.when(size > 0, size)))).cast("int")
    small = F.lit(None).cast("string")
    for d in range(0, 12):
        small = F.when(digits == d, F.format_string(f"%.{d}f", value)).otherwise(small)
    text = F.when(size >= 1000, F.format_string("%.1f", value)).when(size >= 1, F.format_string("%.3f", value)).when(size > 0, small).otherwise(zero)
    if is_integer:
        text = F.floor(value + 0.5).cast("string")
    return F.when(F.isnan(value) | (size == float("inf")) | value.isNull(), "N/A").otherwise(text)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters, zero replaced; in longs, since there are no unsigned ints."""
    mask = 0xFFFFFFFF
    h = F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), lambda a, c: F.when(c == "", a).otherwise(((a.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(mask))))
    return F.when(h == 0, F.lit(0xDEADBEEF)).otherwise(h)
