"""Scales, units and detail levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres and seconds of each unit.
LENGTHS = {"Å": 1e-10, "nm": 1e-9, "μm": 1e-6, "mm": 1e-3}
TIMES = {"ns": 1e-9, "μs": 1e-6, "ms": 1e-3, "s": 1.0}


def nice_step(span: Column, ticks: int) -> Column:
    """The least of 1, 2, 5 and 10 times a power of ten that makes at most about ``ticks`` steps."""
    raw = span / float(max(1, ticks))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    ratio = raw / power
    return F.when(span <= 0, 0.0).otherwise(F.when(ratio <= 1, 1.0).when(ratio <= 2, 2.0).when(ratio <= 5, 5.0).otherwise(10.0) * power)


def nice_bounds(low: Column, high: Column, ticks: int) -> tuple[Column, Column]:
    """Multiples of the nice step around a range; an empty range is padded by a twentieth, at least by one."""
    step = nice_step(high - low, ticks)
    pad = F.greatest(F.lit(1.0), F.abs(low) * 0.05)
    safe = F.when(step > 0, step).otherwise(1.0)
    return F.when(low == high, low - pad).otherwise(F.floor(low / safe) * safe), F.when(low == high, high + pad).otherwise(F.ceil(high / safe) * safe)


def unit_factor(unit: Column, units: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for pair in units.items() for v in pair)), unit)


def voxel_length(length: Column, unit: Column, spacing: Column, spacing_unit: Column) -> Column:
    """A scale bar's length in voxels."""
    return length * unit_factor(unit, LENGTHS) / (spacing * unit_factor(spacing_unit, LENGTHS))


def timepoint_text(t: Column, interval: Column, unit: Column) -> Column:
    return F.concat(F.format_string("%.2f", (t - 1) * interval), F.lit(" "), unit)


def signed_degrees(angle: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def data_coordinate(display: Column, display_size: int, data_size: int) -> Column:
    at = F.greatest(F.lit(0), F.least(F.lit(display_size - 1), F.floor(display + 0.5)))
    return F.least(F.lit(data_size - 1), F.floor(at / display_size * data_size)).cast("int")


def detail_level(step: Column, footprint: Column, confidence: Column, mode: str, scale: float, top: float) -> Column:
    """The fractional level to sample at: log2 of the voxels a step or a pixel covers, less where the ray is sure already."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.log2(F.greatest(step, footprint, F.lit(1.0))) * scale))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    factor = {"iso": F.lit(0.95), "bl": 0.7 - sure * 0.25}.get(mode, 1 - sure)
    return F.greatest(F.lit(0.0), F.least(F.lit(float(top)), base * factor))


def detail_band(level: Column, top: int) -> tuple[Column, Column, Column]:
    """The two levels a fractional one lies between, and the share of the upper; level 0 alone below one."""
    l = F.greatest(F.lit(0.0), F.least(F.lit(float(top)), level))  # noqa: E741
    low = F.floor(l)
    high = F.least(low + 1, F.lit(top))
    return (
        F.when(l < 1, 0).otherwise(low).cast("int"),
        F.when(l < 1, 0).otherwise(high).cast("int"),
        F.when((l < 1) | (high <= low), 0.0).otherwise(l - low),
    )


def downsample_size(z: Column, y: Column, x: Column) -> Column:
    return F.cbrt(z * y * x)


def hsv(hue: Column, saturation: float, value: float) -> list[Column]:
    """Red, green and blue bytes of a hue in degrees."""
    sector = F.pmod(hue, F.lit(360.0)) / 60
    chroma = value * saturation
    middle = chroma * (1 - F.abs(sector % 2 - 1))
    k = F.floor(sector)
    out = []
    for full, half in (((0, 5), (1, 4)), ((1, 2), (0, 3)), ((3, 4), (2, 5))):
        part = F.when(k.isin(*full), chroma).when(k.isin(*half), middle).otherwise(0.0)
        out.append(F.floor((part + value - chroma) * 255 + 0.5).cast("int"))
    return out


def golden_hue(seed: Column) -> Column:
    """Hues far apart for consecutive seeds."""
    return F.pmod((F.abs(seed) + 1) * 137.508, F.lit(360.0))


def hsl(hue: Column, saturation: float, lightness: float) -> list[Column]:
    """Red, green and blue bytes of a hue in degrees, by lightness."""
    value = lightness + saturation * min(lightness, 1 - lightness)
    return hsv(hue, 0.0 if value == 0 else 2 * (1 - lightness / value), value)


def fitted_window(a: Column, b: Column, low: float, high: float, narrowest: float = 1e-4) -> tuple[Column, Column]:
    """A window's ends in order, inside the value range and not narrower than it may be."""
    least = min(narrowest, high - low)
    inside = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    start, end = inside(F.least(a, b)), inside(F.greatest(a, b))
    middle = F.greatest(F.lit(low), F.least(F.lit(high - least), (start + end) / 2 - least / 2))
    tight = end - start < least
    return F.when(tight, middle).otherwise(start), F.when(tight, middle + least).otherwise(end)


def slider_places(start: Column, end: Column, low: float, high: float, steps: int) -> dict[str, Column]:
    """Where the four sliders of a window stand: its ends, brightness (falls with the middle) and contrast (grows as it narrows)."""
    span, half = high - low, steps / 2
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), F.floor(c + 0.5))).cast("int")
    if not span > 0:
        return {"low": F.lit(0), "high": F.lit(0), "brightness": F.lit(0), "contrast": F.lit(steps)}
    share = (end - start) / span
    contrast = F.when(share <= 0, float(steps)).when(share < 1, steps - share * half).otherwise(half / share)
    middle = start + (end - start) / 2
    return {"low": at((start - low) / span * (steps - 1), steps - 1), "high": at((end - low) / span * (steps - 1), steps - 1), "brightness": at((high - middle) / span * steps, steps), "contrast": at(contrast, steps)}


def at_brightness(start: Column, end: Column, place: Column, low: float, high: float, steps: int) -> tuple[Column, Column]:
    """The window moved, at its width, to where a brightness slider stands."""
    middle = low + (high - low) * (steps - place) / steps
    half = (end - start) / 2
    return fitted_window(middle - half, middle + half, low, high)


def at_contrast(start: Column, end: Column, place: Column, low: float, high: float, steps: int) -> tuple[Column, Column]:
    """The window widened or narrowed about its middle; the sliders' ends leave it as it is."""
    half = steps / 2
    slope = F.when(place <= half, place / half).when(place < steps, half / F.nullif(steps - place, F.lit(0)))
    middle, reach = start + (end - start) / 2, 0.5 * (high - low) / F.nullif(slope, F.lit(0.0))
    return fitted_window(F.coalesce(middle - reach, start), F.coalesce(middle + reach, end), low, high)


def node_bounds(place: Column, size: int, chunk: int, level: Column, nodes: Column) -> dict[str, Column]:
    """Along one axis, the hierarchy node that holds a place: its number, first voxel and end."""
    width = chunk * F.pow(F.lit(2.0), level)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(max(size - 1e-3, 0.0)), place))
    number = F.greatest(F.lit(0), F.least(nodes - 1, F.floor(inside / width)))
    return {"node": number.cast("int"), "first": number * width, "end": F.least((number + 1) * width, F.lit(float(size)))}


def steps_to_exit(place: Column, step: Column, first: Column, end: Column) -> Column:
    """Steps of a ray until it leaves a node along one axis; null where it stands still there."""
    return F.when(step > 1e-6, (end - place) / step).when(step < -1e-6, (first - place) / step)


M32 = 0xFFFFFFFF
#: Fixed value of the seeded generator: its step, which also replaces a zero seed.
SEED_STEP = 0x6D2B79F5


def product32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of unsigned 32-bit numbers, by halves, so that no long overflows."""
    upper = (a * F.shiftright(b, 16)).bitwiseAND(0xFFFF)
    return (a * b.bitwiseAND(0xFFFF) + F.shiftleft(upper, 16)).bitwiseAND(M32)


def seeded_share(seed: Column, turn: Column) -> Column:
    """The turn-th number in [0, 1) of a seeded generator; its state is a sum, so each turn is computed by itself."""
    start = F.when(seed == 0, F.lit(SEED_STEP)).otherwise(seed).cast("long")
    s = (start + turn.cast("long") * SEED_STEP).bitwiseAND(M32)
    t = product32(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + product32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(M32))
    return t.bitwiseXOR(F.shiftright(t, 14)) / 4294967296.0


def label_palette(seed: Column, label: Column) -> list[Column]:
    """Red, green and blue of a label in a seeded palette; label 0 is black."""
    return [F.when(label == 0, 0).otherwise(c) for c in hsv(seeded_share(seed, label) * 360, 1.0, 1.0)]
