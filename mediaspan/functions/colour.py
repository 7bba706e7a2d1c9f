"""Changes of colour as expressions over three channel columns of 0 to 255."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma of Rec. 601 (that of Rec. 709 stands in grayscale), rows of the sepia tone, strength of highlights and shadows, most fade and what it moves to.
LUMA_601 = (0.299, 0.587, 0.114)
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))
TONE, MOST_FADE, GRAY = 0.35, 0.55, 128.0
# Falloff of the vignette, most grain, and the steps of its noise.
FALLOFF, MOST_GRAIN = 1.8, 28.0
NOISE = (374761393, 668265263, 1274126177)
# Rows of the rotation of hue, each a constant, a part of the cosine and one of the sine.
HUE = (
    ((0.213, 0.787, -0.213), (0.715, -0.715, -0.715), (0.072, -0.072, 0.928)),
    ((0.213, -0.213, 0.143), (0.715, 0.285, 0.140), (0.072, -0.072, -0.283)),
    ((0.213, -0.213, -0.787), (0.715, -0.715, 0.715), (0.072, 0.928, 0.072)),
)
# sRGB and XYZ under D65 both ways, and the white.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
# Bounds of the mapping between two pictures, and of what is protected.
SPREAD, SHIFTS, LEAST_PIXELS = (0.84, 1.18), (16.0, 20.0, 20.0), 32
LIGHT_FROM, DARK_TO, EDGE, TONE_RATIO = 190.0, 70.0, 35.0, (0.6, 1.8)

Channels = tuple[Column, Column, Column]


def _between(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _byte(x: Column) -> Column:
    """The nearest whole value of a channel."""
    return F.floor(_between(x, 0.0, 255.0) + 0.5).cast("int")


def _weighed(rgb: Channels, weights: tuple[float, ...]) -> Column:
    return weights[0] * rgb[0] + weights[1] * rgb[1] + weights[2] * rgb[2]


def contrast_factor(contrast: float) -> float:
    return 259.0 * (contrast + 255.0) / (255.0 * (259.0 - contrast))


def adjust(rgb: Channels, brightness: int = 0, contrast: float = 0.0, saturation: float = 100.0) -> Channels:
    """Brightness (-100 to 100) as a factor, then contrast (-100 to 100) about the middle, then saturation (0 to 300 percent) about the luma."""
    light = (100 + max(-100, min(100, brightness))) / 100
    spread = contrast_factor(max(-100.0, min(100.0, contrast)))
    colour = max(0.0, min(3.0, saturation / 100))
    moved = tuple(spread * (c * light - GRAY) + GRAY for c in rgb)
    gray = _weighed(moved, LUMA_601)
    return tuple(_byte(gray + (c - gray) * colour) for c in moved)


def grayscale(rgb: Channels) -> Channels:
    """The luma of Rec. 709 in whole numbers, cut off."""
    gray = F.floor((2126 * rgb[0] + 7152 * rgb[1] + 722 * rgb[2]) / 10000).cast("int")
    return gray, gray, gray


def invert(rgb: Channels) -> Channels:
    return tuple((F.lit(255) - c).cast("int") for c in rgb)


def sepia(rgb: Channels) -> Channels:
    """Cut off, not rounded."""
    return tuple(F.floor(F.least(_weighed(rgb, row), F.lit(255.0))).cast("int") for row in SEPIA)


def tones(rgb: Channels, highlights: float, shadows: float) -> Channels:
    """Light parts move by highlights and dark parts by shadows (-100 to 100), masked by the luma to the power of 1.5."""
    high, low = (max(-1.0, min(1.0, x / 100)) for x in (highlights, shadows))
    share = tuple(c / 255.0 for c in rgb)
    light = _between(_weighed(share, LUMA_601), 0.0, 1.0)
    dark = 1.0 - light
    move = low * TONE * (dark * F.sqrt(dark)) + high * TONE * (light * F.sqrt(light))
    return tuple(_byte(_between(c + move, 0.0, 1.0) * 255.0) for c in share)


def fade(rgb: Channels, percent: float) -> Channels:
    """Towards the middle gray, by half and a little more at most."""
    part = max(0.0, min(1.0, percent / 100)) * MOST_FADE
    return tuple(_byte(c * (1.0 - part) + GRAY * part) for c in rgb)


def vignette(rgb: Channels, x: Column, y: Column, width: int, height: int, percent: float) -> Channels:
    """Darker towards the corners of a picture of that size."""
    cx, cy = (width - 1) * 0.5, (height - 1) * 0.5
    far = max(1.0, (cx * cx + cy * cy) ** 0.5)
    dx, dy = x - cx, y - cy
    light = 1.0 - max(0.0, min(1.0, percent / 100)) * F.pow(F.sqrt(dx * dx + dy * dy) / far, F.lit(FALLOFF))
    return tuple(_byte(c * light) for c in rgb)


def noise(x: Column, y: Column) -> Column:
    """0 to 1, the same for the same place: a hash in wrapping unsigned 32-bit numbers."""
    mask = F.lit((1 << 32) - 1)
    wrap = lambda n: n.bitwiseAND(mask)
    mixed = wrap(wrap(x.cast("long") * NOISE[0]) + wrap(y.cast("long") * NOISE[1]))
    mixed = wrap(mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 13)) * NOISE[2])
    mixed = mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 16))
    return mixed.cast("double") / float(1 << 32)


def grain(rgb: Channels, x: Column, y: Column, percent: float) -> Channels:
    """Noise of the place, the same in all channels."""
    move = (noise(x, y) - 0.5) * 2.0 * (max(0.0, min(1.0, percent / 100)) * MOST_GRAIN)
    return tuple(_byte(c + move) for c in rgb)


def to_lab(rgb: Channels) -> Channels:
    """L, a and b of sRGB from 0 to 255, each scaled or moved to 0 to 255."""

    def linear(c: Column) -> Column:
        x = _between(c / 255.0, 0.0, 1.0)
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    def curve(t: Column) -> Column:
        d = 6.0 / 29.0
        return F.when(t > d * d * d, F.cbrt(t)).otherwise(t / (3.0 * d * d) + 4.0 / 29.0)

    plain = tuple(linear(c) for c in rgb)
    fx, fy, fz = (curve(_weighed(plain, row) / white) for row, white in zip(TO_XYZ, WHITE, strict=True))
    return _between((116.0 * fy - 16.0) * 255.0 / 100.0, 0.0, 255.0), _between(500.0 * (fx - fy) + 128.0, 0.0, 255.0), _between(200.0 * (fy - fz) + 128.0, 0.0, 255.0)


def from_lab(lab: Channels) -> Channels:
    """The way back, from 0 to 255 and not rounded."""

    def cube(t: Column) -> Column:
        d = 6.0 / 29.0
        return F.when(t > d, t * t * t).otherwise(3.0 * d * d * (t - 4.0 / 29.0))

    def shown(c: Column) -> Column:
        x = _between(c, 0.0, 1.0)
        return _between(F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1.0 / 2.4)) - 0.055) * 255.0, 0.0, 255.0)

    fy = (lab[0] * 100.0 / 255.0 + 16.0) / 116.0
    xyz = tuple(cube(f) * white for f, white in zip((fy + (lab[1] - 128.0) / 500.0, fy, fy - (lab[2] - 128.0) / 200.0), WHITE, strict=True))
    return tuple(shown(_weighed(xyz, row)) for row in FROM_XYZ)


def matched(lab: Channels, own: list[Column], other: list[Column], strengths: tuple[float, float, float]) -> Channels:
    """A pixel's channels moved towards another picture's median and width, given as structs of median, p16 and p84 a channel."""
    out = []
    for c, (x, a, b) in enumerate(zip(lab, own, other, strict=True)):
        width = _between(((b["p84"] - b["p16"]) + 1e-6) / ((a["p84"] - a["p16"]) + 1e-6), *SPREAD)
        shift = _between(b["median"] - a["median"], -SHIFTS[c], SHIFTS[c])
        moved = (x - a["median"]) * width + a["median"] + shift
        out.append(_between(x * (1.0 - strengths[c]) + moved * strengths[c], 0.0, 255.0))
    return tuple(out)


def protected(new: Channels, old: Channels, light: float, dark: float) -> Channels:
    """Light and dark parts stay as they were, by so much."""
    gray = _weighed(old, LUMA_601)
    part = F.greatest(_between((gray - LIGHT_FROM) / EDGE, 0.0, 1.0) * light, _between((DARK_TO - gray) / EDGE, 0.0, 1.0) * dark)
    return tuple(a * (1.0 - part) + b * part for a, b in zip(new, old, strict=True))


def toned(new: Channels, old: Channels, strength: float) -> Channels:
    """Brought back towards the old luma by a bounded factor."""
    ratio = _between(_weighed(old, LUMA_601) / F.greatest(_weighed(new, LUMA_601), F.lit(1.0)), *TONE_RATIO)
    factor = 1.0 - strength + strength * ratio
    return tuple(_between(c * factor, 0.0, 255.0) for c in new)


def rounded(rgb: Channels) -> Channels:
    return tuple(_byte(c) for c in rgb)


def _cut(x: Column) -> Column:
    """A channel's whole value, cut off."""
    return F.floor(_between(x, 0.0, 255.0)).cast("int")


def edited(rgb: Channels, brightness: int = 0, contrast: float = 0.0, saturation: float = 1.0) -> Channels:
    """The editor's brightness and contrast (percent, a plain factor about the middle) and saturation about the luma, cut off once."""
    light, spread = (100 + brightness) / 100, (100 + contrast) / 100
    moved = tuple((c * light - GRAY) * spread + GRAY for c in rgb)
    gray = _weighed(moved, LUMA_601)
    return tuple(_cut(gray + saturation * (c - gray)) if saturation != 1.0 else _cut(c) for c in moved)


def hue_matrix(degrees: float) -> list[list[float]]:
    turn = math.radians(degrees)
    return [[k + math.cos(turn) * c + math.sin(turn) * s for k, c, s in row] for row in HUE]


def hue(rgb: Channels, degrees: float) -> Channels:
    return tuple(_cut(_weighed(rgb, tuple(row))) for row in hue_matrix(degrees))


def taps(sigma: float) -> dict[int, float]:
    """Offsets and weights of a Gaussian that ends at twice its sigma."""
    return {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(math.floor(0.5 - 2 * sigma), math.ceil(0.5 + 2 * sigma))}
