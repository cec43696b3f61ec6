"""Colours of style sheets: read, write, find in values and compare."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

RGB = StructType([StructField(n, DoubleType()) for n in ("r", "g", "b", "alpha")])
# The named colours of the CSS Color Module.
_NAMED = """aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000 blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32""".split()  # noqa: E501
NAMED = dict(zip(_NAMED[::2], _NAMED[1::2], strict=True))
_NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(%|deg|rad|grad|turn)?\Z")


def _component(word: str, whole: float) -> float:
    """A number, or a percentage of ``whole``; ``none`` is zero."""
    if word == "none":
        return 0.0
    m = _NUMBER.match(word)
    if not m or m[2] not in (None, "%"):
        raise ValueError(word)
    return float(m[1]) * (whole / 100 if m[2] else 1)


def _angle(word: str) -> float:
    if word == "none":
        return 0.0
    m = _NUMBER.match(word)
    if not m or m[2] == "%":
        raise ValueError(word)
    return float(m[1]) * {None: 1, "deg": 1, "rad": 180 / math.pi, "grad": 0.9, "turn": 360}[m[2]] % 360


def _hsl(h: float, s: float, light: float) -> tuple[float, float, float]:
    s, light = min(max(s, 0), 1), min(max(light, 0), 1)

    def f(n: float) -> float:
        k = (n + h / 30) % 12
        return 255 * (light - s * min(light, 1 - light) * max(-1, min(k - 3, 9 - k, 1)))

    return f(0), f(8), f(4)


def _oklab(light: float, a: float, b: float) -> tuple[float, float, float]:
    # The matrices of OKLab.
    lms = [(light + x * a + y * b) ** 3 for x, y in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))]
    rows = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))

    def gamma(x: float) -> float:
        return 255 * min(max(12.92 * x if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055, 0), 1)

    return tuple(gamma(sum(p * q for p, q in zip(r, lms, strict=True))) for r in rows)


@lru_cache(20_000)
def parse(value: str) -> tuple[float, float, float, float] | None:
    """Red, green and blue from 0 to 255 and alpha from 0 to 1; None for what is no colour by itself."""
    text = value.strip().lower()
    if text == "transparent":
        return 0.0, 0.0, 0.0, 0.0
    text = "#" + NAMED[text] if text in NAMED else text
    if re.fullmatch(r"#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", text):
        digits = text[1:] if len(text) > 5 else "".join(c * 2 for c in text[1:])
        parts = [int(digits[k : k + 2], 16) for k in range(0, len(digits), 2)]
        return float(parts[0]), float(parts[1]), float(parts[2]), parts[3] / 255 if len(parts) > 3 else 1.0
    m = re.fullmatch(r"(rgba?|hsla?|oklch|oklab)\(([^()]*)\)", text)
    if not m or "var(" in text or re.match(r"\s*from\s", m[2]):
        return None
    words = [w for w in re.split(r"[\s,/]+", m[2].strip()) if w]
    try:
        if len(words) not in (3, 4):
            return None
        alpha = min(max(_component(words[3], 1), 0), 1) if len(words) == 4 else 1.0
        kind = m[1].rstrip("a") if m[1] in ("rgba", "hsla") else m[1]
        if kind == "rgb":
            out = tuple(min(max(_component(w, 255), 0), 255) for w in words[:3])
        elif kind == "hsl":
            out = _hsl(_angle(words[0]), _component(words[1], 100) / 100, _component(words[2], 100) / 100)
        elif kind == "oklab":
            out = _oklab(_component(words[0], 1), _component(words[1], 0.4), _component(words[2], 0.4))
        else:
            chroma, hue = _component(words[1], 0.4), math.radians(_angle(words[2]))
            out = _oklab(_component(words[0], 1), chroma * math.cos(hue), chroma * math.sin(hue))
    except ValueError:
        return None
    return (*out, alpha) if all(map(math.isfinite, out)) else None


# What may be a colour in a value, with the borders of words that the results depend on.
_TOKEN = re.compile(r"#[\da-f]{3,8}\b|\b(?:rgba?|hsla?|oklch|oklab)\([^()]*\)|\b[a-z]+\b", re.I | re.A)


def _found(value: str) -> list[tuple[str, tuple[float, float, float, float]]]:
    """Colour tokens of a value as written and what they are, bare words only if they are named colours."""
    read = ((t, parse(t)) for t in _TOKEN.findall(value) if "(" in t or t[0] == "#" or t.lower() in NAMED)
    return [(t, rgb) for t, rgb in read if rgb is not None]


def find(value: str) -> list[str]:
    return [t for t, _ in _found(value)]


def found(value: str) -> list[tuple[str, float]]:
    """The colours of a value as ``#rrggbb`` with their alpha."""
    return [(hex_of(rgb), rgb[3]) for _, rgb in _found(value)]


def hex_of(rgb: tuple[float, ...]) -> str:
    return "#" + "".join(f"{math.floor(c + 0.5):02x}" for c in rgb[:3])


@F.pandas_udf(RGB)
def parse_color(value: pd.Series) -> pd.DataFrame:
    rows = [parse(v) if v is not None else None for v in value]
    return pd.DataFrame([r or (None,) * 4 for r in rows], columns=["r", "g", "b", "alpha"], dtype="float64")


@F.pandas_udf(ArrayType(StringType()))
def colors_in(value: pd.Series) -> pd.Series:
    return pd.Series([find(v) if v is not None else None for v in value])


def to_hex(rgb: Column) -> Column:
    """``#rrggbb``; null without a colour."""
    part = lambda c: F.lpad(F.lower(F.hex(F.floor(rgb[c] + 0.5).cast("int"))), 2, "0")
    return F.when(rgb["r"].isNotNull(), F.concat(F.lit("#"), part("r"), part("g"), part("b")))


def _lab(rgb: Column) -> tuple[Column, Column, Column]:
    line = [F.when(rgb[c] / 255 <= 0.04045, rgb[c] / 255 / 12.92).otherwise(F.pow((rgb[c] / 255 + 0.055) / 1.055, 2.4)) for c in "rgb"]
    # The matrix of sRGB to XYZ, the white point D65 and the bend of Lab, rounded as the results need them.
    rows = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
    xyz = [sum(k * c for k, c in zip(r, line, strict=True)) / w for r, w in zip(rows, (0.95047, 1.0, 1.08883), strict=True)]
    f = [F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16 / 116) for v in xyz]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def color_distance(a: Column, b: Column) -> Column:
    """Distance of two colours in Lab (CIE76)."""
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(_lab(a), _lab(b), strict=True)))
