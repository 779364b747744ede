"""The reflective panel's 64 colours: XYZ, Lab, previews, thresholds and nearest codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the panel: chromaticities, typical reflectance and contrast, and XYZ to linear sRGB.
WHITE_XY = (0.321, 0.347)
PRIMARIES_XY = ((0.530, 0.310), (0.319, 0.417), (0.175, 0.223))
REFLECTANCE, CONTRAST = 0.084, 25.0
TO_SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
#: sRGB to XYZ under D65, its white, and the ordered dither with its strength in L, a and b.
FROM_SRGB = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
D65 = (0.9505, 1.0, 1.089)
BAYER = (0, 8, 2, 10, 12, 4, 14, 6, 1, 9, 3, 11, 13, 5, 15, 7)
STRENGTH = (14.0, 6.0, 6.0)


def _xyz(x: float, y: float, lum: float) -> np.ndarray:
    return np.array([lum * x / y, lum, lum * (1 - x - y) / y])


def _primaries() -> np.ndarray:
    """XYZ of the primaries at full, as columns: together with the black floor they give the panel's white."""
    unit = np.column_stack([_xyz(*p, 1.0) for p in PRIMARIES_XY])
    return unit * np.linalg.solve(unit, _xyz(*WHITE_XY, REFLECTANCE - REFLECTANCE / CONTRAST))


PRIMARY, BLACK = _primaries(), _xyz(*WHITE_XY, REFLECTANCE / CONTRAST)
WHITE = BLACK + PRIMARY.sum(axis=1)
_CHANNELS = np.array([(r, g, b) for b in range(4) for g in range(4) for r in range(4)])
#: The 64 codes in order and their XYZ and Lab.
CODES = [int(192 + 16 * b + 4 * g + r) for r, g, b in _CHANNELS]
CODE_XYZ = BLACK + _CHANNELS / 3 @ PRIMARY.T


def _lab_rows(xyz: np.ndarray, white: np.ndarray) -> np.ndarray:
    t = xyz / white
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t * (29 / 6) ** 2 / 3 + 4 / 29)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], 1)


CODE_LAB = _lab_rows(CODE_XYZ, WHITE)


def xyz_of(r: Column, g: Column, b: Column) -> list[Column]:
    """XYZ of two-bit channels: levels are shares of area, so light is linear in them."""
    return [F.lit(float(BLACK[k])) + (r * float(PRIMARY[k, 0]) + g * float(PRIMARY[k, 1]) + b * float(PRIMARY[k, 2])) / 3 for k in range(3)]


def lab_of(xyz: list[Column], white) -> list[Column]:
    f = [F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t * ((29 / 6) ** 2 / 3) + 4 / 29) for t in (x / float(w) for x, w in zip(xyz, white, strict=True))]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def srgb_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """Lab of 8-bit sRGB under D65."""
    lin = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4)) for c in (v / 255.0 for v in (r, g, b))]
    return lab_of([lin[0] * m[0] + lin[1] * m[1] + lin[2] * m[2] for m in FROM_SRGB], D65)


def gamma(v: Column) -> Column:
    """Linear light, cut to 0 to 1, as sRGB of 0 to 1."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, 1 / 2.4) - 0.055)


def preview(xyz: list[Column], adapted: bool = True) -> list[Column]:
    """sRGB of 0 to 255 as the eye sees it: adapted to the panel's white, or beside a card of 90 % reflectance."""
    to = np.array(TO_SRGB)
    white = to @ WHITE / WHITE[1]
    scale = 1 / (WHITE[1] * white) if adapted else np.full(3, 1 / 0.90)
    rows = to * scale[:, None]
    return [F.rint(gamma(xyz[0] * float(m[0]) + xyz[1] * float(m[1]) + xyz[2] * float(m[2])) * 255).cast("int") for m in rows]


def nearest(lab: list[Column], codes: list[int] | None = None) -> Column:
    """The nearest code in Lab, ties to the first in the order of red, green and blue levels, or of the given codes."""
    own = sorted(CODES, key=lambda v: (v & 3, v >> 2 & 3, v >> 4 & 3)) if codes is None else list(codes)
    at = np.array([CODE_LAB[CODES.index(v)] for v in own], float)
    named = np.array(own, np.int32)

    @F.pandas_udf(T.IntegerType())
    def solve(l: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:  # noqa: E741
        d = [x.to_numpy(float)[:, None] - at[None, :, k] for k, x in enumerate((l, a, b))]
        return pd.Series(named[(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).argmin(1)])

    return solve(*lab)


def dithered(lab: list[Column], x: Column, y: Column) -> list[Column]:
    """Lab moved by the ordered dither at pixel (x, y)."""
    step = F.get(F.array(*(F.lit(v / 16 - 0.5) for v in BAYER)), (F.pmod(y, F.lit(4)) * 4 + F.pmod(x, F.lit(4))).cast("int"))
    return [c + step * s for c, s in zip(lab, STRENGTH, strict=True)]


def thresholds() -> list[float]:
    """Midpoints between the panel's neutral levels as 8-bit sRGB."""
    lum = np.clip(CODE_XYZ[[CODES.index(192 + 21 * k) for k in range(4)], 1] / WHITE[1], 0, 1)
    shown = 255 * np.where(lum <= 0.0031308, lum * 12.92, 1.055 * lum ** (1 / 2.4) - 0.055)
    return [float(v) for v in (shown[:-1] + shown[1:]) / 2]
