"""Radiometric correction: digital numbers to radiance, reflectance and temperature."""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import options
from ..functions import stats
from ..functions.expr import band, clamp, div, lit
from ..sources.metadata import ImageMetaData

_MSS = (1848.0, 1588.0, 1235.0, 856.6)


def _mss(first: int, *wavelengths: float) -> dict:
    return {f"B{first + i}": (w, e, "solar") for i, (w, e) in enumerate(zip(wavelengths, _MSS))}


def _tm(*rows: tuple) -> dict:
    return {f"B{i + 1}": (w, e, "thermal" if e is None else "solar") for i, (w, e) in enumerate(rows)}


#: band: (centre wavelength in micrometres, exoatmospheric irradiance, kind)
SENSORS: dict[tuple[str, str], dict[str, tuple]] = {
    ("LANDSAT_1", "MSS"): _mss(4, 0.548, 0.652, 0.747, 0.900),
    ("LANDSAT_2", "MSS"): _mss(4, 0.548, 0.659, 0.750, 0.899),
    ("LANDSAT_3", "MSS"): _mss(4, 0.545, 0.656, 0.743, 0.896),
    ("LANDSAT_4", "MSS"): _mss(1, 0.550, 0.650, 0.757, 0.916),
    ("LANDSAT_5", "MSS"): _mss(1, 0.552, 0.650, 0.759, 0.923),
    ("LANDSAT_4", "TM"): _tm((0.486, 1958), (0.569, 1826), (0.659, 1554), (0.841, 1033), (1.676, 214.7), (11.040, None), (2.222, 80.70)),
    ("LANDSAT_5", "TM"): _tm((0.485, 1958), (0.569, 1827), (0.66, 1551), (0.840, 1036), (1.676, 214.9), (11.435, None), (2.223, 80.65)),
    ("LANDSAT_7", "ETM"): {
        **{f"B{i + 1}": (w, e, "solar") for i, (w, e) in enumerate([(0.485, 1970), (0.560, 1842), (0.660, 1547), (0.835, 1044), (1.650, 225.7)])},
        **{b: (11.335, None, "thermal") for b in ("B6", "B6_VCID_1", "B6_VCID_2")}, "B7": (2.220, 82.06, "solar"), "B8": (0.706, 1369, "pan"),
    },
    ("LANDSAT_8", "OLI_TIRS"): {
        **{f"B{i + 1}": (w, e, "solar") for i, (w, e) in enumerate([(0.44, 1895.32644), (0.48, 2004.56921), (0.56, 1820.74569), (0.655, 1549.48934), (0.865, 951.75597), (1.61, 247.55312), (2.2, 85.46265)])},
        "B8": (0.59, 1723.88066, "pan"), "B9": (1.37, 366.97235, "solar"), "B10": (10.6, None, "thermal"), "B11": (11.5, None, "thermal"), "BQA": (None, None, "qa"),
    },
}
#: The exponent of the wavelength in the scattering of each kind of atmosphere.
ATMOSPHERES = {"veryClear": -4.0, "clear": -2.0, "moderate": -1.0, "hazy": -0.7, "veryHazy": -0.5}
#: The greatest haze value (8 bits) of each kind; the next one begins there.
_LIMITS = {"veryClear": 55, "clear": 75, "moderate": 95, "hazy": 115, "veryHazy": 255}
METHODS = ("rad", "apref", "sdos", "dos", "costz")


def sensor_table(satellite: str, sensor: str) -> dict[str, tuple]:
    s = (sensor or "").upper().replace("+", "").replace("OLI/TIRS", "OLI_TIRS").replace("_COMBINED", "_TIRS")
    s = {"OLI": "OLI_TIRS", "TIRS": "OLI_TIRS"}.get(s, s)
    try:
        return SENSORS[satellite, s]
    except KeyError:
        raise ValueError(f"unknown sensor: {satellite} {sensor}") from None


def gain_offset(c: Column, gain: float, offset: float, low: float | None = None, high: float | None = None) -> Column:
    """gain * c + offset, limited to [low, high] where given."""
    return clamp(c * lit(gain) + lit(offset), low, high)


def brightness_temperature(c: Column, gain: float, offset: float, k1: float, k2: float) -> Column:
    """Kelvin, from digital numbers of a thermal band."""
    radiance = c * lit(gain) + lit(offset)
    ratio = div(lit(k1), radiance) + 1.0
    return div(lit(k2), F.when(ratio > 0, F.log(ratio)))


def haze_weights(table: dict[str, tuple], start: str, atmosphere: str) -> dict[str, float]:
    """Scattering of each solar band relative to the starting band's."""
    e = ATMOSPHERES[atmosphere]
    return {b: (w / table[start][0]) ** e for b, (w, esun, kind) in table.items() if kind == "solar"}


def haze_tables(df: DataFrame, bands: list[str]) -> DataFrame:
    """(band, value, freq) of the positive values: what estimate_haze works on,
    to be kept for further calls."""
    return stats.frequencies(df, bands).where("value > 0")


def estimate_haze(df: DataFrame, bands: list[str], dark_prop: float | dict[str, float] = 0.01, max_slope: bool = True, tables: DataFrame | None = None) -> dict[str, float]:
    """The haze value of each band: where its histogram's dark end rises.

    The dark end is the values below the share ``dark_prop`` of all positive
    pixels. Without ``max_slope`` its last value is taken; with it the value of
    the steepest rise of the smoothed shares."""
    freq = haze_tables(df, bands) if tables is None else tables.where((F.col("value") > 0) & F.col("band").isin(list(bands)))
    w = Window.partitionBy("band")
    shares = freq.withColumn("p", F.col("freq") / F.sum("freq").over(w))
    shares = shares.withColumn("cum", F.sum("p").over(w.orderBy("value"))).withColumn("rn", F.row_number().over(w.orderBy("value")))
    prop = dark_prop if isinstance(dark_prop, dict) else {b: dark_prop for b in bands}
    limit = F.lit(None).cast("double")
    for b, p in prop.items():
        limit = F.when(F.col("band") == b, lit(p)).otherwise(limit)
    shares = shares.withColumn("idx", F.greatest(F.coalesce(F.max(F.when(F.col("cum") < limit, F.col("rn"))).over(w), F.lit(1)), F.lit(1)))
    dark = shares.where("rn <= idx").persist()
    try:
        ends = {r["band"]: (r["idx"], r["value"]) for r in dark.where("rn = idx").select("band", "idx", "value").collect()}
        lacking = [b for b in bands if b not in ends]
        if lacking:
            warnings.warn(f"no positive values in {lacking}", stacklevel=2)
        out = {b: v for b, (_, v) in ends.items()}
        if not max_slope:
            return out
        tops = []
        for b, (idx, _) in ends.items():
            if idx <= 1:
                continue
            h = (2 * int((idx / 10) // 2)) // 2  # half of the odd width's rest
            o = Window.partitionBy("band").orderBy("rn")
            s = dark.where(F.col("band") == b).withColumn("sm", F.when((F.col("rn") - h >= 1) & (F.col("rn") + h <= idx), F.avg("p").over(o.rowsBetween(-h, h))))
            d = s.select("band", "rn", (F.lead("sm", 2).over(o) - F.col("sm")).alias("d"), F.coalesce(F.lead("value").over(o), F.col("value")).alias("next"))
            tops.append(d.where("d IS NOT NULL").groupBy("band").agg(F.min_by("next", F.struct(-F.col("d"), F.col("rn"))).alias("value")))
        if tops:
            out |= {r["band"]: r["value"] for r in reduce(DataFrame.unionByName, tops).collect()}
        return out
    finally:
        dark.unpersist()


def _pick_atmosphere(haze: float, bits: int) -> str:
    scale = (2**bits - 1) / 255
    for name, most in _LIMITS.items():
        if haze <= most * scale:
            return name
    raise ValueError(f"no kind of atmosphere fits the haze {haze}: name one")


def rad_cor(
    img: DataFrame,
    meta: ImageMetaData,
    method: str = "apref",
    bands: list[str] | None = None,
    keys: list[str] = (),
    haze_values: dict[str, float] | list[float] | None = None,
    haze_bands: list[str] | None = None,
    atmosphere: str | None = None,
    dark_prop: float = 0.01,
    clamped: bool = True,
) -> DataFrame:
    """Radiance (``rad``, suffix _tra), reflectance at the top of the atmosphere
    (``apref``, _tre) or at the surface by dark-object subtraction (``sdos``,
    ``dos``, ``costz``; _sre), and temperature of thermal bands (_bt).

    Everything but the haze estimate, which is one pass, is arithmetic on the
    driver; the result is one projection, with the bands in the image's order.
    Panchromatic and quality bands are left out. ``clamped`` limits radiance to
    0 and more, reflectance to [0, 1]."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    table = sensor_table(meta.satellite, meta.sensor)
    plain = lambda b: b.rsplit("_", 1)[0] if b.rsplit("_", 1)[-1] in ("dn", "pan") else b
    chosen = [b for b in img.columns if b not in keys and (bands is None or b in bands) and plain(b) in table and table[plain(b)][2] in ("solar", "thermal")]
    if not chosen:
        raise ValueError("no band of the image is in the sensor's table")
    solar = [b for b in chosen if table[plain(b)][2] == "solar"]
    lacking = [b for b in chosen if b not in meta.calrad and not (method == "apref" and b in meta.calref)]
    if lacking:
        raise ValueError(f"the metadata have no calibration for {lacking}")
    cos_z = math.cos(math.radians(90 - meta.sun_elevation))
    d, tau_v, tau_z, down = meta.sun_distance, 1.0, 1.0, 0.0
    haze = {b: 0.0 for b in solar}  # path radiance
    esun = {b: table[plain(b)][1] for b in solar}
    if method in ("sdos", "dos", "costz"):
        if haze_bands is None:
            haze_bands = list(haze_values) if isinstance(haze_values, dict) else None
        if haze_bands is None:
            raise ValueError("name the haze bands")
        if haze_values is None:
            found = estimate_haze(img, haze_bands, dark_prop)
            haze_values = {b: found[b] for b in haze_bands}
        elif not isinstance(haze_values, dict):
            haze_values = dict(zip(haze_bands, haze_values))
        if method == "sdos":
            dn = {b: float(haze_values.get(b, 0.0)) for b in solar}
            anchors = solar
        else:
            if len(haze_bands) > 1:
                warnings.warn(f"{method} takes one haze band: {haze_bands[0]}", stacklevel=2)
            anchors = [haze_bands[0]]
            dn = {anchors[0]: float(haze_values[anchors[0]])}
            if method == "costz":
                tau_z, tau_v = cos_z, math.cos(math.radians(1))
        dark = {b: 0.01 * (esun[b] * cos_z * tau_z + down) * tau_v / (math.pi * d**2) for b in anchors}
        over = {b: dn[b] * meta.calrad[b][0] + meta.calrad[b][1] - dark[b] for b in anchors}
        if method == "sdos":
            haze = over
        else:
            a = anchors[0]
            if over[a] < 0:
                warnings.warn("the estimated path radiance is negative", stacklevel=2)
            atmosphere = atmosphere or _pick_atmosphere(over[a], meta.bits or 8)
            options.say(f"atmosphere: {atmosphere}")
            weights = haze_weights(table, plain(a), atmosphere)
            haze = {b: over[a] * weights[plain(b)] * (meta.calrad[b][0] / meta.calrad[a][0]) + meta.calrad[b][1] for b in solar}
        haze = {b: max(x, 0.0) for b, x in haze.items()}
    out = []
    for b in chosen:
        name = plain(b)
        if b not in solar:
            if method == "rad":
                out.append(gain_offset(band(b), *meta.calrad[b], 0.0 if clamped else None).alias(f"{name}_tra"))
            elif b in meta.calbt:
                out.append(brightness_temperature(band(b), *meta.calrad[b], *meta.calbt[b]).alias(f"{name}_bt"))
            continue
        if method == "rad":
            out.append(gain_offset(band(b), *meta.calrad[b], 0.0 if clamped else None).alias(f"{name}_tra"))
            continue
        if method == "apref" and b in meta.calref:
            g, o = (x / cos_z for x in meta.calref[b])
        else:
            c = math.pi * d**2 / (tau_v * (esun[b] * cos_z * tau_z + down))
            g, o = c * meta.calrad[b][0], c * (meta.calrad[b][1] - haze[b])
        ends = (0.0, 1.0) if clamped else (None, None)
        out.append(gain_offset(band(b), g, o, *ends).alias(f"{name}_{'tre' if method == 'apref' else 'sre'}"))
    return img.select(*keys, *out)
