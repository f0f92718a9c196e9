"""Quality words: their bits written, read and classified."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: field: (lowest bit, bits); all other bits must be zero.
LAYOUTS: dict[tuple[str, str], dict[str, tuple[int, int]]] = {
    ("collection1", "OLI"): {"fill": (0, 1), "terrainOcclusion": (1, 1), "radSaturation": (2, 2), "cloudMask": (4, 1), "cloud": (5, 2), "cloudShadow": (7, 2), "snow": (9, 2), "cirrus": (11, 2)},
    ("collection1", "TM"): {"fill": (0, 1), "terrainOcclusion": (1, 1), "radSaturation": (2, 2), "cloudMask": (4, 1), "cloud": (5, 2), "cloudShadow": (7, 2), "snow": (9, 2)},
    ("collection1", "MSS"): {"fill": (0, 1), "terrainOcclusion": (1, 1), "radSaturation": (2, 2), "cloudMask": (4, 1), "cloud": (5, 2)},
    ("pre_collection", "OLI"): {"fill": (0, 1), "droppedFrame": (1, 1), "terrainOcclusion": (2, 1), "water": (4, 2), "snow": (10, 2), "cirrus": (12, 2), "cloud": (14, 2)},
}
_ALIASES = {"TIRS": "OLI", "OLI_TIRS": "OLI", "OLI/TIRS": "OLI", "ETM+": "TM", "ETM": "TM"}
LEVELS = {1: {"no": 0, "yes": 1}, 2: {"na": 0, "low": 1, "med": 2, "high": 3}}
DEFAULTS = {"fill": "no", "terrainOcclusion": "no", "radSaturation": "na", "droppedFrame": "no"}
CONDITIONS = ("cloud", "cirrus", "snow", "water")


def layout(sensor: str = "OLI", legacy: str = "collection1") -> dict[str, tuple[int, int]]:
    s = _ALIASES.get(sensor.upper(), sensor.upper())
    if (legacy, s) not in LAYOUTS:
        raise ValueError(f"no layout of {legacy} for {sensor}")
    return LAYOUTS[legacy, s]


def allowed(sensor: str = "OLI", legacy: str = "collection1", **flags: str | list[str]) -> dict[str, list[int]]:
    """The values each field may take. Fields not named take their defaults: no
    fill, terrain occlusion, saturation or dropped frame, else anything."""
    fields = layout(sensor, legacy)
    known = {f for x in LAYOUTS.values() for f in x} | {"droppedPixel"}
    if set(flags) - known:
        raise ValueError(f"unknown flags: {sorted(set(flags) - known)}")
    out = {}
    for f, (_, bits) in fields.items():
        want = flags.get(f, DEFAULTS.get(f, "all"))
        names = [want] if isinstance(want, str) else list(want)
        if names == ["all"]:
            out[f] = list(LEVELS[bits].values())
        elif set(names) - set(LEVELS[bits]):
            raise ValueError(f"{f} is one of {list(LEVELS[bits])} or all")
        else:
            out[f] = sorted(LEVELS[bits][n] for n in names)
    return out


def encode(sensor: str = "OLI", legacy: str = "collection1", **flags: str | list[str]) -> list[int]:
    """All words that the flags allow, sorted."""
    fields = layout(sensor, legacy)
    values = allowed(sensor, legacy, **flags)
    return sorted(sum(v << fields[f][0] for f, v in zip(values, combo)) for combo in product(*values.values()))


def matches(word: Column, sensor: str = "OLI", legacy: str = "collection1", **flags: str | list[str]) -> Column:
    """Whether a word is one of those: bit tests, so nothing is enumerated."""
    fields = layout(sensor, legacy)
    w = word.cast("int")
    used = sum(((1 << n) - 1) << at for at, n in fields.values())
    ok = w.bitwiseAND(F.lit(0xFFFF & ~used)) == 0
    ok = ok & (w >= 0) & (w <= 0xFFFF)
    for f, values in allowed(sensor, legacy, **flags).items():
        at, n = fields[f]
        if len(values) < 1 << n:
            ok = ok & F.shiftright(w, at).bitwiseAND(F.lit((1 << n) - 1)).isin(values)
    return ok


def decode(word: Column) -> Column:
    """The 16 bits, highest first."""
    return F.lpad(F.bin(word.cast("long").bitwiseAND(F.lit(65535))), 16, "0")


def classify(word: Column, types: list[str] = ("background", *CONDITIONS), sensor: str = "OLI", legacy: str = "collection1", strict_compat: bool = False) -> Column:
    """1 background, 2 cloud, 3 cirrus, 4 snow, 5 water (the last that holds), else
    NULL. Conditions hold with high confidence; background has low confidence or
    none for all of them. Conditions that the layout lacks are skipped;
    ``strict_compat`` lets them hold always, as an enumeration of words would."""
    fields = layout(sensor, legacy)
    out = F.lit(None).cast("int")
    if "background" in types:
        calm = {c: ["na", "low"] for c in ("cloud", "cirrus", "snow", "water", "cloudShadow") if c in fields}
        out = F.when(matches(word, sensor, legacy, **calm), F.lit(1)).otherwise(out)
    for k, c in enumerate(CONDITIONS):
        if c not in types or c not in fields and not strict_compat:
            continue
        out = F.when(matches(word, sensor, legacy, **({c: "high"} if c in fields else {})), F.lit(k + 2)).otherwise(out)
    return out


def confidence(word: Column, condition: str, sensor: str = "OLI", legacy: str = "collection1") -> Column:
    """1 low, 2 medium, 3 high confidence of a condition, else NULL."""
    if condition not in layout(sensor, legacy):
        raise ValueError(f"the layout has no {condition}")
    out = F.lit(None).cast("int")
    for k, level in enumerate(("low", "med", "high")):
        out = F.when(matches(word, sensor, legacy, **{condition: level}), F.lit(k + 1)).otherwise(out)
    return out


def classify_frame(img: DataFrame, word: str, keys: list[str], conf_layers: bool = False, types: list[str] = ("background", *CONDITIONS), sensor: str = "OLI", legacy: str = "collection1") -> DataFrame:
    """``keys`` and the class, or with ``conf_layers`` a column of confidence for
    each condition of the layout, cloud shadow included."""
    w = F.col(word)
    if not conf_layers:
        return img.select(*keys, classify(w, types, sensor, legacy).alias("class"))
    have = [c for c in ("cloud", "cloudShadow", "cirrus", "snow", "water") if c in layout(sensor, legacy)]
    return img.select(*keys, *[confidence(w, c, sensor, legacy).alias(c) for c in have])


def one_hot(img: DataFrame, layer: str, classes: list[int], keys: list[str], background: int = 0, foreground: int = 1, na_rm: bool = False) -> DataFrame:
    """A column c_<class> for each class. NULL stays NULL, or is background if na_rm."""
    c = F.col(layer)
    none = F.lit(background) if na_rm else F.lit(None).cast("int")
    return img.select(*keys, *[F.when(c.isNull(), none).when(c == k, F.lit(foreground)).otherwise(F.lit(background)).cast("int").alias(f"c_{k}") for k in classes])
