"""Spectral indices: a registry of 31 formulas, and a parser for others.

Every index is a Column, so any number of them is one projection, which
Catalyst prunes to the bands that are needed.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import band, div, lit, sqrt, within

BANDS = ("blue", "green", "red", "redEdge1", "redEdge2", "redEdge3", "nir", "swir1", "swir2", "swir3")
COEFFICIENTS = {"L": 0.5, "G": 2.5, "L_evi": 1.0, "C1": 6.0, "C2": 7.5, "s": 1.0, "swir2ccc": None, "swir2coc": None}


@dataclass(frozen=True)
class Index:
    """A formula over bands (by name) and coefficients, and the values it may take."""

    name: str
    bands: tuple[str, ...]
    formula: Callable[[dict, dict], Column]
    low: float | None = None
    high: float | None = None


def _ratio(a: Column, b: Column) -> Column:
    return div(a - b, a + b)


def _gemi(b, k):
    eta = div((b["nir"] * b["nir"] - b["red"] * b["red"]) * 2.0 + b["nir"] * 1.5 + b["red"] * 0.5, b["nir"] + b["red"] + 0.5)
    return eta * (lit(1) - eta * 0.25) - div(b["red"] - 0.125, lit(1) - b["red"])


def _ctvi(b, k):
    v = _ratio(b["nir"], b["red"]) + 0.5
    return div(v, F.sqrt(F.abs(v)))


def _msavi(b, k):
    w = b["nir"] * 2.0 + 1.0
    return b["nir"] + 0.5 - sqrt(w * w - (b["nir"] - b["red"] * 2.0) * 8.0) * 0.5


def _msavi2(b, k):
    w = b["nir"] * 2.0 + 1.0
    return (w - sqrt(w * w - (b["nir"] - b["red"]) * 8.0)) / lit(2)


def _reip(b, k):
    return div(div(b["red"] + b["redEdge3"], lit(2) - b["redEdge1"]), b["redEdge2"] - b["redEdge1"]) * 0.35 + 0.705


def _ndvic(b, k):
    return _ratio(b["nir"], b["red"]) * (lit(1) - div(b["swir2"] - lit(k["swir2ccc"]), lit(k["swir2coc"] - k["swir2ccc"])))


def _nrvi(b, k):
    r = div(b["red"], b["nir"])
    return div(r - 1.0, r + 1.0)


def _kndvi(b, k):
    v = _ratio(b["nir"], b["red"])
    return F.tanh(v * v)


_TVI_MAX = 1.5**0.5
REGISTRY: dict[str, Index] = {
    i.name: i
    for i in (
        Index("CLG", ("redEdge3", "green"), lambda b, k: div(b["redEdge3"], b["green"]) - 1.0),
        Index("CLRE", ("redEdge3", "redEdge1"), lambda b, k: div(b["redEdge3"], b["redEdge1"]) - 1.0),
        Index("CTVI", ("red", "nir"), _ctvi),
        Index("DVI", ("red", "nir"), lambda b, k: b["nir"] * k["s"] - b["red"]),
        Index("EVI", ("red", "nir", "blue"), lambda b, k: div((b["nir"] - b["red"]) * k["G"], b["nir"] + b["red"] * k["C1"] - b["blue"] * k["C2"] + k["L_evi"]), -1, 1),
        Index("EVI2", ("red", "nir"), lambda b, k: div((b["nir"] - b["red"]) * k["G"], b["nir"] + b["red"] * 2.4), -1, 1),
        Index("GEMI", ("red", "nir"), _gemi),
        Index("GNDVI", ("green", "nir"), lambda b, k: _ratio(b["nir"], b["green"]), -1, 1),
        Index("KNDVI", ("red", "nir"), _kndvi, 0, 1),
        Index("MCARI", ("green", "red", "redEdge1"), lambda b, k: (b["green"] - b["red"]) * div(b["redEdge1"], b["red"])),
        Index("MNDWI", ("green", "swir2"), lambda b, k: _ratio(b["green"], b["swir2"]), -1, 1),
        Index("MSAVI", ("red", "nir"), _msavi),
        Index("MSAVI2", ("red", "nir"), _msavi2),
        Index("MTCI", ("red", "redEdge1", "redEdge2"), lambda b, k: div(b["redEdge2"] - b["redEdge1"], b["redEdge1"] - b["red"])),
        Index("NBRI", ("nir", "swir3"), lambda b, k: _ratio(b["nir"], b["swir3"]), -1, 1),
        Index("NDREI1", ("redEdge2", "redEdge1"), lambda b, k: _ratio(b["redEdge2"], b["redEdge1"]), -1, 1),
        Index("NDREI2", ("redEdge3", "redEdge1"), lambda b, k: _ratio(b["redEdge3"], b["redEdge1"]), -1, 1),
        Index("NDVI", ("red", "nir"), lambda b, k: _ratio(b["nir"], b["red"]), -1, 1),
        Index("NDVIC", ("red", "nir", "swir2"), _ndvic, -1, 1),
        Index("NDWI", ("green", "nir"), lambda b, k: _ratio(b["green"], b["nir"]), -1, 1),
        Index("NDWI2", ("nir", "swir2"), lambda b, k: _ratio(b["nir"], b["swir2"]), -1, 1),
        Index("NRVI", ("red", "nir"), _nrvi),
        Index("REIP", ("red", "redEdge1", "redEdge2", "redEdge3"), _reip),
        Index("RVI", ("red", "nir"), lambda b, k: div(b["red"], b["nir"])),
        Index("SATVI", ("red", "swir2", "swir3"), lambda b, k: div(b["swir2"] - b["red"], b["swir2"] + b["red"] + k["L"]) * (1 + k["L"]) - b["swir3"] / lit(2)),
        Index("SAVI", ("red", "nir"), lambda b, k: div((b["nir"] - b["red"]) * (1 + k["L"]), b["nir"] + b["red"] + k["L"])),
        Index("SLAVI", ("red", "nir", "swir2"), lambda b, k: div(b["nir"], b["red"] + b["swir2"])),
        Index("SR", ("red", "nir"), lambda b, k: div(b["nir"], b["red"])),
        Index("TTVI", ("red", "nir"), lambda b, k: F.sqrt(F.abs(_ratio(b["nir"], b["red"]) + 0.5))),
        Index("TVI", ("red", "nir"), lambda b, k: sqrt(_ratio(b["nir"], b["red"]) + 0.5), None, _TVI_MAX),
        Index("WDVI", ("red", "nir"), lambda b, k: b["nir"] - b["red"] * k["s"]),
    )
}
#: Formulas as they were published, where they differ from the usual kernels.
PUBLISHED = {
    "EVI2": lambda b, k: div((b["nir"] - b["red"]) * k["G"], b["nir"] + b["red"] * 2.4 + 1.0),
    "KNDVI": lambda b, k: F.pow(F.tanh(_ratio(b["nir"], b["red"])), lit(2)),
    "MSAVI2": lambda b, k: ((b["nir"] + 1.0) * 2.0 - sqrt(F.pow((b["nir"] * 2.0) + 1.0, lit(2)) - (b["nir"] - b["red"]) * 8.0)) / lit(2),
}
#: Formulas that callers registered: texts or functions from bands to a Column.
CUSTOM: dict[str, str | Callable[..., Column]] = {}

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(.))")


def parse(formula: str) -> tuple[Callable[[dict], Column], tuple[str, ...]]:
    """A formula of numbers, bands, + - * / and parentheses as (function from bands
    to Column, bands). A quotient by zero is NULL. Anything else is an error."""
    tokens = [m.groups() for m in _TOKEN.finditer(formula.strip())]
    used: list[str] = []
    at = 0

    def peek():
        return tokens[at][2] if at < len(tokens) else None

    def factor():
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"the formula ends too early: {formula!r}")
        number, name, sign = tokens[at]
        at += 1
        if number is not None:
            return lambda b, x=float(number): lit(x)
        if name is not None:
            if name not in used:
                used.append(name)
            return lambda b, n=name: b[n]
        if sign == "(":
            inside = expression()
            if peek() != ")":
                raise ValueError(f"a parenthesis isn't closed: {formula!r}")
            at += 1
            return inside
        raise ValueError(f"unexpected {sign!r} in {formula!r}")

    def chain(part, signs):
        nonlocal at
        left = part()
        while peek() in signs:
            sign = tokens[at][2]
            at += 1
            right = part()
            left = (lambda b, f=left, g=right, s=sign: f(b) + g(b) if s == "+" else f(b) - g(b) if s == "-" else f(b) * g(b) if s == "*" else div(f(b), g(b)))
        return left

    def term():
        return chain(factor, ("*", "/"))

    def expression():
        return chain(term, ("+", "-"))

    out = expression()
    if at < len(tokens):
        raise ValueError(f"unexpected end of formula: {formula!r}")
    return out, tuple(used)


def register(name: str, formula: str | Callable[..., Column]) -> None:
    """Make ``name`` an index: a formula's text, or a function whose parameters are
    bands and whose result is a Column."""
    CUSTOM[name.upper()] = formula


def unregister(name: str) -> None:
    CUSTOM.pop(name.upper(), None)


def _custom(name: str) -> Index:
    f = CUSTOM[name]
    if callable(f):
        import inspect

        names = tuple(inspect.signature(f).parameters)
        return Index(name, names, lambda b, k: f(**{n: b[n] for n in names}))
    made, names = parse(f)
    return Index(name, names, lambda b, k: made(b))


def spectral_indices(
    img: DataFrame,
    bands: dict[str, str],
    indices: list[str] | None = None,
    keys: list[str] = (),
    scale: float = 1.0,
    coefficients: dict[str, float] | None = None,
    mask: Column | None = None,
    mask_value: float | None = 1,
    published: bool = False,
    check_reflectance: bool = False,
    keep_inf: bool = False,
) -> DataFrame:
    """``keys`` and the indices, one column each, of the images' pixels.

    ``bands`` names the image's column for each spectral band. All indices that
    these allow are computed unless ``indices`` names some; those that lack a
    band are left out with a warning, and it is an error if none remains. Bands
    are divided by ``scale`` first. Values outside an index's range are NULL.
    Pixels where ``mask`` equals ``mask_value`` (is NULL, if that is None) are
    NULL. ``check_reflectance`` scans the red band once and leaves EVI and EVI2
    out if it isn't reflectance. ``keep_inf`` keeps the infinite values of
    indices without a range (quotients by zero), which are NULL otherwise."""
    unknown = set(bands) - set(BANDS) - set(sum((list(_custom(c).bands) for c in CUSTOM), []))
    if unknown:
        raise ValueError(f"unknown bands: {sorted(unknown)}")
    k = dict(COEFFICIENTS)
    for name, x in (coefficients or {}).items():
        if name not in k:
            warnings.warn(f"unknown coefficient: {name}", stacklevel=2)
        else:
            k[name] = x
    known = {**REGISTRY, **{n: _custom(n) for n in CUSTOM if n not in REGISTRY}}
    for n in CUSTOM:
        if n in REGISTRY:  # a built-in keeps its formula; only its needs change
            base = REGISTRY[n]
            known[n] = Index(n, tuple(dict.fromkeys([*base.bands, *_custom(n).bands])), base.formula, base.low, base.high)
    wanted = [i.upper() for i in (indices or known)]
    for i in wanted:
        if i == "LSWI":
            raise ValueError("LSWI is the same as NDWI2; ask for that")
        if i not in known:
            raise ValueError(f"unknown index: {i}")
    ccc, coc = k["swir2ccc"], k["swir2coc"]
    if ccc is not None and coc is not None and ccc >= coc:
        raise ValueError("swir2ccc must be less than swir2coc")
    if ccc is None or coc is None:
        if indices and "NDVIC" in wanted:
            warnings.warn("NDVIC needs swir2ccc and swir2coc", stacklevel=2)
        wanted = [i for i in wanted if i != "NDVIC"]
    lacking = [i for i in wanted if set(known[i].bands) - set(bands)]
    if indices and lacking:
        warnings.warn(f"bands are missing for {lacking}", stacklevel=2)
    wanted = [i for i in dict.fromkeys(wanted) if i not in lacking]
    if check_reflectance and {"EVI", "EVI2"} & set(wanted):
        lo, hi = img.agg(F.min(band(bands["red"]) / lit(scale)), F.max(band(bands["red"]) / lit(scale))).first()
        if lo is not None and (lo < -0.5 or hi > 1.5):
            warnings.warn("EVI and EVI2 need reflectances", stacklevel=2)
            wanted = [i for i in wanted if i not in ("EVI", "EVI2")]
    if not wanted:
        raise ValueError("no index can be computed from these bands")
    b = {n: band(c) / lit(scale) if scale != 1 else band(c) for n, c in bands.items()}
    if mask is not None:
        off = mask.isNull() if mask_value is None else (mask == F.lit(mask_value))
        b = {n: F.when(off, F.lit(None)).otherwise(c) for n, c in b.items()}
    # two projections: a formula is evaluated once, however often its range and its
    # NaN are asked for (Spark keeps them apart, as it would have to repeat it)
    raw, cols = [], []
    for n, i in enumerate(wanted):
        ix = known[i]
        formula = PUBLISHED[i] if published and i in PUBLISHED else ix.formula
        c = formula(b, k)
        if keep_inf and i in ("SR", "RVI"):
            top, bottom = (b["nir"], b["red"]) if i == "SR" else (b["red"], b["nir"])
            c = F.when(bottom == 0, F.when(top > 0, lit(float("inf"))).when(top < 0, lit(float("-inf")))).otherwise(c)
        raw.append(c.alias(f"_raw_{n}"))
        v = F.col(f"_raw_{n}")
        if ix.low is not None or ix.high is not None:
            ok = within(v, ix.low, ix.high)  # NaN is above any limit
            cols.append((ok if ix.high is not None else F.when(~F.isnan(v), ok)).alias(i))
        else:
            cols.append(F.when(~F.isnan(v), v).alias(i))
    return img.select(*keys, *raw).select(*keys, *cols)
