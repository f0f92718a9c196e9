"""Scene metadata: MTL text and ESPA XML, in one form."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: K1 and K2 of sensors whose files lack them.
THERMAL = {"LANDSAT_4": (671.62, 1284.3), "LANDSAT_5": (607.76, 1260.56), "LANDSAT_7": (666.09, 1282.71)}
_PRODUCTS = {"sr_refl": "sre", "toa_refl": "tre", "toa_bt": "bt", "level1": "dn", "L1T": "dn", "L1TP": "dn", "L1GT": "dn", "L1GS": "dn", "sr_evi": "idx", "spectral_indices": "idx"}
_TYPES = {"INT16": "INT4S", "UINT8": "INT1U", "UINT16": "INT2U"}


@dataclass(frozen=True)
class BandInfo:
    """One band file: name such as B3_dn, its number, what it holds and where."""

    band: str
    number: str
    quantity: str
    category: str
    file: str | None = None
    resolution: float | None = None
    scale: float | None = None
    fill: float | None = None
    saturate: float | None = None
    data_type: str | None = None


@dataclass(frozen=True)
class ImageMetaData:
    """What a scene's metadata tell. Calibrations are (gain, offset) or (K1, K2) by band name."""

    file: str | None = None
    scene: str | None = None
    satellite: str | None = None
    sensor: str | None = None
    acquired: datetime | None = None
    processed: str | None = None
    path: int | None = None
    row: int | None = None
    projection: str | None = None
    sun_azimuth: float | None = None
    sun_elevation: float | None = None
    sun_distance: float | None = None
    bits: int | None = None
    bands: tuple[BandInfo, ...] = ()
    calrad: dict[str, tuple[float, float]] = field(default_factory=dict)
    calref: dict[str, tuple[float, float]] = field(default_factory=dict)
    calbt: dict[str, tuple[float, float]] = field(default_factory=dict)

    def ordered(self) -> ImageMetaData:
        """With the bands by category, number and quantity."""
        place = {"image": 0, "pan": 1, "index": 2, "qa": 3, "aux": 4}
        number = lambda b: (int(m.group()) if (m := re.match(r"\d+", b.number)) else 99, b.number)
        return replace(self, bands=tuple(sorted(self.bands, key=lambda b: (place.get(b.category, 9), number(b), b.quantity, b.band))))

    def select(self, quantity: list[str] | str = "all", category: list[str] | str = "image") -> list[BandInfo]:
        want = lambda x, w: w == "all" or x == w or (not isinstance(w, str) and ("all" in w or x in w))
        return [b for b in self.bands if want(b.quantity, quantity) and want(b.category, category)]

    def summary(self) -> str:
        """A report of the scene, its bands and calibrations."""
        lines = [f"Scene:      {self.scene}", f"Satellite:  {self.satellite}", f"Sensor:     {self.sensor}", f"Date:       {self.acquired:%F}" if self.acquired else "Date:       NA", f"Path/Row:   {self.path}/{self.row}", f"Projection: {self.projection}", "", "Data:"]
        lines += [f"  {b.band:<12} {b.quantity:<5} {b.category:<6} {b.file or ''}" for b in self.bands]
        for name, cal in (("dn -> radiance", self.calrad), ("dn -> reflectance", self.calref), ("dn -> brightness temperature", self.calbt)):
            lines.append(f"Calibration {name}: {'available' if cal else 'missing'}")
        return "\n".join(lines)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The bands and calibrations as DataFrames."""
        cal = lambda d: spark.createDataFrame([(b, *v) for b, v in d.items()], "band string, gain double, offset double")
        data = spark.createDataFrame([tuple(vars(b).values()) for b in self.bands], "band string, number string, quantity string, category string, file string, resolution double, scale double, fill double, saturate double, data_type string")
        return {"data": data, "calrad": cal(self.calrad), "calref": cal(self.calref), "calbt": cal(self.calbt).toDF("band", "k1", "k2")}


def sun_distance(day_of_year: int) -> float:
    """The Earth's distance from the sun in astronomical units, to about 1e-4."""
    return 1 - 0.01672 * math.cos(math.radians(0.9856 * (day_of_year - 4)))


def parse_groups(text: str) -> dict[str, dict[str, str]]:
    """The groups of an MTL text: name -> key -> value."""
    out: dict[str, dict[str, str]] = {}
    stack: list[str] = []
    for line in text.splitlines():
        key, eq, value = (p.strip() for p in line.partition("="))
        if not eq:
            continue
        if key == "GROUP":
            stack.append(value)
        elif key == "END_GROUP":
            stack and stack.pop()
        elif stack:
            out.setdefault(stack[-1], {})[key] = value.strip('"')
    return out


def _number(x: str | None) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _time(day: str | None, clock: str | None) -> datetime | None:
    if not day:
        return None
    m = re.match(r"(\d+):(\d+):(\d+)", clock or "")
    d = datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=timezone.utc)
    return d.replace(hour=int(m[1]), minute=int(m[2]), second=int(m[3])) if m else d


def _bits(satellite: str | None, sensor: str | None) -> int:
    return 16 if satellite == "LANDSAT_8" else 6 if (sensor or "").startswith("MSS") else 8


def _mtl(groups: dict[str, dict[str, str]], file: str | None) -> ImageMetaData:
    flat: dict[str, str] = {}
    for g in groups.values():
        for k, v in g.items():
            flat.setdefault(k, v)
    satellite = (flat.get("SPACECRAFT_ID") or "").upper().replace("LANDSAT-", "LANDSAT_").strip() or None
    if satellite and re.fullmatch(r"LANDSAT\d", satellite):
        satellite = satellite[:7] + "_" + satellite[7:]
    sensor = flat.get("SENSOR_ID")
    acquired = _time(flat.get("DATE_ACQUIRED") or flat.get("ACQUISITION_DATE"), flat.get("SCENE_CENTER_TIME") or flat.get("SCENE_CENTER_SCAN_TIME"))
    bands = []
    for key, name in flat.items():
        m = re.fullmatch(r"(?:FILE_NAME_BAND_|BAND)(\w+?)(?:_FILE_NAME)?", key)
        q = re.fullmatch(r"FILE_NAME_(QUALITY.*|ANGLE\w+BAND\w*|BAND_QUALITY)", key)
        if key.startswith("FILE_NAME_BAND_") and m and key != "FILE_NAME_BAND_QUALITY" or re.fullmatch(r"BAND\d+_FILE_NAME", key):
            number = m[1]
            pan = satellite in ("LANDSAT_7", "LANDSAT_8") and number == "8"
            thermal = re.match(r"10|11", number) if satellite == "LANDSAT_8" else re.match(r"6", number) and "MSS" not in (sensor or "")
            res = flat.get("GRID_CELL_SIZE_PANCHROMATIC" if pan else "GRID_CELL_SIZE_THERMAL" if thermal else "GRID_CELL_SIZE_REFLECTIVE")
            bands.append(BandInfo(f"B{number}_dn", number, "dn", "pan" if pan else "image", name, _number(res)))
        elif q and name.upper().endswith(".TIF"):
            bands.append(BandInfo(f"QA_{q[1].replace('_L1', '').lower()}_dn" if q[1] != "BAND_QUALITY" else "QA_dn", "", "dn", "qa" if "QUALITY" in q[1] else "aux", name))
    bands = list({b.band: b for b in bands}.values())
    image = [b for b in bands if b.category in ("image", "pan")]
    calrad, calref, calbt = {}, {}, {}
    for b in image:
        n = b.number
        for cal, what in ((calrad, "RADIANCE"), (calref, "REFLECTANCE")):
            g, o = _number(flat.get(f"{what}_MULT_BAND_{n}")), _number(flat.get(f"{what}_ADD_BAND_{n}"))
            if g is not None and o is not None:
                cal[b.band] = (g, o)
        if b.band not in calrad:
            hi, lo = (_number(flat.get(f"RADIANCE_{w}_BAND_{n}") or flat.get(f"L{w[:3]}_BAND{n}")) for w in ("MAXIMUM", "MINIMUM"))
            top, low = (_number(flat.get(f"QUANTIZE_CAL_{w}_BAND_{n}") or flat.get(f"QCAL{w}_BAND{n}")) for w in ("MAX", "MIN"))
            if None not in (hi, lo, top, low) and top != low:
                gain = (hi - lo) / (top - low)
                calrad[b.band] = (gain, lo - gain)
        k = _number(flat.get(f"K1_CONSTANT_BAND_{n}")), _number(flat.get(f"K2_CONSTANT_BAND_{n}"))
        if None not in k:
            calbt[b.band] = k
        elif satellite in THERMAL and n.startswith("6") and "MSS" not in (sensor or ""):
            calbt[b.band] = THERMAL[satellite]
    zone = flat.get("UTM_ZONE") or flat.get("ZONE_NUMBER")
    projection = f"+proj=utm +zone={zone} +units=m +datum={flat.get('DATUM', 'WGS84')}" if flat.get("MAP_PROJECTION") == "UTM" else flat.get("MAP_PROJECTION")
    distance = _number(flat.get("EARTH_SUN_DISTANCE"))
    if distance is None and acquired:
        distance = sun_distance(acquired.timetuple().tm_yday)
    return ImageMetaData(
        file, flat.get("LANDSAT_SCENE_ID"), satellite, sensor, acquired, flat.get("PROCESSING_LEVEL") or flat.get("DATA_TYPE") or flat.get("PRODUCT_TYPE"),
        int(x) if (x := _number(flat.get("WRS_PATH"))) is not None else None, int(x) if (x := _number(flat.get("WRS_ROW") or flat.get("STARTING_ROW"))) is not None else None,
        projection, _number(flat.get("SUN_AZIMUTH")), _number(flat.get("SUN_ELEVATION")), distance, _bits(satellite, sensor), tuple(bands), calrad, calref, calbt,
    ).ordered()


def _xml(root: ET.Element, file: str | None) -> ImageMetaData:
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    top = {tag(e): e for e in root}
    glob = {tag(e): e for e in top["global_metadata"]}
    text = lambda k: (glob[k].text or "").strip() if k in glob else None
    satellite, sensor = text("satellite"), text("instrument")
    angles, wrs = glob.get("solar_angles"), glob.get("wrs")
    projection = None
    if "projection_information" in glob:
        p = glob["projection_information"]
        zone = next((e.text for e in p.iter() if tag(e) == "zone_code"), None)
        projection = f"+proj=utm +zone={zone} +units={p.get('units')} +datum={p.get('datum')}" if p.get("projection") == "UTM" else p.get("projection")
    bands = []
    for e in top["bands"]:
        inner = {tag(x): x for x in e}
        quantity = _PRODUCTS.get(e.get("product"), e.get("product"))
        name, category = e.get("name"), e.get("category")
        m = re.search(r"band_?(\d+)", name) or re.fullmatch(r"b(\d+)", name, re.I)
        if category == "image" and m and not re.search(r"solar|sensor|zenith|azimuth", name):
            number, label, cat = m[1], f"B{m[1]}_{quantity}", "image"
            if satellite in ("LANDSAT_7", "LANDSAT_8") and number == "8":
                cat = "pan"
        elif category == "qa" or name.endswith("_qa"):
            number, label, cat = "", f"QA_{name}", "qa"
        else:
            number, label, cat = "", f"AUX_{name}" if category == "image" else name, "aux" if category == "image" else category
        size, limits = inner.get("pixel_size"), inner.get("valid_range")
        bands.append(BandInfo(label, number, quantity, cat, (inner["file_name"].text or "").strip() if "file_name" in inner else None, _number(size.get("x")) if size is not None else None, _number(e.get("scale_factor")), _number(e.get("fill_value")), _number(e.get("saturate_value")) or (_number(limits.get("max")) if limits is not None else None), _TYPES.get(e.get("data_type"), e.get("data_type"))))
    bands = list({b.band: b for b in bands}.values())
    scene = (text("scene_id") or text("product_id") or (Path(file).stem if file else None))
    return ImageMetaData(
        file, scene, satellite, sensor, _time(text("acquisition_date"), text("scene_center_time")), None,
        int(wrs.get("path")) if wrs is not None else None, int(wrs.get("row")) if wrs is not None else None, projection,
        _number(angles.get("azimuth")) if angles is not None else None, 90 - float(angles.get("zenith")) if angles is not None else None,
        _number(text("earth_sun_distance")), _bits(satellite, sensor), tuple(bands),
    ).ordered()


def read_meta(path: str, raw: bool = False) -> ImageMetaData | dict:
    """The metadata of an MTL text or ESPA XML file; raw: its groups as they are."""
    with open(path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    if text.lstrip().startswith("<"):
        root = ET.fromstring(text)
        if raw:
            tag = lambda e: e.tag.rsplit("}", 1)[-1]
            return {tag(part): [{"name": tag(e), **e.attrib, **{tag(x): (x.text or "").strip() or dict(x.attrib) for x in e}, "text": (e.text or "").strip()} for e in part] for part in root}
        return _xml(root, path)
    groups = parse_groups(text)
    if not groups:
        raise ValueError(f"{path} is neither MTL text nor XML")
    return groups if raw else _mtl(groups, path)


def read_many(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, scene, satellite, sensor, acquired, sun_elevation, ...) of the MTL
    files that the pattern matches, read by the executors."""
    from pyspark.sql import functions as F

    t = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file"), "value")
    pick = lambda k: F.regexp_extract("value", rf'(?m)^\s*{k}\s*=\s*"?([^"\r\n]*)"?', 1)
    num = lambda k: pick(k).try_cast("double")
    out = t.select("file", pick("LANDSAT_SCENE_ID").alias("scene"), pick("SPACECRAFT_ID").alias("satellite"), pick("SENSOR_ID").alias("sensor"), pick("DATE_ACQUIRED").try_cast("date").alias("acquired"), num("WRS_PATH").cast("int").alias("path"), num("WRS_ROW").cast("int").alias("row"), num("SUN_AZIMUTH").alias("sun_azimuth"), num("SUN_ELEVATION").alias("sun_elevation"), num("EARTH_SUN_DISTANCE").alias("sun_distance"))
    fallback = F.lit(1.0) - F.lit(0.01672) * F.cos(F.radians((F.dayofyear("acquired") - 4) * 0.9856))
    return out.withColumn("sun_distance", F.coalesce("sun_distance", fallback))


def get_meta(meta: ImageMetaData, bands: list[str], what: str) -> dict:
    """A property (a calibration: calrad, calref, calbt; or one of the bands':
    file, resolution, ...) for each of the image's bands, in their order."""
    if what.lower() in ("calrad", "calref", "calbt"):
        table = getattr(meta, what.lower())
        if not table:
            raise ValueError(f"the metadata have no {what}")
    else:
        if what not in BandInfo.__dataclass_fields__:
            raise ValueError(f"unknown property: {what}")
        table = {b.band: getattr(b, what) for b in meta.bands}
    lacking = [b for b in bands if b not in table]
    if lacking:
        raise ValueError(f"the metadata lack {what} of {lacking}")
    return {b: table[b] for b in bands}


def stack_meta(spark: SparkSession, meta: ImageMetaData, folder: str, quantity: str = "all", category: str = "image", all_resolutions: bool = False) -> dict[float, DataFrame]:
    """The bands' pixel tables joined on ``cell``, by resolution. Band files are
    Parquet tables (cell, value) under ``folder``, named as the band. Of several
    resolutions 30 m is taken, or the finest where there is none of 30 m, unless
    all are asked for."""
    chosen = meta.select(quantity, category)
    if not chosen:
        raise ValueError("no band is of that quantity and category")
    by: dict[float, list[BandInfo]] = {}
    for b in chosen:
        by.setdefault(b.resolution or 30.0, []).append(b)
    if not all_resolutions:
        one = 30.0 if 30.0 in by else min(by)
        by = {one: by[one]}
    out = {}
    for res, bands in by.items():
        df = None
        for b in bands:
            t = spark.read.parquet(f"{folder.rstrip('/')}/{b.band}.parquet").select("cell", "value").withColumnRenamed("value", b.band)
            df = t if df is None else df.join(t, "cell")
        out[res] = df
    return out
