"""ENVI spectral libraries: binary with a header, or ASCII."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def parse_header(text: str) -> dict[str, str]:
    """Fields of an ENVI header; braces may span lines and are left out."""
    return {k.strip().lower(): v.strip() for k, v in re.findall(r"(?m)^[ \t]*([^=\n{}]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)", text)} if text else {}


def _list(value: str | None) -> list[str]:
    return [x.strip() for x in value.strip("{} \n").split(",") if x.strip()] if value else []


def _names(labels: list[str]) -> list[str]:
    return [re.sub(r"\s+", "_", n.strip()) for n in labels]


def read_sli_array(path: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(wavelengths, names, spectra as columns)."""
    raw = Path(path).read_bytes()
    header = Path(path + ".hdr") if Path(path + ".hdr").exists() else Path(path).with_suffix(".hdr")
    if header.exists():
        h = parse_header(header.read_text(encoding="latin-1"))
        n, k = int(h["samples"]), int(h["lines"])
        kind = {"4": "f4", "5": "f8"}.get(h.get("data type", "5"))
        if kind is None:
            raise ValueError(f"data type {h['data type']} isn't float32 or float64")
        a = np.frombuffer(raw, (">" if h.get("byte order", "0") == "1" else "<") + kind, n * k, int(h.get("header offset", 0)))
        waves = np.array([float(x) for x in _list(h.get("wavelength"))]) if "wavelength" in h else np.arange(1.0, n + 1)
        names = _names(_list(h.get("spectra names"))) or [f"spectrum_{i + 1}" for i in range(k)]
        return waves, names, a.astype(float).reshape(k, n).T
    if max(raw[:4096] or b"\0") > 128:
        raise ValueError(f"{path} is binary but has no header")
    labels, rows = [], []
    for line in raw.decode("ascii").splitlines():
        parts = line.split()
        try:
            rows.append([float(x) for x in parts])
        except ValueError:
            m = re.match(r"\s*Column \d+: (.*?)(?:~~.*)?$", line)
            if m:
                labels.append(m[1].strip())
    rows = [r for r in rows if r]
    a = np.array(rows)
    names = _names(labels[1:]) if len(labels) == a.shape[1] else _names(labels) if len(labels) == a.shape[1] - 1 else [f"spectrum_{i}" for i in range(1, a.shape[1])]
    return a[:, 0], names, a[:, 1:]


def read_sli(spark: SparkSession, path: str) -> DataFrame:
    """wavelength and a column for each spectrum."""
    w, names, s = read_sli_array(path)
    schema = ", ".join(["wavelength double", *[f"`{n}` double" for n in names]])
    return spark.createDataFrame([(float(a), *map(float, r)) for a, r in zip(w, s)], schema)


def write_sli(df: DataFrame, path: str, units: str = "Nanometers", scale: float = 1, mode: str = "bin", endian: str = "little") -> None:
    """Writes a library (small by nature) and its header: wavelength first, then spectra."""
    rows = df.orderBy("wavelength").collect()
    names = [c for c in df.columns if c != "wavelength"]
    w, s = [r["wavelength"] for r in rows], np.array([[r[n] for n in names] for r in rows], float)
    if mode == "ASCII":
        lines = ["ENVI ASCII Plot File", f"Column 1: wavelength {units}", *[f"Column {i + 2}: {n}~~{i + 1}" for i, n in enumerate(names)]]
        Path(path).write_text("\n".join(lines + [" ".join([f"{a:.6f}", *[repr(float(x)) for x in r]]) for a, r in zip(w, s)]) + "\n")
        return
    if mode != "bin":
        raise ValueError("mode is bin or ASCII")
    Path(path).write_bytes(s.T.astype((">" if endian == "big" else "<") + "f8").tobytes())
    fields = {
        "samples": len(w), "lines": len(names), "bands": 1, "header offset": 0, "file type": "ENVI Spectral Library", "data type": 5, "interleave": "bsq",
        "byte order": int(endian == "big"), "wavelength units": units, "reflectance scale factor": scale, "spectra names": "{" + ", ".join(names) + "}", "wavelength": "{" + ", ".join(repr(float(x)) for x in w) + "}",
    }
    Path(path + ".hdr").write_text("ENVI\n" + "\n".join(f"{k} = {v}" for k, v in fields.items()) + "\n")
