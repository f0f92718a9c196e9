"""Metadata, libraries, scene lists, stored models, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import indices
from pixelloom.grid import GridSpec
from pixelloom.operators import classify, transform
from pixelloom.sources import metadata, scenes, sli, store
from pixelloom.streaming import scoring

MTL = """GROUP = L1_METADATA_FILE
  GROUP = METADATA_FILE_INFO
    LANDSAT_SCENE_ID = "LC81950252013188LGN01"
  END_GROUP = METADATA_FILE_INFO
  GROUP = PRODUCT_METADATA
    SPACECRAFT_ID = "LANDSAT_8"
    SENSOR_ID = "OLI_TIRS"
    WRS_PATH = 195
    WRS_ROW = 25
    DATE_ACQUIRED = 2013-07-07
    SCENE_CENTER_TIME = "10:17:42.1234567Z"
    FILE_NAME_BAND_1 = "X_B1.TIF"
    FILE_NAME_BAND_10 = "X_B10.TIF"
    FILE_NAME_BAND_8 = "X_B8.TIF"
    FILE_NAME_BAND_2 = "X_B2.TIF"
    FILE_NAME_BAND_QUALITY = "X_BQA.TIF"
  END_GROUP = PRODUCT_METADATA
  GROUP = IMAGE_ATTRIBUTES
    SUN_AZIMUTH = 149.5
    SUN_ELEVATION = 58.99675180
  END_GROUP = IMAGE_ATTRIBUTES
  GROUP = RADIOMETRIC_RESCALING
    RADIANCE_MULT_BAND_1 = 1.2147E-02
    RADIANCE_ADD_BAND_1 = -60.7
    REFLECTANCE_MULT_BAND_1 = 2.0000E-05
    REFLECTANCE_ADD_BAND_1 = -0.100000
  END_GROUP = RADIOMETRIC_RESCALING
  GROUP = MIN_MAX
    RADIANCE_MAXIMUM_BAND_2 = 700.0
    RADIANCE_MINIMUM_BAND_2 = -10.0
    QUANTIZE_CAL_MAX_BAND_2 = 255
    QUANTIZE_CAL_MIN_BAND_2 = 1
  END_GROUP = MIN_MAX
  GROUP = TIRS_THERMAL_CONSTANTS
    K1_CONSTANT_BAND_10 = 774.8853
    K2_CONSTANT_BAND_10 = 1321.08
  END_GROUP = TIRS_THERMAL_CONSTANTS
  GROUP = PROJECTION_PARAMETERS
    MAP_PROJECTION = "UTM"
    UTM_ZONE = 32
    DATUM = "WGS84"
    GRID_CELL_SIZE_PANCHROMATIC = 15.00
    GRID_CELL_SIZE_REFLECTIVE = 30.00
    GRID_CELL_SIZE_THERMAL = 30.00
  END_GROUP = PROJECTION_PARAMETERS
END_GROUP = L1_METADATA_FILE
END
"""
XML = """<?xml version="1.0"?><espa_metadata xmlns="http://espa.cr.usgs.gov/v2"><global_metadata><satellite>LANDSAT_7</satellite><instrument>ETM</instrument>
<acquisition_date>2011-04-16</acquisition_date><scene_center_time>06:35:23.67Z</scene_center_time><solar_angles zenith="36.5" azimuth="143.6"/><earth_sun_distance>1.0034</earth_sun_distance><wrs system="2" path="160" row="31"/>
<projection_information projection="UTM" datum="WGS84" units="meters"><utm_proj_params><zone_code>40</zone_code></utm_proj_params></projection_information></global_metadata>
<bands><band product="sr_refl" name="sr_band3" category="image" data_type="INT16" fill_value="-9999" saturate_value="20000" scale_factor="0.0001"><file_name>a3.tif</file_name><pixel_size x="30" y="30"/></band>
<band product="sr_refl" name="sr_band1" category="image" data_type="INT16" scale_factor="0.0001"><file_name>a1.tif</file_name><pixel_size x="30" y="30"/></band>
<band product="level2_qa" name="pixel_qa" category="qa" data_type="UINT16"><file_name>q.tif</file_name></band></bands></espa_metadata>"""


def test_mtl(tmp_path, spark):
    p = tmp_path / "X_MTL.txt"
    p.write_text(MTL)
    m = metadata.read_meta(str(p))
    assert (m.satellite, m.sensor, m.path, m.row, m.bits, m.sun_elevation) == ("LANDSAT_8", "OLI_TIRS", 195, 25, 16, 58.9967518)
    assert m.acquired.isoformat() == "2013-07-07T10:17:42+00:00" and m.sun_distance == pytest.approx(1.0167, abs=2e-4)
    assert [b.band for b in m.bands] == ["B1_dn", "B2_dn", "B10_dn", "B8_dn", "QA_dn"] and m.bands[3].category == "pan" and m.bands[3].resolution == 15
    assert m.calrad["B1_dn"] == (1.2147e-2, -60.7) and m.calref == {"B1_dn": (2e-5, -0.1)} and m.calbt == {"B10_dn": (774.8853, 1321.08)}
    gain = 710 / 254
    assert m.calrad["B2_dn"] == pytest.approx((gain, -10 - gain))
    assert "LANDSAT_8" in m.summary() and len(metadata.read_meta(str(p), raw=True)) >= 2
    assert metadata.get_meta(m, ["B2_dn", "B1_dn"], "resolution") == {"B2_dn": 30.0, "B1_dn": 30.0}
    for bands, what in ((["B9_dn"], "file"), (["B1_dn"], "nope"), (["B2_dn"], "calref")):
        with pytest.raises(ValueError):
            metadata.get_meta(m, bands, what)
    assert {k: v.count() for k, v in m.frames(spark).items()} == {"data": 5, "calrad": 2, "calref": 1, "calbt": 1}
    many = metadata.read_many(spark, f"{tmp_path}/*_MTL.txt").first()
    assert (many.scene, many.path, many.sun_elevation) == ("LC81950252013188LGN01", 195, 58.9967518) and many.sun_distance == pytest.approx(m.sun_distance)


def test_xml(tmp_path):
    p = tmp_path / "a.xml"
    p.write_text(XML)
    m = metadata.read_meta(str(p))
    assert [b.band for b in m.bands] == ["B1_sre", "B3_sre", "QA_pixel_qa"] and m.sun_elevation == 53.5 and (m.path, m.row, m.bits) == (160, 31, 8)
    assert m.bands[1].saturate == 20000 and m.bands[1].data_type == "INT4S" and not m.calrad
    assert set(metadata.read_meta(str(p), raw=True)) == {"global_metadata", "bands"}
    (tmp_path / "b.txt").write_text("nothing")
    with pytest.raises(ValueError):
        metadata.read_meta(str(tmp_path / "b.txt"))


def test_stack(tmp_path, spark):
    p = tmp_path / "X_MTL.txt"
    p.write_text(MTL)
    m = metadata.read_meta(str(p))
    for b in ("B1_dn", "B2_dn", "B10_dn", "B8_dn"):
        spark.range(1, 5).select(F.col("id").alias("cell"), (F.col("id") * len(b)).cast("double").alias("value")).write.parquet(f"{tmp_path}/{b}.parquet")
    out = metadata.stack_meta(spark, m, str(tmp_path))
    assert list(out) == [30.0] and out[30.0].columns == ["cell", "B1_dn", "B2_dn", "B10_dn"] and out[30.0].count() == 4
    assert set(metadata.stack_meta(spark, m, str(tmp_path), category=["image", "pan"], all_resolutions=True)) == {30.0, 15.0}
    with pytest.raises(ValueError):
        metadata.stack_meta(spark, m, str(tmp_path), quantity="sre")


@pytest.mark.parametrize("mode,endian", [("bin", "little"), ("bin", "big"), ("ASCII", "little")])
def test_sli_round_trip(tmp_path, spark, mode, endian):
    rows = [(350.0 + i, 0.01 * i, 0.5 - 0.02 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "wavelength double, veg_stressed double, veg_vital double")
    path = str(tmp_path / "lib.sli")
    sli.write_sli(df, path, mode=mode, endian=endian)
    back = sli.read_sli(spark, path)
    assert back.columns == df.columns
    assert np.allclose([tuple(r) for r in back.orderBy("wavelength").collect()], rows, atol=1e-9)


def test_sli_headers_and_float32(tmp_path, spark):
    p = tmp_path / "a.sli"
    p.write_bytes(np.array([[1.5, 2.5], [3.5, 4.5]], ">f4").tobytes())
    (tmp_path / "a.sli.hdr").write_text("ENVI\nsamples = 2\nlines   = 2\ndata type = 4\nbyte order = 1\nspectra names = {\n spectrum a, \nspectrum_b}\nwavelength = {\n 350, 351}\n")
    back = sli.read_sli(spark, str(p))
    assert back.columns == ["wavelength", "spectrum_a", "spectrum_b"] and [tuple(r) for r in back.collect()] == [(350, 1.5, 3.5), (351, 2.5, 4.5)]
    (tmp_path / "b.sli").write_bytes(bytes([200, 201]))
    with pytest.raises(ValueError):
        sli.read_sli(spark, str(tmp_path / "b.sli"))


def test_scene_lists(tmp_path, spark):
    (tmp_path / "a.csv").write_bytes("Landsat Scene Identifier,WRS Path,Acquisition Date,Scene Cloud Cover\nLC81930242013001LGN00,193,2013/01/01,12.5\nLT5é,1,bad,\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("Landsat Scene Identifier,Date Acquired,Browse Link\nLE71930242000060LGN00,2000/02/29,http://x\n")
    df = scenes.read_scenes(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert len(df.columns) == 17 + 5
    r = {x.Landsat_Scene_Identifier[:3]: x for x in df.collect()}
    assert (r["LC8"].Doy, r["LC8"].Year, r["LC8"].Satellite, r["LC8"].Num, r["LC8"].Cloud_Cover) == (1, 2013, "LS8", 1, "12.5")
    assert r["LE7"].Doy == 60 and r["LE7"].Browse_Link == "http://x" and r["LE7"].WRS_Path is None and r["LT5"].Date is None


def test_store(tmp_path, spark):
    df = spark.createDataFrame([(i // 6, i % 6, float(i % 3), float(i), "ab"[i % 2], i) for i in range(36)], "row int, col int, u double, v double, response string, feature int")
    m, out = transform.raster_pca(df, ["u", "v"], ["row", "col"])
    store.save(m, str(tmp_path / "pca"), out)
    back, map_ = store.load(spark, str(tmp_path / "pca"))
    assert np.allclose(back.loadings, m.loadings) and map_.exceptAll(out).count() == 0
    for model in ("dt", "mlc"):
        s = classify.fit(df, ["u", "v"], model, tune_length=1, k_folds=2)
        store.save(s, str(tmp_path / model))
        with pytest.warns(UserWarning):
            again, none = store.load(spark, str(tmp_path / model))
        assert none is None and again.classes == s.classes and again.predict(df).exceptAll(s.predict(df)).count() == 0
    k, _ = classify.unsupervised(df, ["u", "v"], 2, 1)
    store.save(k, str(tmp_path / "k"), out)
    assert store.load(spark, str(tmp_path / "k"))[0] == k


def test_streams(tmp_path, spark):
    for i in range(3):
        spark.createDataFrame([(i * 10 + j, float(j), float(i + 1)) for j in range(5)], "cell int, red double, nir double").write.mode("append").parquet(f"{tmp_path}/in")
    stream = scoring.pixel_stream(spark, f"{tmp_path}/in", "cell int, red double, nir double", 1)
    op = lambda df: indices.spectral_indices(df, {"red": "red", "nir": "nir"}, ["NDVI"], ["cell"])
    q = scoring.score(stream, op, f"{tmp_path}/out", f"{tmp_path}/check", once=True)
    q.awaitTermination(120)
    table = op(spark.read.parquet(f"{tmp_path}/in"))
    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(table).count() == 0 and spark.read.parquet(f"{tmp_path}/out").count() == 15
    with pytest.raises(ValueError):
        scoring.score(stream, lambda df: table, f"{tmp_path}/o2", f"{tmp_path}/c2")


def test_sun_distance():
    assert metadata.sun_distance(4) == pytest.approx(0.98328) and metadata.sun_distance(186) == pytest.approx(1.0167, abs=1e-4) and math.isclose(GridSpec(1, 1).extent[1], 1)
