"""Scene lists exported from a catalogue, as CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = [
    "Landsat.Scene.Identifier", "WRS.Path", "WRS.Row", "Data.Category", "Cloud.Cover", "Station.Identifier", "Day.Night", "Data.Type.Level.1", "Date.Acquired",
    "Sun.Elevation", "Sun.Azimuth", "Geometric.RMSE.Model.X", "Geometric.RMSE.Model.Y", "Display.ID", "Ordering.ID", "Download.Link", "Browse.Link",
]
RENAMED = {"Scene.Cloud.Cover": "Cloud.Cover", "Acquisition.Date": "Date.Acquired", "Day.Night.Indicator": "Day.Night"}


def read_scenes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The 17 columns (missing ones NULL) of one export or several, with Date, Doy,
    Year, Satellite and Num (1)."""
    frames = []
    for p in [paths] if isinstance(paths, str) else paths:
        df = spark.read.csv(p, header=True, encoding="ISO-8859-1")
        names = {}
        for c in df.columns:
            n = "".join(x if x.isalnum() else "." for x in c.strip()).strip(".")
            names[RENAMED.get(n, n)] = c
        frames.append(df.select(*[(F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")).alias(c.replace(".", "_")) for c in COLUMNS]))
    df = reduce(DataFrame.unionByName, frames)
    day = F.coalesce(F.expr("try_to_timestamp(Date_Acquired, 'yyyy/MM/dd')"), F.expr("try_to_timestamp(Date_Acquired, 'yyyy-MM-dd')")).cast("date")
    return df.withColumn("Date", day).withColumn("Doy", F.dayofyear("Date")).withColumn("Year", F.year("Date")).withColumn("Satellite", F.concat(F.lit("LS"), F.substring("Landsat_Scene_Identifier", 3, 1))).withColumn("Num", F.lit(1))
