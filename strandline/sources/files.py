"""File sources and sinks: separated values after a line filter, GeoJSON, rasters as tables, fingerprinted caches, CSV by city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import shared_dir


def separated(spark: SparkSession, path: str, columns: list[str], keep: str = ".*", sep: str = "|") -> DataFrame:
    """String columns of the lines that match `keep` (a regular expression); missing fields are null."""
    lines = spark.read.text(path).where(F.col("value").rlike(keep))
    part = F.split("value", f"\\Q{sep}\\E", -1)
    return lines.select(*[F.get(part, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def geojson(spark: SparkSession, path: str, properties: str, coordinates: str = "array<array<double>>") -> DataFrame:
    """properties (fields of the DDL), kind and coordinates of each feature of GeoJSON files."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: {coordinates}>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def features(df: DataFrame, properties: list[str], coordinates: str, kind: str = "LineString") -> DataFrame:
    """One JSON text a row: the feature of its properties and coordinates; features() lines joined make a collection."""
    geometry = F.struct(F.lit(kind).alias("type"), F.col(coordinates).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return df.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value"))


def sampled(points: DataFrame, raster: DataFrame, x0: float, y0: float, cell: float, nodata: float) -> DataFrame:
    """points (x, y, ...) with value: that of the raster cell (row, col, v) they lie in; nodata, negative and missing are 0."""
    keyed = points.withColumn("col", F.floor((F.col("x") - x0) / cell)).withColumn("row", F.floor((F.col("y") - y0) / cell))
    value = F.when(F.col("v") == nodata, 0.0).otherwise(F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0)))
    cells = raster.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), F.col("v").cast("double"))
    return keyed.join(cells, ["row", "col"], "left").withColumn("value", F.coalesce(value, F.lit(0.0))).drop("row", "col", "v")


def max_normalised(c: str) -> Column:
    """A column over its greatest value; 0 where that is 0."""
    from pyspark.sql import Window

    top = F.max(c).over(Window.partitionBy(F.lit(0)))
    return F.when(top > 0, F.col(c) / top).otherwise(0.0)


def cached(spark: SparkSession, name: str, fingerprint: str, build) -> DataFrame:
    """The stored table of (name, fingerprint) in the shared folder; build() makes it if there is none."""
    path = f"{shared_dir(spark)}/strandline-cache/{name}/{fingerprint}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Length and modification time of a file or folder's files, as one text."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(p)
    return "-".join(f"{s.getModificationTime():x}{s.getLen():x}" for s in sorted(found, key=lambda s: s.getPath().toString()))


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header, a folder for each value of `by`; only folders that df has are replaced."""
    writer = df.write.mode("overwrite").option("header", True).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(by) if by else writer).csv(path)
