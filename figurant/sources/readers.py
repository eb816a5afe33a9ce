"""Images, pixel tables and dictionaries as relations; failures are rows, not errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figurant.config import DEFAULT, Config


def images(spark: SparkSession, folder: str) -> DataFrame:
    """fig_id, path, width, height, channels, data, error of the files in ``folder`` (not
    below it). Files that can't be decoded keep a row with an error and no size."""
    read = spark.read.format("image").option("dropInvalid", False).load(folder)
    i = F.col("image")
    bad = (i["width"] <= 0) | i["width"].isNull()
    name = F.regexp_extract(i["origin"], r"([^/]+?)(?:\.[^./]*)?$", 1)
    return read.select(
        name.alias("fig_id"), i["origin"].alias("path"), F.when(~bad, i["width"]).alias("width"), F.when(~bad, i["height"]).alias("height"),
        F.when(~bad, i["nChannels"]).alias("channels"), F.when(~bad, i["data"]).alias("data"), F.when(bad, F.lit("not an image that can be decoded")).alias("error"),
    )


def with_scale(figures: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds ``scaling_factor``, which brings the smaller side to the working resolution."""
    return figures.withColumn("scaling_factor", F.lit(float(config.working_dimension)) / F.least("width", "height"))


def gray_pixels(figures: DataFrame) -> DataFrame:
    """fig_id, y, x, v: a row per pixel (channels are stored blue, green, red)."""
    k = F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)
    p = figures.where("error is null").select("fig_id", "width", "channels", F.col("data"), F.explode(k).alias("k"))
    byte = lambda c: F.conv(F.hex(F.substr("data", F.col("k") * F.col("channels") + c + 1, F.lit(1))), 16, 10).cast("int")
    gray = F.when(F.col("channels") == 1, byte(0)).otherwise(F.rint(0.114 * byte(0) + 0.587 * byte(1) + 0.299 * byte(2)).cast("int"))
    return p.select("fig_id", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).cast("int").alias("x"), gray.alias("v"))


def dictionary(spark: SparkSession, path: str, separators: str = "") -> DataFrame:
    """value, position of a text dictionary: an entry per line, or also per separator (a regex
    class body). Empty entries are left out."""
    lines = spark.read.text(path, wholetext=True)
    parts = F.split("value", f"[\n{separators}]")
    return lines.select(F.posexplode(parts).alias("position", "value")).where("value <> ''").select("value", "position")


def species_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return dictionary(spark, path)


def superatom_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return dictionary(spark, path, " ")
