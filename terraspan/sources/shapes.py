"""Land outlines from GeoJSON and models from JSON, and their sinks."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from ..operators import curves
from .staged import StagedWriter

RESOLUTIONS = ("110m", "50m")
GEOJSON = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
MODEL = "name string, positions array<double>, faces array<int>, colors array<int>"


def check_resolution(resolution: str) -> str:
    if resolution not in RESOLUTIONS:
        raise ValueError(f"resolution must be one of {', '.join(RESOLUTIONS)}, not {resolution}")
    return resolution


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``(polygon_id, ring_id, idx, lon, lat)`` of a feature collection's polygons, multi-polygons taken apart, in file order."""
    parts = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.posexplode("features").alias("_f", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygon, multi = (F.from_json(text, "array<" * d + "double" + ">" * d) for d in (3, 4))
    each = parts.select("_f", F.posexplode(F.when(kind == "Polygon", F.array(polygon)).when(kind == "MultiPolygon", multi)).alias("_p", "p"))
    rings = each.select(F.struct("_f", "_p").alias("polygon_id"), F.posexplode("p").alias("ring_id", "r"))
    points = rings.select("polygon_id", "ring_id", F.posexplode("r").alias("idx", "at"))
    return points.select("polygon_id", "ring_id", "idx", F.col("at")[0].alias("lon"), F.col("at")[1].alias("lat"))


def write_outlines(points: DataFrame, path: str, places: int = 2) -> DataFrame:
    """Writes cleaned rings as Parquet; returns their counts."""
    curves.clean_rings(points, places).write.mode("overwrite").parquet(path)
    return curves.ring_counts(points.sparkSession.read.parquet(path))


def read_models(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(vertices, faces, faults)`` of model files, a model a file or (``lines``) a line; a fault is a list that isn't in triples or colours that don't fit the faces."""
    raw = spark.read.schema(MODEL).json(path, multiLine=not lines).withColumn("model", F.coalesce("name", F.lit("model")))
    triples = lambda c: F.transform(F.sequence(F.lit(0), F.greatest((F.size(c) / 3).cast("int") - 1, F.lit(0))), lambda i: F.slice(c, i * 3 + 1, 3))
    vertices = raw.select("model", F.posexplode(triples("positions")).alias("i", "p")).select("model", "i", *(F.col("p")[k].alias(n) for k, n in enumerate("xyz")))
    pairs = raw.select("model", F.posexplode(F.arrays_zip(triples("faces").alias("face"), triples("colors").alias("colour"))).alias("f", "t"))
    faces = pairs.select("model", "f", *(F.get("t.face", F.lit(k)).alias(n) for k, n in enumerate("abc")), *(F.get("t.colour", F.lit(k)).alias(n) for k, n in enumerate(("r", "g", "bl"))))
    fault = F.when(F.size("faces") % 3 != 0, "faces are not triples").when(F.size("colors") != F.size("faces"), "colours don't fit the faces").when(F.coalesce(F.array_max("faces"), F.lit(-1)) >= F.size("positions") / 3, "index out of range")
    return vertices, faces, raw.withColumn("fault", fault).filter("fault is not null").select("model", "fault")


class ModelWriter(StagedWriter):
    """A ``<name>.json`` a row ``(name, content)``."""

    def parts(self, rows):
        for r in rows:
            yield f"{quote(r['name'], safe='')}.json", iter([r["content"].encode()])


class ModelSource(DataSource):
    """The sink of model files, from ``(name, content)``; they are read by ``read_models``."""

    @classmethod
    def name(cls) -> str:
        return "models"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> ModelWriter:
        return ModelWriter(self.options["path"], overwrite)


def write_models(vertices: DataFrame, faces: DataFrame, path: str, places: int = 4) -> None:
    """A JSON file a model, coordinates rounded; files appear when all are written, in place of what is there."""
    flat = lambda order, *c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.array(*c).alias("v")))), lambda s: s["v"]))
    v = vertices.groupBy("model").agg(flat("i", *(F.round(c, places) for c in "xyz")).alias("positions"))
    f = faces.groupBy("model").agg(flat("f", "a", "b", "c").alias("faces"), flat("f", "r", "g", "bl").alias("colors"))
    whole = v.join(f, "model").select(F.col("model").alias("name"), F.to_json(F.struct(F.col("model").alias("name"), "positions", "faces", "colors")).alias("content"))
    vertices.sparkSession.dataSource.register(ModelSource)
    whole.write.format("models").mode("overwrite").save(path)
