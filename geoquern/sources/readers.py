"""GeoJSON, edge lists, GeoPackage files; storage and tile output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.register import call

GEOJSON_SCHEMA = "type string, features array<struct<type:string,id:string,geometry:string,properties:string>>"


def read_geojson(spark: SparkSession, path: str, srid: int = 4326) -> DataFrame:
    """One row per feature of FeatureCollection files: id, geom, properties (JSON text)."""
    own = spark.read.schema(GEOJSON_SCHEMA).json(path, multiLine=True).select(F.explode("features").alias("f"))
    geom = call("ST_GeomFromGeoJSON", F.col("f.geometry"))
    if srid != 4326:
        geom = call("ST_SetSRID", geom, F.lit(srid))
    return own.select(F.col("f.id").alias("id"), geom.alias("geom"), F.col("f.properties").alias("properties"))


def to_geojson(df: DataFrame, geom: str = "geom", id_col: str | None = None, properties: list[str] | None = None) -> DataFrame:
    """One GeoJSON Feature per row, as text column ``value`` (for ``write.text``: newline-delimited GeoJSON)."""
    props = properties if properties is not None else [c for c in df.columns if c not in (geom, id_col)]
    ident = F.concat(F.lit('"id":'), F.regexp_replace(F.to_json(F.struct(F.col(id_col).alias("v"))), r'^\{"v":(.*)\}$', "$1"), F.lit(",")) if id_col else F.lit("")
    body = F.to_json(F.struct(*props)) if props else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature",'), ident, F.lit('"geometry":'), F.coalesce(call("ST_AsGeoJSON", F.col(geom)), F.lit("null")), F.lit(',"properties":'), body, F.lit("}")).alias("value"))


def read_edges(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Edge lists as CSV: id, source, target, cost and, if there, reverse_cost."""
    return spark.read.csv(path, schema="id bigint, source bigint, target bigint, cost double, reverse_cost double", header=header)


def write_features(df: DataFrame, path: str, geom: str = "geom", partitions: int | None = None) -> None:
    """Feature table as Parquet in cell order, geometries in storage form (with envelope)."""
    from ..operators.frame import prepare

    own = prepare(df.withColumn(geom, call("ST_AsGPB", F.col(geom))), geom)
    own = own.repartitionByRange(partitions, "cell") if partitions else own.repartitionByRange("cell")
    own.sortWithinPartitions("cell").write.parquet(path)


def write_tiles(tiles: DataFrame, path: str, keys: list[str]) -> None:
    """Tiles as Parquet (keys and bytes), clustered by key."""
    tiles.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


# -- GeoPackage ------------------------------------------------------------
class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _GeoPackageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options["table"]
        self.parts = int(options.get("partitions", "8"))

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._connect() as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Rows(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(k, min(high, k + step - 1)) for k in range(low, high + 1, step)]

    def read(self, partition):
        with self._connect() as c:
            yield from c.execute(f'SELECT * FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class GeoPackageSource(DataSource):
    """``spark.read.format("geopackage").option("table", t).load(file)``: a layer of a GeoPackage file,
    read in row ranges.  The file must be reachable under the same path from every executor."""

    @classmethod
    def name(cls):
        return "geopackage"

    def schema(self):
        import sqlite3

        if '"' in self.options["table"]:
            raise ValueError("invalid table name")
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            columns = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
            shapes = {r[0] for r in c.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (self.options["table"],))}

        def kind(name, declared):
            d = declared.upper()
            if name in shapes or "BLOB" in d:
                return "binary"
            if "INT" in d:
                return "bigint"
            return "double" if any(k in d for k in ("REAL", "DOUB", "FLOAT")) else "string"

        return ", ".join(f"`{name}` {kind(name, declared)}" for _, name, declared, *_ in columns)

    def reader(self, schema):
        return _GeoPackageReader(self.options)


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackageSource)
