"""A feature table on a shared file system: load, upsert, delete, query, statistics, clear.

Every change writes a whole new version (``v=N``) in cell order and readers take the newest complete one, so a
reader never meets half a change and a lost writer leaves nothing behind that is read.  Older versions go with ``vacuum``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.register import call
from ..operators import frame
from .readers import write_features


class FeatureTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", geom: str = "geom"):
        self.spark, self.path, self.key, self.geom = spark, path.rstrip("/"), key, geom

    # the file system of the path, whatever it is
    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root, jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        fs, root, path = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        """The newest version with its ``bbox`` and ``cell`` columns, or None before the first load."""
        known = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={known[-1]}") if known else None

    def _write(self, df: DataFrame) -> int:
        number = (self.versions() or [0])[-1] + 1
        fs, _, path = self._fs()
        target = f"{self.path}/v={number}"
        fs.delete(path(target), True)  # what a lost writer left
        write_features(df.drop(frame.BOX, frame.CELL), target, self.geom)
        return number

    def load(self, features: DataFrame) -> int:
        """Replaces all features; returns the version."""
        return self._write(features)

    def upsert(self, features: DataFrame) -> int:
        """Features replace those with their key and join the others; of several with one key any one counts."""
        own, old = features.dropDuplicates([self.key]), self.read()
        if old is None:
            return self._write(own)
        kept = old.drop(frame.BOX, frame.CELL).join(own.select(self.key), self.key, "left_anti")
        return self._write(kept.unionByName(own, allowMissingColumns=True))

    def delete(self, keys: DataFrame) -> int | None:
        """Features go whose key stands in the first column of ``keys``."""
        old = self.read()
        if old is None:
            return None
        return self._write(old.join(keys.select(F.col(keys.columns[0]).alias(self.key)), self.key, "left_anti"))

    def query(self, window: bytes, predicate: str = "ST_Intersects", **how) -> DataFrame:
        """Features that satisfy the predicate against the window: cells and boxes at the scan, then the predicate."""
        own = self.read()
        if own is None:
            raise ValueError("the table holds nothing yet")
        return frame.window_query(own, window, predicate, self.geom, **how)

    def stats(self) -> dict:
        """features, version, and the extent as WKT."""
        own = self.read()
        if own is None:
            return {"features": 0, "version": 0, "extent": None}
        corner = lambda f, c: f(f"{frame.BOX}.{c}").alias(c)
        row = own.agg(F.count(F.lit(1)).alias("n"), corner(F.min, "minx"), corner(F.min, "miny"), corner(F.max, "maxx"), corner(F.max, "maxy"))
        row = row.select("n", call("ST_AsText", call("ST_MakeEnvelope", "minx", "miny", "maxx", "maxy")).alias("e")).first()
        return {"features": row["n"], "version": self.versions()[-1], "extent": row["e"]}

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the newest versions."""
        fs, _, path = self._fs()
        for n in self.versions()[:-keep]:
            fs.delete(path(f"{self.path}/v={n}"), True)

    def clear(self) -> None:
        fs, root, _ = self._fs()
        fs.delete(root, True)
