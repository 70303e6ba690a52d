"""Projects on a shared file system: tiles, documents, the registry and exports, through Spark's readers and Hadoop's file API."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .. import schema
from ..functions import keys as K
from ..operators.documents import normalize_document
from . import codecs


class _Fs:
    """Hadoop's file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, path: str) -> bool:
        return self.fs.delete(self.path(path), True)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))


class TileFiles(DataSource):
    """Writes rows (path, data) as one file each below `root`: df.write.format('tile_files').option('root', ...).

    `root` is a URI of any file system that Arrow opens (file, hdfs, s3, gs), or a path that executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def writer(self, schema, overwrite):
        return _TileWriter(self.options["root"])


class _TileWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows):
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.root)
        for row in rows:
            path = f"{base}/{row['path']}"
            files.create_dir(path.rpartition("/")[0], recursive=True)
            part = f"{path}.part-{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(bytes(row["data"]))
            files.move(part, path)  # a repeated task leaves whole files only
        return WriterCommitMessage()


class Store:
    """The projects below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.fs = spark, root.rstrip("/"), _Fs(spark, root)

    def at(self, project: str, *rest: str) -> str:
        return "/".join([self.root, project, *rest])

    # tiles

    def write_tiles(self, project: str, tiles: DataFrame) -> None:
        """Tiles (d, y, x, data) as Parquet laid out by depth and row; only the partitions that occur are replaced."""
        rows = tiles.repartition("d", "y").withColumn("part_d", F.col("d")).withColumn("part_y", F.col("y"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_d", "part_y").parquet(self.at(project, "tiles"))

    def read_tiles(self, project: str) -> DataFrame:
        """All tiles; filters on d and y prune folders when put on part_d and part_y."""
        return self.spark.read.parquet(self.at(project, "tiles"))

    def read_tile(self, project: str, x: int, y: int, d: int, tiles_per_side: int) -> DataFrame:
        """One tile; a key outside the pyramid is an error."""
        side = tiles_per_side >> d if 0 <= d <= K.max_depth(tiles_per_side) else 0
        if not (0 <= x < side and 0 <= y < side):
            raise ValueError(f"Invalid tile key d{d}/y{y}/x{x}.")
        return self.read_tiles(project).where((F.col("part_d") == d) & (F.col("part_y") == y) & (F.col("x") == x))

    def write_raw(self, project: str, tiles: DataFrame) -> None:
        """Tiles as raw files tiles/d*/y*/x*.r16."""
        self.spark.dataSource.register(TileFiles)
        rows = tiles.select(K.tile_path(F.col("x"), F.col("y"), F.col("d")).alias("path"), "data")
        rows.write.format("tile_files").option("root", self.at(project)).mode("append").save()

    def read_raw(self, project: str, extension: str = "r16") -> DataFrame:
        """Raw tile files as d, y, x, data; the key comes from the path."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(self.at(project, "tiles"))
        part = lambda i: F.regexp_extract("path", rf"d(\d+)/y(\d+)/x(\d+)\.{extension}$", i).cast("int")
        return files.select(part(1).alias("d"), part(2).alias("y"), part(3).alias("x"), F.col("content").alias("data"))

    def export_png(self, project: str, target: str, tile_size: int) -> None:
        """The whole pyramid as 16-bit PNG files, and the config, in another folder of the store."""
        self.spark.dataSource.register(TileFiles)
        tiles = codecs.as_png(self.read_tiles(project), tile_size)
        rows = tiles.select(K.tile_path(F.col("x"), F.col("y"), F.col("d"), "png").alias("path"), "data")
        rows.write.format("tile_files").option("root", self.at(target)).mode("append").save()
        self.fs.write(self.at(target, "world.config.json"), json.dumps(self.read_config(project)))

    # documents

    def _text(self, path: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect())

    def write_config(self, project: str, config: dict) -> None:
        self.fs.write(self.at(project, "world.config.json"), json.dumps(config))

    def read_config(self, project: str) -> dict:
        """The config with older names and missing water filled in; a missing or broken one is an error."""
        raw = json.loads(self._text(self.at(project, "world.config.json")))
        first = next((raw[k] for k in ("worldHeight", "maxElevation") if raw.get(k) is not None), 1024)
        water = raw.get("water") or {}
        level = water.get("level")
        return raw | {"worldHeight": first, "water": {"visible": bool(water.get("visible")), "level": level if isinstance(level, (int, float)) else 0}}

    def write_document(self, project: str, document: dict) -> None:
        """Saves a document under its own world's id, as version 1."""
        self.fs.write(self.at(project, "authoring.json"), json.dumps(document | {"version": 1, "worldId": project}))

    def read_document(self, project: str) -> dict:
        """The document, well-formed whatever the file holds; a missing or broken one is the empty document."""
        path = self.at(project, "authoring.json")
        if not self.fs.exists(path):
            return normalize_document(None, project)
        try:
            return normalize_document(json.loads(self._text(path)), project)
        except json.JSONDecodeError:
            return normalize_document(None, project)

    # registry

    def projects(self) -> DataFrame:
        """id, name, updatedAt, path of all projects, newest first; without a readable registry, none."""
        path = f"{self.root}/registry.json"
        if not self.fs.exists(path):
            return self.spark.createDataFrame([], schema.REGISTRY)
        return self.spark.read.schema(schema.REGISTRY).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("updatedAt"))

    def _save(self, rows: DataFrame) -> None:
        found = [json.dumps(r.asDict()) for r in rows.collect()]  # one line per project of the editor
        self.fs.write(f"{self.root}/registry.json", "\n".join(found))

    def register(self, project: str, name: str, updated: str) -> None:
        """The project's row in place of its former one, and the project as the last one opened."""
        new = self.spark.createDataFrame([(project, name, updated, self.at(project))], schema.REGISTRY)
        self._save(upsert(self.projects(), new, "id"))
        self.fs.write(f"{self.root}/last", project)

    def open_last(self) -> dict | None:
        """The config of the project opened last; a pointer that leads nowhere is cleared."""
        path = f"{self.root}/last"
        if not self.fs.exists(path):
            return None
        project = self._text(path).strip()
        if not self.fs.exists(self.at(project, "world.config.json")):
            self.fs.delete(path)
            return None
        return self.read_config(project)

    def delete(self, project: str) -> None:
        """The project's files, if there are any, and its row."""
        self.fs.delete(self.at(project))
        self._save(self.projects().where(F.col("id") != project))


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows whose key it does not have."""
    return new.unionByName(rows.join(new.select(key), key, "left_anti"))


def boolean_setting(spark: SparkSession, name: str, fallback: bool) -> bool:
    """A setting of the session read as a boolean; anything but true and false is the fallback."""
    return {"true": True, "false": False}.get(str(spark.conf.get(name, "")), fallback)


def io_means(log: DataFrame) -> DataFrame:
    """kind, mean_ms of a log of tile reads and writes (kind, ms); 0 for a kind without a time."""
    return log.groupBy("kind").agg(F.coalesce(F.avg("ms"), F.lit(0.0)).alias("mean_ms"))
