"""What the operators share: a shared scratch folder, materialized steps, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: A key is hot if it has more than one part in HOT of all rows; so fewer than HOT keys are.
HOT = 256
#: Rows up to which a side that has at most one of them a key is broadcast whole.
SMALL = 1 << 16


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master (tests) may go without that setting; then a temporary folder serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="orogen-")
    return _LOCAL[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing reads any more, so that scratch does not add up over the steps."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def hot_join(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with counted: one row per key, n: how many of the rows have that key.

    total: the number of rows, or more. counted has no more, so up to SMALL it is broadcast. Beyond that, fewer than
    HOT keys can hold more than one part in HOT of the rows; those are broadcast, so that the rows of a hot
    key stay where they are, and the other keys meet by shuffle. All ways give the same rows. Keys must not
    be null, but for a left join.
    """
    if total <= SMALL:
        return rows.join(F.broadcast(counted), keys, how)
    over = (F.col(n) * HOT > total) & (F.col(n) > HOT)  # a few rows are no burden, whatever their share
    found = counted.where(over).collect()  # fewer than HOT rows
    if not found:
        return rows.join(counted, keys, how)
    hot = rows.sparkSession.createDataFrame(found, counted.schema)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counted.where(~over), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def cells_for(rows: int, least: int = 256) -> int:
    """Cells that number or sum rows in parallel: about 65,536 rows in one, so that windows do not grow with the table."""
    return max(least, rows >> 16)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller ones, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b (long). Returns node, component (the smallest node reached) for every node
    that has an edge to another. Rows with a null end or a = b are ignored. Each round is two
    aggregations and two joins over the edges; rounds grow with the logarithm of the longest path, and the
    last is the one that leaves stars alone. The edges of a star's centre are not gathered in one task: its
    minimum is broadcast to them.
    """
    e = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    n = F.count(F.lit(1)).alias("n")
    while True:
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = e.unionByName(turned).groupBy("u").agg(F.min("v").alias("m"), n, F.count_if(F.col("v") < F.col("u")).alias("lower"))
        low = materialize(low, label)
        # in a star the centre has no lower neighbour, and the others have no neighbour but the centre
        if not low.agg(F.max((F.col("lower") > 0) & (F.col("n") > 1))).first()[0]:
            discard(low)
            break
        large = hot_join(turned, low.select("u", F.least("u", "m").alias("m"), "n"), ["u"], 2 * e.count())
        large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        discard(low, e)
        low = large.groupBy("u").agg(F.min("v").alias("m"), n)
        small = (
            hot_join(large, low, ["u"], large.count())
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        e = materialize(small, label)
        discard(large)
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
