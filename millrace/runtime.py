"""Where intermediate results live: the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset, and Spark runs in this process, a folder of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
        place = _OWN[0]
    return place.rstrip("/")


_WRITTEN: list[str] = []
_TABLES: dict[str, str] = {}  # of places that are bucketed tables: their names


def store(df: DataFrame, name: str) -> str:
    """Writes df as Parquet to the shared folder; returns the place, which the caller may delete()."""
    place = f"{shared_dir(df.sparkSession)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return place


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: short lineage, true sizes, safe from lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(remember(store(df, name)))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a bucketed table in the shared folder, one file a bucket: joins and aggregations by `key` don't shuffle it again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    title = f"millrace_{name}_{uuid.uuid4().hex}".replace("-", "_")
    place = remember(f"{shared_dir(spark)}/millrace/{title}")
    _TABLES[place] = title
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", place).saveAsTable(title)
    return spark.table(title)


def folders(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as Parquet with one folder for each value of `key`, which joins on it may prune."""
    spark = df.sparkSession
    place = remember(f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}")
    df.repartition(key).write.partitionBy(key).parquet(place)
    return spark.read.schema(df.schema).parquet(place).select(df.columns)


def remember(place: str) -> str:
    """Has release(), or the scratch() around it, delete the folder too."""
    _WRITTEN.append(place)
    return place


def delete(spark: SparkSession, *places: str) -> int:
    hadoop, jvm, n = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm, 0
    for place in places:
        if place in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(place)}")
        path = jvm.org.apache.hadoop.fs.Path(place)
        n += bool(path.getFileSystem(hadoop).delete(path, True))
    return n


def tidy(spark: SparkSession) -> None:
    """Has Spark drop shuffle files, broadcasts and plans of finished work now.

    Spark does so when the driver happens to collect its garbage, which a driver with many
    small jobs does late: its heap grows first, and shuffle files stay on the executors'
    disks meanwhile.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was materialised inside; for work whose results are stored or collected before."""
    mark = len(_WRITTEN)
    yield
    places = _WRITTEN[mark:]
    del _WRITTEN[mark:]
    delete(spark, *places)
    tidy(spark)


def release(spark: SparkSession) -> int:
    """Deletes what materialise() has written in this process; only after the results that rest on it were written or collected."""
    places = _WRITTEN[:]
    _WRITTEN.clear()
    return delete(spark, *places)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
