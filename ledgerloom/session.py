"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(name: str = "ledgerloom", cores: str = "8", **conf: str) -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local master may fall back on a folder of this machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="ledgerloom-")
    return _LOCAL_ROOTS[sc.applicationId]


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    """No rows, as a plan that the optimizer folds away."""
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).where(F.lit(False))


#: The work folders that this process made, by application.
_MADE: dict[str, list[str]] = {}


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Remove all work folders of this application, once no result that was built on them is read any more."""
    for root in _MADE.pop(spark.sparkContext.applicationId, []):
        delete(spark, root)


class Workspace:
    """Written tables that cut the lineage of iterative plans and outlive lost executors.

    As a context manager it removes its folder at the end, so results have to be read or written within it; else ``close`` it, or
    ``clean_up`` the application's folders, when the results have been read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        delete(self.spark, self.root)
        made = _MADE.get(self.spark.sparkContext.applicationId, [])
        if self.root in made:
            made.remove(self.root)

    def write(self, df: DataFrame, label: str = "t", **metrics) -> tuple[DataFrame, dict]:
        """Write ``df`` and read it back; ``metrics`` are aggregates observed while it is written."""
        path = f"{self.root}/{self._n:04d}-{label}"
        self._n += 1
        seen = Observation()
        exprs = [v.alias(k) for k, v in metrics.items()] or [F.count(F.lit(1)).alias("rows")]
        df.observe(seen, *exprs).write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._workspace_path = path
        return back, {k: seen.get[k] for k in (metrics or {"rows": None})}

    def split(self, df: DataFrame, part: Column, count: int, label: str = "t") -> list[tuple[DataFrame, int]]:
        """``df`` written once by the number ``part`` (0 to ``count`` - 1), and each part with its number of rows."""
        path = f"{self.root}/{self._n:04d}-{label}"
        self._n += 1
        seen = Observation()
        split = df.withColumn("_part", part)
        split.observe(seen, *[F.count_if(F.col("_part") == i).alias(f"n{i}") for i in range(count)]).write.mode("overwrite").partitionBy("_part").parquet(path)
        rows = [seen.get[f"n{i}"] for i in range(count)]
        return [(self.spark.read.schema(df.schema).parquet(f"{path}/_part={i}") if n else empty(self.spark, df.schema), n) for i, n in enumerate(rows)]

    def table(self, df: DataFrame, label: str = "t") -> DataFrame:
        return self.write(df, label)[0]

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove written tables that nothing reads any more."""
        for t in tables:
            path = getattr(t, "_workspace_path", None)
            if path:
                delete(self.spark, path)
