"""An append-only, versioned table of ``key -> id``.

Every call of ``register`` adds one version: a folder that holds the keys seen for the
first time, numbered after the largest id that any version ever gave.  Nothing is
rewritten or removed, so a key that leaves keeps its id for its return, an id is never
given twice, and each version reads as it was (``as_of``).

A version counts once Spark's ``_SUCCESS`` mark is in it; a run that ends early leaves
a folder that no read takes and no later version reuses.  Only one writer at a time may
register under a path.  NULL is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemlens.functions.values import to_int_id
from itemlens.operators.dense_ids import assign_dense_ids
from itemlens.session import hadoop_path

_VERSION = "version="


class IdRegistry:
    """The registry under ``path``, a shared folder; ``key_col`` and ``id_col`` name its columns."""

    def __init__(self, spark: SparkSession, path: str, key_col: str, id_col: str, key_type: T.DataType | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.key_col, self.id_col = key_col, id_col
        self.key_type = key_type or T.StringType()

    def _folders(self) -> dict[int, bool]:
        """Version numbers and whether each is finished."""
        place, fs = hadoop_path(self.spark, self.path)
        if not fs.exists(place):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        numbers = [int(n.removeprefix(_VERSION)) for n in names if n.startswith(_VERSION)]
        return {n: fs.exists(hadoop_path(self.spark, f"{self._folder(n)}/_SUCCESS")[0]) for n in numbers}

    def _folder(self, version: int) -> str:
        return f"{self.path}/{_VERSION}{version:08d}"

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        return sorted(n for n, done in self._folders().items() if done)

    def read(self, as_of: int | None = None) -> DataFrame:
        """``key, id, since`` of all keys ever registered (up to version ``as_of``);
        ``since`` is the version that brought the key."""
        rows = T.StructType([T.StructField(self.key_col, self.key_type), T.StructField(self.id_col, T.IntegerType())])
        wanted = [n for n in self.versions() if as_of is None or n <= as_of]
        if not wanted:
            return self.spark.createDataFrame([], rows).withColumn("since", F.lit(0))
        found = self.spark.read.schema(T.StructType([*rows.fields, T.StructField("version", T.IntegerType())]))
        found = found.option("basePath", self.path).parquet(*[self._folder(n) for n in wanted])
        return found.withColumnRenamed("version", "since")

    def register(self, keys: DataFrame) -> DataFrame:
        """Add the keys of ``keys`` that no version has; the registry as it is then.

        New ids follow the largest one in key order.  A call without new keys adds an
        empty version.
        """
        known = self.read()
        old = known.select(F.col(self.key_col).alias("_key"))
        seen = keys.select(F.col(self.key_col).cast(self.key_type)).distinct()
        fresh = seen.join(old, F.col(self.key_col).eqNullSafe(F.col("_key")), "left_anti")
        top = known.agg(F.coalesce(F.max(self.id_col), F.lit(0)).alias("m")).scalar()
        numbered = assign_dense_ids(fresh, [self.key_col], "_n")
        added = numbered.select(self.key_col, to_int_id(F.col("_n") + top, self.id_col).alias(self.id_col))
        version = max(self._folders(), default=0) + 1
        added.write.parquet(self._folder(version))
        return self.read(version)

    def seed(self, ids: DataFrame) -> DataFrame:
        """Make ``ids`` (key, id) the first version, as when a registry starts beside ids
        that were given without one."""
        if self._folders():
            raise ValueError(f"{self.path} already holds a registry")
        ids.select(F.col(self.key_col).cast(self.key_type), F.col(self.id_col).cast("int")).write.parquet(self._folder(1))
        return self.read(1)
