"""Outputs of micro-batches: appended under the batch number, or replaced bucket by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256


def write_batch(df: DataFrame, folder: str, number: int) -> str:
    """Write one micro-batch; writing it again replaces it.  Returns the path."""
    path = f"{folder}/batch={number}"
    df.write.mode("overwrite").parquet(path)
    return path


class BucketedTable:
    """A table of which a micro-batch replaces the hash buckets that it touches, and no others.

    A batch writes its buckets into a folder of its own and then, as its commit, a list that names the batch of every
    bucket (``buckets`` rows at most). It reads what the batches before it have committed, so a batch that is
    repeated replaces itself. Buckets that neither its list nor the one before it names are removed: the list before is
    what the batch would start from again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: Column, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.buckets = spark, folder, schema, buckets
        self.bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def committed(self, before: int) -> tuple[int, dict[int, int]] | None:
        """The last batch committed before this one, and the batch that each of its buckets is from."""
        lists = self._folder("lists")
        if not lists:
            return None
        numbers = [n for n in (int(name.split("=")[1]) for name in lists) if n < before]
        if not numbers:
            return None
        last = max(numbers)
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.folder}/lists/batch={last}").collect()
        return last, {r["bucket"]: r["version"] for r in rows}

    def before(self, number: int, touched: list[int] | None = None) -> DataFrame:
        """The rows that the batch starts from, of the touched buckets or of all."""
        _, versions = self.committed(number) or (None, {})
        wanted = sorted(versions if touched is None else set(touched) & set(versions))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/data/batch={versions[b]}/hash_bucket={b}" for b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, touched: list[int], number: int) -> None:
        """Commit the rows as all there is in the touched buckets."""
        last, versions = self.committed(number) or (None, {})
        placed = rows.select(*self.schema.names).withColumn("hash_bucket", self.bucket)
        path = f"{self.folder}/data/batch={number}"
        placed.repartition("hash_bucket").write.mode("overwrite").partitionBy("hash_bucket").parquet(path)
        filled = {int(name.split("=")[1]) for name in self._folder(f"data/batch={number}") if name.startswith("hash_bucket=")}
        now = {b: v for b, v in versions.items() if b not in set(touched)} | {b: number for b in filled}
        listed = self.spark.createDataFrame(sorted(now.items()), "bucket int, version int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/batch={number}")
        self._remove_unnamed(set(versions.items()) | set(now.items()), {n for n in (last, number) if n is not None})

    def _remove_unnamed(self, named: set[tuple[int, int]], lists: set[int]) -> None:
        for name in self._folder("lists"):
            if int(name.split("=")[1]) not in lists:
                self._delete(f"lists/{name}")
        for name in self._folder("data"):
            version = int(name.split("=")[1])
            held = [b for b in self._folder(f"data/{name}") if b.startswith("hash_bucket=")]
            gone = [b for b in held if (int(b.split("=")[1]), version) not in named]
            if len(gone) == len(held):
                self._delete(f"data/{name}")
            else:
                for bucket in gone:
                    self._delete(f"data/{name}/{bucket}")

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, name: str) -> list[str]:
        path, system = self._path(name)
        return [f.getPath().getName() for f in system.listStatus(path) if f.isDirectory()] if system.exists(path) else []

    def _delete(self, name: str) -> None:
        path, system = self._path(name)
        system.delete(path, True)
