"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan into as many tasks as the setting ``spark.tarifflens.inputSplits`` says.

    Unset, which is right for any table of more than a few files, the scan stays as it is.  The setting is for
    benchmarks on files of a single row group, which Spark cannot split.
    """
    splits = df.sparkSession.conf.get("spark.tarifflens.inputSplits", None)
    return df.repartition(int(splits)) if splits else df


def companies_of(companies: DataFrame, user_id: int | None = None) -> DataFrame:
    """Companies of one user, newest first (S1, F1); all users when none is given."""
    scoped = companies if user_id is None else companies.where(F.col("user_id") == user_id)
    return scoped.orderBy("user_id", F.desc("created_at"), "company_id")


def append(
    df: DataFrame,
    path: str,
    day_of: str | None = None,
    commit: str | None = None,
    rows_per_file: int = 1_000_000,
    by: tuple[str, ...] = (),
) -> None:
    """Append sink (S6), one folder per day when ``day_of`` names a timestamp, and per value of the columns ``by``.

    Rows are clustered by day, and a day is dealt out into as many parts as its rows fill files, so a busy day is written by many
    tasks and a quiet one by one. The hash of a row chooses its part and, unlike a random number, gives the same answer when a
    task is run again. With ``commit`` the rows go under that name, and a batch that is repeated replaces itself.
    """
    target = path if commit is None else f"{path}/commit={commit}"
    mode = "append" if commit is None else "overwrite"
    if day_of is None and not by:
        df.write.mode(mode).parquet(target)
        return
    dated = df if day_of is None else df.withColumn("day", F.to_date(day_of))
    folders = [*by, *([] if day_of is None else ["day"])]
    placed = dated.withColumn("_folder", F.struct(*folders))
    parts = placed.groupBy("_folder").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_parts"))
    shard = F.pmod(F.xxhash64(*df.columns), F.col("_parts"))
    dealt = placed.join(parts, "_folder").withColumn("_shard", shard).repartition("_folder", "_shard")
    writer = dealt.drop("_folder", "_parts", "_shard").write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy(*folders).parquet(target)


def public_json(df: DataFrame, private: tuple[str, ...] = ("email",), key: str = "user_id") -> DataFrame:
    """Public projection (S10): private columns dropped, the key as text ``id``, a JSON body."""
    shown = df.drop(*private).withColumn("id", F.col(key).cast("string")).drop(key)
    body = F.to_json(F.struct(*[c for c in shown.columns if c != "id"]))
    return shown.withColumn("body", body)
