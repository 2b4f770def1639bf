"""History of saved segmentation runs in Parquet, in buckets by run id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import shared_folder

PROFILE = (
    "row_count: LONG, column_count: INT, summary: STRING, columns: ARRAY<STRUCT<name: STRING, type: STRING,"
    " null_count: LONG, unique_count: LONG, sample: ARRAY<STRING>,"
    " stats: STRUCT<min: DOUBLE, max: DOUBLE, mean: DOUBLE, std_dev: DOUBLE>>>"
)
RESULTS = (
    "clusters: ARRAY<STRUCT<id: INT, name: STRING, size: LONG, centroid: ARRAY<DOUBLE>, characteristics: ARRAY<STRING>,"
    " business_description: STRING, recommended_actions: ARRAY<STRING>,"
    " metrics: STRUCT<avg_distance: DOUBLE, cohesion: DOUBLE>>>, inertia: DOUBLE,"
    " feature_importance: ARRAY<STRUCT<feature: STRING, importance: DOUBLE>>, pca_variance_explained: ARRAY<DOUBLE>"
)
SCHEMA = (
    "file_name STRING, created_at TIMESTAMP, features ARRAY<STRING>, num_clusters INT, row_count LONG,"
    f" dataset_metadata STRUCT<{PROFILE}>, clustering_results STRUCT<{RESULTS}>, silhouette_score DOUBLE, id STRING"
)
#: Runs are spread over so many folders by a hash of their id.
BUCKETS = 64


class DuplicateRun(ValueError):
    """A run whose id is stored already, or comes twice."""


class RunStore:
    """Saved runs below one folder. Writers must not run at the same time.

    A folder holds all runs whose id falls into its bucket, so the history has
    a bounded number of folders, and a run is found in one of them. Row labels
    of a run are kept beside it, in the same buckets.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.runs_path = f"{path.rstrip('/')}/runs"
        self.labels_path = f"{path.rstrip('/')}/labels"
        self.schema = T.StructType.fromDDL(SCHEMA)

    def _read(self, path: str, fields: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(T.StructType([*fields.fields, _BUCKET])).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], T.StructType([*fields.fields, _BUCKET]))

    def _stored(self) -> DataFrame:
        return self._read(self.runs_path, self.schema)

    def append(self, runs: DataFrame) -> None:
        """Adds runs. Nothing is written if an id is stored already or comes twice: DuplicateRun names some."""
        missing = [f for f in self.schema.fields if f.name not in runs.columns]
        runs = runs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
        runs = runs.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], _bucket(F.col("id")).alias("bucket"))
        ids = runs.select("id", "bucket")
        # only the buckets of the new ids are read, if Spark prunes them by the join
        known = self._stored().select("id", "bucket").join(ids, ["id", "bucket"], "left_semi").select("id")
        twice = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        refused = [r["id"] for r in known.union(twice).limit(10).collect()]
        if refused:
            raise DuplicateRun(f"ids that are stored already or come twice: {sorted(map(str, refused))}")
        self._write(runs, "append", self.runs_path)

    def _write(self, rows: DataFrame, mode: str, path: str) -> None:
        # one file per bucket and write
        rows.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    def list(self) -> DataFrame:
        """All runs, newest first, without their nested results."""
        return (
            self._stored()
            .select(
                "id", "file_name", "created_at", "num_clusters",
                F.coalesce(F.size("features"), F.lit(0)).alias("feature_count"), "row_count", "silhouette_score",
            )
            .orderBy(F.desc("created_at"), "id")
        )

    def get(self, run_id: str) -> DataFrame:
        """The run with all columns, or no row; only its bucket is read."""
        return self._stored().where(self._here(run_id)).drop("bucket")

    def _here(self, run_id: str) -> Column:
        bucket = self.spark.range(1).select(_bucket(F.lit(run_id))).first()[0]
        return (F.col("bucket") == bucket) & (F.col("id") == run_id)

    def delete(self, run_id: str) -> None:
        """Takes the run and its labels out of their buckets; other buckets aren't touched."""
        self._without(self._stored(), run_id, self.runs_path)
        self._without(self._labels(), run_id, self.labels_path)

    def _without(self, stored: DataFrame, run_id: str, path: str) -> None:
        if stored.where(self._here(run_id)).isEmpty():
            return
        here = self._here(run_id)
        bucket = self.spark.range(1).select(_bucket(F.lit(run_id))).first()[0]
        shared_folder(self.spark)
        # written apart first: a folder isn't overwritten while it is read
        rest = stored.where((F.col("bucket") == bucket) & ~here).checkpoint()
        if rest.isEmpty():
            # a bucket without a row can't be overwritten by no rows; an empty file takes its place
            rest.drop("bucket").write.mode("overwrite").parquet(f"{path}/bucket={bucket}")
        else:
            self._write(rest, "overwrite", path)

    def _labels(self) -> DataFrame:
        return self._read(self.labels_path, T.StructType.fromDDL("row_id STRING, prediction INT, id STRING"))

    def save_labels(self, run_id: str, labels: DataFrame, row_id: str) -> None:
        """Cluster of every row of a run; saving them again replaces them."""
        self._without(self._labels(), run_id, self.labels_path)
        rows = labels.select(F.col(row_id).cast("string").alias("row_id"), F.col("prediction").cast("int"), F.lit(run_id).alias("id"))
        # all rows are of one bucket: they keep their tasks instead of being sent to one
        rows.withColumn("bucket", _bucket(F.col("id"))).write.mode("append").partitionBy("bucket").parquet(self.labels_path)

    def labels(self, run_id: str) -> DataFrame:
        """row_id, prediction and id of a run; none of an unknown one."""
        return self._labels().where(self._here(run_id)).drop("bucket")


_BUCKET = T.StructField("bucket", T.IntegerType())


def _bucket(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS)).cast("int")
