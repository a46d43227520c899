"""Changes of plain Parquet tables, as DataFrames of the new contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def insert_or_ignore(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those fresh ones whose key is new, one per key (the least row); null parts of keys are equal."""
    order = Window.partitionBy(*keys).orderBy(*[c for c in fresh.columns if c not in keys] or [F.lit(1)])
    one = fresh.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    s = stored.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return stored.unionByName(one.join(s, on, "left_anti"), allowMissingColumns=True)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows, and stored ones of other keys. ``fresh`` must have one row per key."""
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_or_replace(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last writer wins: of all rows of a key the one greatest by ``order``, of equal ones the fresh one."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__new")


def delete_memories(ids: DataFrame, memories: DataFrame, vectors: DataFrame, edges: DataFrame, jobs: DataFrame, lineage: DataFrame) -> dict[str, DataFrame]:
    """All tables without the memories of ``ids`` (id) and whatever belongs to them."""
    k = lambda name: ids.select(F.col("id").alias(name)).distinct()
    return {
        "memories": memories.join(k("id"), "id", "left_anti"),
        "vectors": vectors.join(k("memory_id"), "memory_id", "left_anti"),
        "edges": edges.join(k("src_id"), "src_id", "left_anti").join(k("dst_id"), "dst_id", "left_anti"),
        "jobs": jobs.join(k("memory_id"), "memory_id", "left_anti"),
        "lineage": lineage.join(k("decoy_id"), "decoy_id", "left_anti").join(k("child_id"), "child_id", "left_anti"),
    }


def delete_projects(ids: DataFrame, projects: DataFrame, memories: DataFrame) -> dict[str, DataFrame]:
    """Projects without those of ``ids`` (id); their memories stay, without a project."""
    gone = ids.select(F.col("id").alias("project_id"), F.lit(True).alias("__gone")).distinct()
    kept = memories.join(gone, "project_id", "left").withColumn("project_id", F.when(F.col("__gone").isNull(), F.col("project_id"))).select(*memories.columns)
    return {"projects": projects.join(ids.select("id"), "id", "left_anti"), "memories": kept}


#: Folders of the cold tier; a fetch reads those of its ids, a deletion rewrites those.
COLD_BUCKETS = 64


def _cold_bucket(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")


def write_cold(rows: DataFrame, folder: str, buckets: int = COLD_BUCKETS) -> None:
    """Contents of archived memories, zstd-compressed, in a bounded number of folders by id."""
    placed = rows.select("id", "content", "project_id", _cold_bucket(buckets)).repartition("bucket")
    placed.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(folder)


def read_cold(spark: SparkSession, folder: str, ids: DataFrame, buckets: int = COLD_BUCKETS) -> DataFrame:
    """``id, content, project_id`` of the ids; only their folders are read."""
    wanted = ids.select("id", _cold_bucket(buckets)).distinct()
    return spark.read.parquet(folder).join(wanted, ["bucket", "id"], "left_semi").drop("bucket")


def delete_cold(spark: SparkSession, folder: str, ids: DataFrame, buckets: int = COLD_BUCKETS) -> None:
    """Removes the ids' rows: their folders are written anew, the others stay as they are."""
    wanted = materialize(ids.select("id", _cold_bucket(buckets)).distinct(), "cold-ids")
    touched = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # no more than there are buckets
    left = materialize(spark.read.parquet(folder).where(F.col("bucket").isin(touched)).join(wanted, ["bucket", "id"], "left_anti"), "cold-left")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in touched:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"bucket={k}"), True)
    left.select("id", "content", "project_id", "bucket").repartition("bucket").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(folder)


def detect_projects(wanted: DataFrame, projects: DataFrame) -> DataFrame:
    """``path, git_remote, project_id, found_by``: the project of each path, else of its remote, else a new id."""
    by_path = projects.groupBy("path").agg(F.min("id").alias("__p"))
    by_remote = projects.where("git_remote <> ''").groupBy("git_remote").agg(F.min("id").alias("__r"))
    j = wanted.join(by_path, "path", "left").join(by_remote, "git_remote", "left")
    made = F.sha2(F.concat(F.lit("project:"), F.col("path")), 256)
    return j.select("path", "git_remote", F.coalesce("__p", "__r", made).alias("project_id"), F.when(F.col("__p").isNotNull(), "path").when(F.col("__r").isNotNull(), "remote").otherwise("new").alias("found_by"))
