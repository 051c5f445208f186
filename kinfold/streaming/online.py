"""Online deduplication of a stream: every micro-batch meets the records seen before.

State is two versioned tables in a shared folder: records with their arrival, and cluster assignments. A batch
pairs its records with all older ones, classifies only those pairs, closes them over the old assignment and writes
the next version; a repeated batch id changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import candidates, clustering, fusion
from kinfold.plans.pipeline import DuplicateDetection
from kinfold.plans.runtime import cut_lineage
from kinfold.sources.tables import read_version, upsert


@dataclass(frozen=True)
class OnlineDetection:
    """``keys`` and ``window`` as in ``online_sorted_neighborhood``; ``order`` orders the records of a batch."""

    detection: DuplicateDetection
    keys: list
    path: str
    order: str
    window: int = candidates.DEFAULT_WINDOW

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """(cluster_id, record_id) of the clusters that the batch changed."""
        spark, i = batch.sparkSession, self.detection.id_col
        seen = read_version(spark, f"{self.path}/records")
        if seen is not None and seen[0] >= batch_id:
            return spark.createDataFrame([], f"cluster_id {batch.schema[i].dataType.simpleString()}, record_id {batch.schema[i].dataType.simpleString()}")
        start = 0 if seen is None else (seen[1].agg(F.max("_arrival")).first()[0] or 0)
        fresh = cut_lineage(candidates.global_rank(batch, [self.order, i], "_arrival").withColumn("_arrival", F.col("_arrival") + start + 1))
        every = fresh if seen is None else seen[1].unionByName(fresh)
        pairs = candidates.online_sorted_neighborhood(every, self.keys, i, "_arrival", self.window, since=start + 1)
        classified = cut_lineage(self.detection.classify_pairs(pairs, every).select("left_id", "right_id", "result"))
        held = read_version(spark, f"{self.path}/clusters")
        before = None if held is None else held[1].select("cluster_id", "record_id")
        now = cut_lineage(clustering.transitive_closure(classified, before))
        changed = now if before is None else clustering.changed_clusters(now, before)
        changed = cut_lineage(changed)
        upsert(spark, f"{self.path}/clusters", now, "record_id", batch_id)
        upsert(spark, f"{self.path}/records", fresh, i, batch_id)
        return changed

    def start(self, stream: DataFrame, checkpoint: str, sink=None, **options):
        """A running query; ``sink(changed, batch_id)`` gets the changed clusters of each batch."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            changed = self.process(batch, batch_id)
            if sink is not None:
                sink(changed, batch_id)

        writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append")
        return writer.trigger(**(options or {"availableNow": True})).start()


@dataclass(frozen=True)
class OnlineDeduplication:
    """Online detection, then fusion: every batch re-emits the representations that it changed.

    A representation is a row of the records' columns with ``errors`` and ``n_records``, keyed by ``cluster_id``: the
    smallest id of its records. New records without duplicates represent themselves.
    """

    online: OnlineDetection
    merging: fusion.Merge
    source_col: str | None = None
    ts_col: str | None = None
    weights: dict[str, float] | None = None

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The new or changed representations, which are also upserted under ``path``/representations."""
        o, i = self.online, self.online.detection.id_col
        names, kinds = [f.name for f in self.merging.fields], batch.schema
        changed = o.process(batch, batch_id)
        records = read_version(batch.sparkSession, f"{o.path}/records")[1]
        members = records.join(changed.withColumnRenamed("record_id", i), i)
        fused = fusion.fuse(members, "cluster_id", self.merging, self.source_col, self.ts_col, "_arrival", self.weights)
        merged = fused.select("cluster_id", *[F.col(f"fused.{c}").alias(c) if c in names else F.lit(None).cast(kinds[c].dataType).alias(c) for c in batch.columns], "errors", F.size("originals").alias("n_records"))
        alone = batch.join(changed.select(F.col("record_id").alias(i)), i, "left_anti")
        clustered = read_version(batch.sparkSession, f"{o.path}/clusters")[1].select(F.col("record_id").alias(i))
        alone = alone.join(clustered, i, "left_anti").select(F.col(i).alias("cluster_id"), *batch.columns, F.array().cast("array<string>").alias("errors"), F.lit(1).alias("n_records"))
        out = cut_lineage(merged.unionByName(alone))
        upsert(batch.sparkSession, f"{o.path}/representations", out, "cluster_id", batch_id)
        return out

    def representations(self, spark) -> DataFrame:
        """The current representation of every record: those of clusters that went up in others are left out."""
        rows = read_version(spark, f"{self.online.path}/representations")[1]
        now = read_version(spark, f"{self.online.path}/clusters")[1]
        stale = now.where("record_id <> cluster_id").select(F.col("record_id").alias("cluster_id"))
        return rows.join(stale, "cluster_id", "left_anti")

    def start(self, stream: DataFrame, checkpoint: str, sink=None, **options):
        """A running query; ``sink(representations, batch_id)`` gets what each batch changed."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            out = self.process(batch, batch_id)
            if sink is not None:
                sink(out, batch_id)

        writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append")
        return writer.trigger(**(options or {"availableNow": True})).start()
