"""Pipelines: duplicate detection and deduplication of whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import candidates, classify, clustering, fusion
from kinfold.operators.filters import key_filter, with_membership
from kinfold.plans.runtime import cut_lineage


@dataclass(frozen=True)
class DuplicateDetection:
    """Candidates, classification, handling of possible duplicates, clustering.

    ``select`` maps records to (left_id, right_id); ``prepare`` maps them to the id and the columns that are compared,
    so that what depends on one record (words, codes) is computed once a record and not once a pair; ``prune`` names
    small columns and a condition on them without which a pair cannot be a duplicate, so that the large columns travel
    only for the pairs that are left; ``refine`` splits closures; ``previous`` clusters are never split.
    """

    select: Callable[[DataFrame], DataFrame]
    classifier: classify.RuleBasedClassifier | classify.OracleClassifier
    id_col: str = "id"
    columns: tuple[str, ...] | None = None
    handler: classify.Handler = classify.keep
    refine: bool = False
    max_small: int = clustering.MAX_SMALL
    prepare: Callable[[DataFrame], DataFrame] | None = None
    prune: tuple[tuple[str, ...], Callable[[Column, Column], Column]] | None = None

    def classify_pairs(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        records = records if self.prepare is None else cut_lineage(self.prepare(records))
        pairs = pairs.select("left_id", "right_id")
        if self.prune is not None:
            names, possible = self.prune
            small = candidates.with_records(pairs, records, self.id_col, names)
            pairs = small.where(possible(F.col("left"), F.col("right"))).select("left_id", "right_id")
        joined = candidates.with_records(pairs, records, self.id_col, self.columns)
        return classify.handle_possible(self.classifier.classify(joined), self.handler)

    def classified(self, records: DataFrame) -> DataFrame:
        return self.classify_pairs(self.select(records), records).select("left_id", "right_id", "result", "errors")

    def clusters(self, records: DataFrame, previous: DataFrame | None = None) -> DataFrame:
        """(cluster_id, record_id) of all records that have duplicates."""
        found = cut_lineage(self.classified(records))
        if self.refine:
            out = clustering.refined_transitive_closure(found, lambda p: self.classify_pairs(p, records), previous, self.max_small)
            if previous is not None:
                out = clustering.consistent(out, previous)
        else:
            out = clustering.transitive_closure(found, previous)
        return out


@dataclass(frozen=True)
class Deduplication:
    """Detection, then fusion; records without duplicates stay, and so do those of clusters that ``accept`` refuses."""

    detection: DuplicateDetection
    merging: fusion.Merge
    source_col: str | None = None
    ts_col: str | None = None
    arrival_col: str | None = None
    weights: dict[str, float] | None = None
    accept: Callable[[DataFrame], DataFrame] = fusion.accept_complete

    def deduplicate(self, records: DataFrame, previous: DataFrame | None = None) -> DataFrame:
        """The records' columns, an array ``errors`` and the number ``n_records`` that each row stands for."""
        i = self.detection.id_col
        clusters = cut_lineage(self.detection.clusters(records, previous))
        # Most rows are in no cluster, and those that are surely in none do not move.
        known = key_filter(clusters, [F.col("record_id").cast(records.schema[i].dataType)])
        mark = "_clustered"
        while mark in records.columns:
            mark = f"_{mark}"
        parted = with_membership(records, known, [i], mark)
        near, alone = parted.where(mark).drop(mark), parted.where(~F.col(mark)).drop(mark)
        members = near.join(clusters.withColumnRenamed("record_id", i), i)
        fused = self.accept(fusion.fuse(members, "cluster_id", self.merging, self.source_col, self.ts_col, self.arrival_col, self.weights))
        names = [f.name for f in self.merging.fields]
        values = [F.col(f"fused.{c}").alias(c) if c in names else F.lit(None).cast(records.schema[c].dataType).alias(c) for c in records.columns]
        # Only the merged record is kept; the originals stay where they are.
        merged = cut_lineage(fused.select(F.col("cluster_id").alias("_cluster"), *values, "errors", F.size("originals").alias("n_records")))
        done = clusters.join(merged.select(F.col("_cluster").alias("cluster_id")), "cluster_id", "left_semi").select(F.col("record_id").alias(i))
        rest = near.join(done, i, "left_anti").select(*records.columns).union(alone.select(*records.columns)).select(*records.columns, F.array().cast("array<string>").alias("errors"), F.lit(1).alias("n_records"))
        return rest.union(merged.drop("_cluster"))
