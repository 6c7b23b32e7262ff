"""Partitions of what follows from the sequences grow with the input, however little a shuffle of it takes."""

import pytest
from pyspark.sql import functions as F

from seqspark.plans import derive, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["f2_pick_inserts", "h6_delete_features", "h6_delete_sequences", "d7_build_feature_library", "b6_features_at", "b8_cds_orfs", "h1_proteins", "a3_genbank_refs"])
def test_no_task_holds_all(spark, monkeypatch, name):
    monkeypatch.setattr(derive, "PART_BYTES", 1 << 14, raising=False)
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    spark.conf.set(key, "false")
    try:
        rows = registry.QUERIES[name](spark, SF)
        parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
        assert len(parts) > 4 and max(r["n"] for r in parts) <= sum(r["n"] for r in parts) / 2
    finally:
        spark.conf.unset(key)
