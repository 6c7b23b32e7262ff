"""Tables that the queries derive from the given ones."""

from seqspark.plans import derive

SF = "/root/testdata/sf0.001"


def test_texts_are_cleaned_once(spark):
    """However often a plan names a sequence or its length; a null text stays a null sequence."""
    plan = derive.backbones(spark, SF).where("his_start is null or his_start > length(seq) / 4")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_null_texts_stay(spark, tmp_path):
    spark.createDataFrame([(1, None, "a"), (2, "Ab-C", "b"), (3, "", "c")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, derive.sequences(spark, str(tmp_path)).collect())) == [(1, "a", None, "linear"), (2, "b", "ac", "circular"), (3, "c", "", "linear")]
