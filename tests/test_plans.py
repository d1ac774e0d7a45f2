from flowlens.plans import registry


def test_part_of_one_file_is_read_by_all_cores(spark, tmp_path):
    rows = spark.range(640).selectExpr(
        "id AS p_partkey", "concat('azure gear ', id) AS p_name", "'Brand#12' AS p_brand", "'PROMO TIN' AS p_type", "cast(id % 50 AS int) AS p_size")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    part = registry.part(spark, str(tmp_path))
    assert part.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(part.collect()) == sorted(rows.collect())
