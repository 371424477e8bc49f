from locusframe.streaming import coverage


def test_window_sums_of_a_stream(spark, tmp_path):
    rows = [("s", "c", 0, 1500, 10), ("s", "c", 1500, 2000, 4), ("t", "c", 900, 1100, 2)]
    schema = "sample string, chrom string, start long, end long, depth long"
    source = str(tmp_path / "in")
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).write.mode("append").parquet(source)
    stream = coverage.window_sums(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("window_sums").start()
    query.processAllAvailable()
    query.stop()
    live = sorted(tuple(r) for r in spark.table("window_sums").collect())
    assert live == sorted(tuple(r) for r in coverage.window_sums(spark.createDataFrame(rows, schema)).collect())
    assert ("s", "c", 1000, 1000, 7000) in live


def test_allele_counts(spark):
    calls = spark.createDataFrame([(1, "a", 5, 0), (1, "b", 2, 3)], "site int, sample string, ref_ad int, alt_ad int")
    assert tuple(coverage.allele_counts(calls).first()) == (1, 7, 3, 1)
