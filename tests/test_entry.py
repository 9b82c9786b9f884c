import __spark_entry__ as e


def test_contract(spark):
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 38
    df = e.entry(spark)
    assert df.columns == ["mapq", "aligned", "correct"] and df.count() > 0
    shipped = list(spark.sparkContext._python_includes)
    queries["read_stats"](spark, "/root/testdata/sf0.001").collect()
    assert spark.sparkContext._python_includes == shipped and any("seqframe" in x for x in shipped)
