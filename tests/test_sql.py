def test_functions(spark):
    from cuelake.plans import sql

    sql.register(spark)
    row = spark.sql("SELECT nfkc('ﬁ') AS a, wrap_lines('The ferry to the northern islands leaves at a quarter past nine', 42) AS b, phrase_repeats(array('a','b','a','b')) AS c").first()
    assert (row["a"], len(row["b"].split("\n")), row["c"]) == ("fi", 2, 2)
    ops = [r["op"] for r in spark.sql("SELECT * FROM align_tokens(array('a','b'), array('a','x','b'))").collect()]
    assert ops == ["equal", "insert", "equal"]
    assert spark.sql("SELECT count(*) FROM split_readable(repeat('word ', 60), 20D)").first()[0] > 3
