from losslens.operators.templates import few_shot


def test_any_row_of_a_subject_can_be_drawn(spark):
    train = spark.range(900).selectExpr("id", "concat('t', id) AS text", "id % 3 AS subject").where("id < 600 OR subject = 0").unionByName(spark.createDataFrame([(9000, "t9000", 7), (9001, "t9001", 7)], "id long, text string, subject long"))
    questions = spark.range(1200).selectExpr("id", "nullif(id % 4, 3) AS subject").unionByName(spark.createDataFrame([(5000, 7), (5000, 7), (5001, 8)], "id long, subject long"))
    rows = few_shot(questions, train, 3, "subject").collect()
    assert sorted(r.id for r in rows) == sorted([*range(1200), 5000, 5000, 5001])
    drawn = {0: set(), 1: set(), 2: set()}
    for r in rows:
        if r.id < 1200 and r.id % 4 < 3:
            assert len(set(r.shots)) == 3 and {int(t[1:]) % 3 for t in r.shots} == {r.id % 4}
            drawn[r.id % 4] |= set(r.shots)
        elif r.id == 5000:
            assert sorted(r.shots) == ["t9000", "t9001"]
        else:
            assert r.shots == []
    # 900 draws of 200 or 300 rows leave few out; a pool of 64 would show
    assert all(len(x) > 170 for x in drawn.values())
    assert sorted(map(tuple, few_shot(questions, train, 3, "subject").collect())) == sorted(map(tuple, rows))
