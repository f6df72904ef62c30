from marlstone.operators import checks


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_a_page_are_one_grouping(spark):
    rows = [(1, "A", "x", "pass", "none"), (1, "B", "y", "fail", "error"), (2, "A", "x", "skipped", "none"), (3, "C", "elsewhere", "fail", "error"), (4, "A", "x", "warning", "none"), (4, "C", "x", "fail", "warning")]
    c = spark.createDataFrame(rows, "page int, id string, category string, status string, severity string")
    df = checks.page_scores(c, {"x": "u", "y": "v"}, {"u": 0.75, "v": 0.25}, {"A": 3}, {"b": (["B"], 40), "c": (["C"], 60)})
    assert "Join" not in plan(df) and plan(df).count("Aggregate") == 1
    got = {r.page: (r.composite, r.cap, r.overall) for r in df.collect()}
    assert got == {1: (75, 40, 40), 2: (None, None, None), 3: (None, 60, 60), 4: (44, 60, 44)}
