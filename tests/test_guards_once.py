from marlstone.operators import writing


def test_sentences_are_compared_once_and_restated_ones_found(spark):
    said = "The quick brown fox jumps over the lazy dog today. Nothing else is worth a word in here."
    rows = [(1, said, said + "\n[NEW]The quick brown fox jumps over the lazy dog.[/NEW]"), (2, said, said + "\n[NEW]Green apples grow on quite different old trees.[/NEW]"), (3, None, None)]
    df = writing.guards(spark.createDataFrame(rows, "id int, o string, e string"), "o", "e")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9 ]") <= 6
    assert sorted((r.id, r.redundant, r.lost, r.foreign) for r in df.collect()) == [(1, 1, 0.0, 0.0), (2, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
