import pyarrow as pa

from marlstone.operators import keyword_match


def test_parts_are_whole_in_order_and_bounded():
    batch = pa.RecordBatch.from_pydict({"t": ["aaa", "", "bb", "c" * 20, "d", "", ""]})
    got = [p.column(0).to_pylist() for p in keyword_match.parts(batch, [3, 0, 2, 20, 1, 0, 0], 5)]
    assert got == [["aaa", "", "bb"], ["c" * 20], ["d", "", ""]]
    assert not list(keyword_match.parts(batch.slice(0, 0), [], 5))


def test_a_batch_of_long_texts_is_read_part_by_part(spark, monkeypatch):
    long = "bright red apples grow here. " * 8000
    texts = spark.createDataFrame([(i, long) for i in range(4)], "id int, text string").coalesce(1)
    keywords = spark.createDataFrame([("red apples",)], "keyword string")
    assert keyword_match.PART < len(long)
    got = sorted(tuple(r) for r in keyword_match.matches(texts, keywords, "id", "text", "keyword", False).collect())
    assert got == [(i, "red apples", "exact_phrase", 100, 8000) for i in range(4)]
