"""Tables that queries write for themselves."""

import threading

from marlstone import runtime


def test_queries_of_two_threads_keep_their_tables(spark):
    began, swept = threading.Event(), threading.Event()
    got = {}

    def slow():
        since = runtime.mark(spark)
        own = runtime.materialize(spark.range(5))
        began.set()
        swept.wait(60)
        got["slow"] = own.count()
        runtime.sweep(spark.range(1), since)
        got["left"] = runtime._tables.get()

    thread = threading.Thread(target=slow)
    since = runtime.mark(spark)
    first = runtime.materialize(spark.range(3))
    thread.start()
    began.wait(60)
    second = runtime.materialize(spark.range(4))
    runtime.sweep(second, since)
    swept.set()
    thread.join(60)
    assert got == {"slow": 5, "left": None} and second.count() == 4
    try:
        first.count()
        raise AssertionError("the table should be gone")
    except Exception as e:
        assert "should be gone" not in str(e)


def test_lists_within_lists(spark):
    outer = runtime.mark(spark)
    a = runtime.materialize(spark.range(1))
    inner = runtime.mark(spark)
    b, c = runtime.materialize(spark.range(2)), runtime.materialize(spark.range(3))
    runtime.sweep(b, inner)
    assert len(outer) == 2 and b.count() == 2
    runtime.sweep(b.unionByName(a), outer)
    assert a.count() == 1 and b.count() == 2 and runtime._tables.get() is None
    del c
