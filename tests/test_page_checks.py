"""Checks of raw pages against outcomes stated by hand."""

from marlstone.operators import page_checks

GOOD = """<!DOCTYPE html><html lang="en-US"><head><meta charset="utf-8"><title>Roof repair for old houses | Hilltop</title>
<meta name="description" content="{}"><meta name="viewport" content="width=device-width, initial-scale=1">
<link rel="canonical" href="https://a.example/roofs"><link rel="preload" href="/x.css"><!-- <h1>no</h1> --></head>
<body><header></header><nav><a href="/home">Home &amp; away</a></nav><main><article><h1>Repairing the <b>roof</b> yourself</h1><h2>Why?</h2>
<img src="/a.webp" alt="A roof" width="10" height="20"></article></main><footer></footer><script>var t = "<h1>";</script></body></html>""".format("d" * 130)
BAD = """<html><head><title>Hi {all}</title><title>x</title><meta name="robots" content="NOINDEX, nofollow"><meta http-equiv="refresh" content="0; url=/b">
<link rel="canonical" href="http://a.example/c/"><link rel="canonical" href="/d"><script src="http://b.example/s.js"></script></head>
<body><h3>late</h3><h2></h2><a href="/x">here</a><a href="/y"></a><a href="http://c.example/" target="_blank">c</a><img src="http://d.example/p.PNG"><img src="/icon.png"><div></div>"""


def found(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in page_checks.outcomes(page_checks.signals(pages)).collect():
        got.setdefault(r.page, {})[r.id] = r.status if r.status != "fail" else f"fail/{r.severity}"
    return got


def test_good_and_bad_pages(spark):
    got = found(spark, [(1, "https://a.example/roofs", GOOD), (2, "https://a.example/c_d/2024/x/y/77?a=1&b=2&c=3", BAD), (3, None, None)])
    scored = {i: s for i, s in got[1].items() if s not in ("pass", "informational", "skipped")}
    assert scored == {**{f"K{k}": "warning" for k in (1, 2, 3, 5)}, **{f"K{k}": "notice" for k in (7, 8, 9, 10, 11, 12)}}
    want = {
        "A1": "pass", "A3": "warning", "A8": "notice", "A9": "fail/error", "B1": "warning", "B6": "warning", "C1": "fail/error", "C2": "warning", "C3": "fail/error", "C9": "warning", "C10": "fail/error",
        "D2": "fail/error", "D5": "notice", "D6": "warning", "D7": "notice", "E1": "fail/error", "E8": "warning", "E9": "warning", "G1": "fail/error", "G2": "pass", "G6": "warning", "G7": "warning", "G8": "notice", "G12": "notice",
        "H5": "warning", "H6": "warning", "I3": "warning", "I4": "warning", "M1": "warning", "M3": "warning", "M5": "fail/error", "M16": "warning", "M21": "fail/error", "N2": "notice", "N3": "warning", "N4": "notice", "N5": "warning", "N7": "notice", "P7": "warning",
    }
    assert {i: got[2][i] for i in want} == want
    assert (got[3]["A1"], got[3]["A3"], got[3]["A5"], got[3]["D4"], got[3]["N1"], got[3]["M12"]) == ("fail/error", "fail/warning", "pass", "skipped", "skipped", "pass")


def test_no_pages_and_repeated_pages(spark):
    assert found(spark, []) == {}
    pages = spark.createDataFrame([(1, "https://a.example/", "<p>x"), (1, "https://a.example/b", "<p>y")], "page_id long, url string, html string").withColumn("tag", page_checks.F.lit(0))
    assert page_checks.signals(pages).count() == 2
    twice = spark.createDataFrame([(7, "https://a.example/", "<h1>One heading</h1>")] * 2, "page_id long, url string, html string")
    assert [(r.h1s, r.links) for r in page_checks.signals(twice).collect()] == [(1, 0)] * 2  # a row given twice is two pages
