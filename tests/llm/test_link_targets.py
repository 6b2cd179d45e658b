from echoloom.llm.url_filter import url_filter


def test_targets_that_are_no_pages(spark):
    """Addresses that are only linked to have their rules carried to the pages that lead there."""
    html = '<link rel="canonical" href="%s">'
    pages = [
        (0, "http://a.org/x", html % "http://shop.net/es/1"),
        (1, "http://b.org/x", '<meta http-equiv="refresh" content="0; url=http://Shop.net/es/1#top">'),
        (2, "http://c.org/x", html % "http://a.org/x"),
        (3, "http://d.org/x", html % "http://shop.net/fr/2"),
        (4, "http://d.org/x/", html % "http://www.example.com/en/2"),
        (5, "http://e.org/x", html % "http://e.org/y"),
        (6, None, html % "http://shop.net/es/3"),
        (7, "http://shop.net/es", html % "http://shop.net/es/"),
        (8, "http://www.example.com/en/3", html % "http://shop.net/es/4"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter(df).collect()}
    assert got == {0: (None, "block"), 1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"), 8: ("www.example.com/en/", "allow")}
    log = spark.createDataFrame([("http://g.org/", "http://shop.net/es/9"), ("http://shop.net/fr/9", "http://h.org"), (None, "http://i.org")], "a string, b string")
    more = spark.createDataFrame([(1, "http://g.org"), (2, "http://h.org/"), (3, "http://i.org")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter(more, links=log, html_col=None).collect()} == {1: "block", 2: "block", 3: "allow"}
