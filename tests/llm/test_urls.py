import re

from tests.llm.helpers import tables
from tidemark.llm import urls

ODD = [None, "", "example.org/es/", "http://", "://", "HTTP://WWW.Example.ORG/es/x", "https://example.org", "http://a.example.org?x=/es/", "http://notexample.org/es/1",
       "http://x.com/fr/a#b?c", "http://x.com/de/%C3%A9?a=1&b=2", "http://com/fr/", "a://b://c/d", "http://ÉX.org/en/1", "http://example.org/en/17", "x" * 3000 + "://org/y"]


def plain(url, rules=urls.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_rules_on_all_pages_and_odd_urls(spark):
    pages = tables("0.01", "pages")[0]
    rows = [(r[0], r[1], None, "x") for r in pages] + [(10_000 + k, u, None, None) for k, u in enumerate(ODD)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = urls.judge(frame, urls.labelled_by_rules(frame)).collect()
    assert len(out) == len(rows)
    by_id = {r.page_id: r for r in out}
    for page, url, *_ in rows:
        host, path, rule, verdict = plain(url)
        got = by_id[page]
        assert (got.host, got.path, got.rule) == (host, path, rule)
        assert got.verdict == verdict if verdict else got.verdict in ("allow", "block")


def test_trees_learn_labels_that_hang_on_the_shape_of_the_url(spark):
    pages = tables("0.1", "pages")[0]
    label = lambda u: int("?" in u or "-" in u)
    train = spark.createDataFrame([(u, label(u)) for p, u, _ in pages if p % 3], "url string, label int")
    rest = [(p, u) for p, u, _ in pages if p % 3 == 0]
    out = urls.judge(spark.createDataFrame(rest, "page_id long, url string"), train, rules=()).collect()
    right = sum((r.verdict == "block") == bool(label(dict(rest)[r.page_id])) for r in out)
    assert right >= 0.95 * len(rest)


def test_labels_of_one_kind_and_none(spark):
    page = spark.createDataFrame([(1, "http://x.net/a"), (2, "http://y.org/")], "page_id long, url string")
    labels = lambda rows: spark.createDataFrame(rows, "url string, label int")
    for rows, verdict in (([], "allow"), ([("u", 0)], "allow"), ([("u", 1)], "block"), ([("u", None)], "allow")):
        assert {r.page_id: r.verdict for r in urls.judge(page, labels(rows)).collect()} == {1: verdict, 2: "allow"}
    assert urls.judge(page.where("false"), labels([])).count() == 0
