import datetime as dt

from cohortsmith.llm import url_filter

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_as_of_verdicts(spark):
    events = spark.createDataFrame(
        [
            ("b", True, "Bad.org", True, day(5)), ("b", True, "bad.org", True, day(7)),
            ("b", True, "bad.org", False, day(10)), ("b", True, "bad.org", True, day(20)),
            ("a", False, "ok.bad.org", True, day(0)), ("b", True, "x.net", False, day(3)),
            ("b", True, "both.com", False, day(2)), ("b", True, "both.com", True, day(2)),
            ("b", True, None, True, day(1)), ("b", True, "late.com", True, None),
        ],
        "list string, blocks boolean, domain string, added boolean, day date",
    )
    cases = [
        (1, "http://bad.org/x", day(4), False), (2, "http://www.bad.org", day(5), True),
        (3, "https://u:p@BAD.org.:80/", day(9), True), (4, "http://bad.org", day(10), False),
        (5, "http://bad.org", day(25), True), (6, "http://ok.bad.org/", day(25), False),
        (7, "http://notbad.org", day(25), False), (8, None, day(25), False),
        (9, "no url", day(25), False), (10, "http://bad.org", None, False),
        (11, "http://both.com?q", day(2), True), (12, "http://late.com", day(9), False),
        (12, "http://late.com", day(9), False), (None, "http://bad.org#x", day(6), True),
    ]
    captures = spark.createDataFrame(
        [(*c[:3], "x", "y") for c in cases],
        "page_id long, url string, fetched date, host string, domain string",
    )
    got = url_filter.evaluate(captures, events)
    assert sorted((r["page_id"] or 0, r["blocked"]) for r in got.collect()) == sorted(
        (c[0] or 0, c[3]) for c in cases
    )
    decided = {r["page_id"]: r["decided_by"] for r in got.collect()}
    assert decided[2] == "bad.org" and decided[6] == "ok.bad.org" and decided[4] is None
    assert url_filter.evaluate(captures.limit(0), events).collect() == []
    assert url_filter.evaluate(captures, events.limit(0)).where("blocked").count() == 0
