"""Clicks and counters that one session records."""

from lumenspan.plans import api
from lumenspan.plans.catalogue import now
from lumenspan.sources import corpus as T


def test_recorded_clicks(spark, sf):
    e = api.Engine(T.files(spark, sf), None, now())
    e.record_click("The Plan", "/A/x.txt/", 3, 100.0)
    e.on_new_search("plans", 101.0)  # typed on
    e.record_click("plan", "/a/X.txt", 0, 200.0)
    e.on_new_search("budget", 209.0)  # a bounce
    e.record_click("budget", "/a/y.txt", 4, 300.0)
    e.on_new_search("other", 311.0)  # too late for one
    e.record_click("budget", "/a/x.txt", 3, 400.0)
    got = {(r["query"], r["path_key"], r["click_count"], r["position"], r["is_bounce"]) for r in e.recorded_clicks().collect()}
    assert got == {("plan", "/a/x.txt", 2, 0, True), ("budget", "/a/y.txt", 1, 4, False), ("budget", "/a/x.txt", 1, 3, False)}


def test_counters_less_what_was_sent(spark, sf):
    e = api.Engine(T.files(spark, sf), None, now())
    e.record_search("FtsOnly", 10, 4)
    e.record_search("FtsOnly", 21, 4)
    e.record_top_click()
    sent = e.snapshot()
    e.record_search("Hybrid", 30, 0)
    e.acknowledge(sent)
    s = e.snapshot()
    assert (s["searches"], s["empty"], s["mean_ms"], s["FtsOnly"], s["Hybrid"], s["top_clicks"]) == (1, 1, 31, 0, 1, 0)
