"""Coverage of planned publishers, first matches in the plan's order, and aggregates that keep an order."""

from tidewell.functions.groups import ordered_distinct, value_counts
from tidewell.operators import coverage

PLAN = "topic string, ordinal int, site_id string, publisher string, domain string, must_attempt boolean"
ATTEMPTS = "topic string, site_id string, seq int, outcome string"
PAGES = "topic string, page_id int, publisher string, url string, access_state string, capture_method string"
SITES = [("t", 1, "reuters", "Reuters", "reuters.com", True), ("t", 2, "bloomberg", "Bloomberg", "bloomberg.com", None), ("t", 3, "financial-times", "Financial  Times", "ft.com", True), ("t", 4, "extra", "Extra", "extra.org", False)]
TRIED = [("t", "reuters", 1, "opened_original"), ("t", "bloomberg", 2, "paywalled"), ("t", "financial-times", 3, "no_relevant_result")]
STORY = ("t", 1, "Reuters", "https://www.reuters.com/world/story/", "open", "visible_original_page")


def gate(spark, tried, pages, sites=SITES):
    g = coverage.gate(spark.createDataFrame(sites, PLAN), spark.createDataFrame(tried, ATTEMPTS), spark.createDataFrame(pages, PAGES), "topic", "reuters")
    return g.first()


def test_explicit_outcomes(spark):
    g = gate(spark, TRIED, [STORY])
    assert g["passed"] and g["key_site_attempted"] and g["opened_original_pages"] == 1 and g["status"] == "complete" and g["required_publishers"] == 3 and g["warnings"] == []
    g = gate(spark, TRIED[:2], [STORY])
    assert not g["passed"] and g["missing_publishers"] == ["financial-times"] and g["warnings"] == ["silently skipped: financial-times"]
    g = gate(spark, [("t", "reuters", 1, "search_results_only"), *TRIED[1:]], [])
    assert not g["passed"] and g["unresolved_publishers"] == ["reuters"] and g["all_accounted_for"]
    g = gate(spark, [("t", "reuters", 1, "no_relevant_result"), *TRIED[1:]], [])
    assert g["passed"] and g["status"] == "degraded" and g["warnings"] == ["no original page was opened"]


def test_odd_attempts_and_order(spark):
    """The last valid attempt counts; what is outside the plan or no outcome is named once, by its order."""
    tried = TRIED + [("t", "bloomberg", 9, "guessed"), ("t", "extra", 4, "failed"), ("t", "extra", 8, "failed"), ("t", None, 5, "failed"), ("t", "bloomberg", 7, None), ("t", "financial-times", 10, "failed")]
    g = gate(spark, tried, [STORY])
    assert g["failed_publishers"] == ["financial-times"] and g["status"] == "incomplete"
    assert g["warnings"] == ["attempt outside the required plan: extra", "attempt outside the required plan: <missing>", "invalid outcome for bloomberg: <missing>", "invalid outcome for bloomberg: guessed", "failed: financial-times"]


def test_pages_override_and_first_match_wins(spark):
    sites = [("t", 1, "ft", "FT", "ft.com", True), ("t", 2, "blog", "FT Blog", "blog.ft.com", True), ("t", 3, "other", "Other", None, True), ("u", 1, "ft2", "FT", "ft.com", True)]
    pages = [
        ("t", 1, " ft  BLOG ", "https://x.org/", "open", "visible_original_page"), ("t", 2, None, "https://a.blog.ft.com:443/x", "paywalled", None), ("t", 3, "other", "https://FT.com/", "login_required", None), ("t", 4, "nobody", "https://notft.com/", "open", "visible_original_page"), ("t", 5, None, None, None, None),
        ("t", 6, "Other", "https://x.org/", None, None), ("u", 1, "ft", "https://x.org/", "signed_in", "visible_original_page"),
    ]
    plan, shown = spark.createDataFrame(sites, PLAN), spark.createDataFrame(pages, PAGES)
    got = {(r["topic"], r["page_id"]): r["site_id"] for r in coverage.match_pages(shown, plan, "topic").collect()}
    assert got == {("t", 1): "blog", ("t", 2): "ft", ("t", 3): "ft", ("t", 6): "other", ("u", 1): "ft2"}
    tried = spark.createDataFrame([("t", "ft", 1, "no_relevant_result"), ("t", "other", 1, "opened_original")], ATTEMPTS)
    o = {(r["topic"], r["site_id"]): (r["outcome"], r["observed_pages"], r["original_pages"]) for r in coverage.outcomes(plan, tried, shown, "topic").collect()}
    assert o == {("t", "ft"): ("login_required", 2, 0), ("t", "blog"): ("opened_original", 1, 1), ("t", "other"): ("opened_original", 1, 0), ("u", "ft2"): ("opened_original", 1, 1)}


def test_ordered_distinct_and_counts(spark):
    rows = spark.createDataFrame([("g", 3, "b"), ("g", 1, "a"), ("g", 2, "b"), ("g", 9, "a"), ("g", 2, "c"), ("h", 1, None), ("h", 2, "z")], "k string, n int, v string").repartition(4)
    assert {r["k"]: r["values"] for r in ordered_distinct(rows, ["k"], "v", "n").collect()} == {"g": ["a", "b", "c"], "h": ["z"]}
    assert {r["k"]: r["counts"] for r in value_counts(rows, ["k"], "v").collect()} == {"g": {"a": 2, "b": 2, "c": 1}, "h": {"unknown": 1, "z": 1}}
