"""News coverage against a plan of publishers: every page is matched to its site, every required site needs a settled outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import ordered_distinct
from .evidence import ACCOUNTED, COMPLETED, page_outcome

#: Outcomes that an attempt may have.
VALID = (*ACCOUNTED, "failed")


def publisher_key(name: Column) -> Column:
    """A publisher's name in lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def match_pages(pages: DataFrame, plan: DataFrame, by: str) -> DataFrame:
    """The pages that a site of their plan claims, with its ``site_id``: the first in the plan's order whose publisher is the page's, or whose domain the page's host is or ends in.

    ``plan``: by, ordinal, site_id, publisher, domain; ``pages``: by, page_id, publisher, url. The two conditions are two joins by equality, hosts being spelled out into their
    suffixes; the plan is reduced to its first site a name and a domain before, so a page meets at most one site a name and label.
    """
    first = F.min(F.struct("ordinal", "site_id"))
    names = plan.select(by, publisher_key(F.col("publisher")).alias("key"), "ordinal", "site_id").where("key <> ''").groupBy(by, "key").agg(first.alias("site"))
    domains = plan.select(by, F.lower("domain").alias("key"), "ordinal", "site_id").where("coalesce(key, '') <> ''").groupBy(by, "key").agg(first.alias("site"))
    labels = F.split(host_of(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = pages.select(by, "page_id", publisher_key(F.col("publisher")).alias("key")).where("key <> ''").join(names, [by, "key"])
    hosted = pages.select(by, "page_id", F.explode(suffixes).alias("key")).where("key <> ''").join(domains, [by, "key"])
    both = named.select(by, "page_id", "site").unionByName(hosted.select(by, "page_id", "site"))
    return both.groupBy(by, "page_id").agg(F.min("site").alias("site")).select(by, "page_id", "site.site_id")


def off_plan(required: DataFrame, attempts: DataFrame, by: str) -> DataFrame:
    """(by, seq, warning): attempts at sites that the plan does not require, and those with an outcome that is none."""
    known = attempts.join(required.select(by, "site_id").distinct(), [by, "site_id"], "left_semi").where(~_valid())
    strange = attempts.join(required.select(by, "site_id"), [by, "site_id"], "left_anti")
    said = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("<missing>"))
    a = strange.select(by, "seq", F.concat(F.lit("attempt outside the required plan: "), said("site_id")).alias("warning"))
    return a.unionByName(known.select(by, "seq", F.concat(F.lit("invalid outcome for "), F.col("site_id"), F.lit(": "), said("outcome")).alias("warning")))


def _valid() -> Column:
    return F.coalesce(F.col("outcome").isin(*VALID), F.lit(False))


def required_sites(plan: DataFrame, by: str) -> DataFrame:
    """(by, site_id, ordinal) of the sites that must be attempted; those that do not say count, those without an id do not."""
    return plan.where(F.coalesce("must_attempt", F.lit(True)) & (F.coalesce("site_id", F.lit("")) != "")).groupBy(by, "site_id").agg(F.min("ordinal").alias("ordinal"))


def outcomes(plan: DataFrame, attempts: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """(by, site_id, ordinal, outcome, observed_pages, original_pages) of every required site; outcome null: silently skipped.

    The last valid attempt says what happened, the last page matched to the site overrides it, and a page opened in full, or an attempt that says so, overrides all.
    ``attempts``: by, site_id, seq, outcome; ``pages``: by, page_id (in order), publisher, url, access_state, capture_method. Only required sites claim pages.
    """
    sites = required_sites(plan, by)
    wanted = plan.where(F.coalesce("must_attempt", F.lit(True)) & (F.coalesce("site_id", F.lit("")) != ""))
    tried = attempts.where(_valid()).groupBy(by, "site_id").agg(F.max_by("outcome", "seq").alias("tried"))
    seen = pages.withColumn("o", page_outcome(F.coalesce("access_state", F.lit("unknown")), F.coalesce("capture_method", F.lit("search_result")))).select(by, "page_id", "o")
    met = match_pages(pages, wanted, by).join(seen, [by, "page_id"])
    found = met.groupBy(by, "site_id").agg(F.count("*").alias("observed_pages"), F.count_if(F.col("o") == "opened_original").alias("original_pages"), F.max_by("o", "page_id").alias("last_page"))
    j = sites.join(tried, [by, "site_id"], "left").join(found, [by, "site_id"], "left")
    outcome = F.when((F.col("original_pages") > 0) | (F.col("tried") == "opened_original"), "opened_original").otherwise(F.coalesce("last_page", "tried"))
    return j.select(by, "site_id", "ordinal", outcome.alias("outcome"), F.coalesce("observed_pages", F.lit(0)).alias("observed_pages"), F.coalesce("original_pages", F.lit(0)).alias("original_pages"))


def gate(plan: DataFrame, attempts: DataFrame, pages: DataFrame, by: str, key_site: str | None = None) -> DataFrame:
    """The coverage gate of each plan, with the publishers that are missing, failed or unresolved, status and warnings.

    It passes if every required site is settled: not skipped, not failed, not left at search results. ``key_site`` is reported by itself
    (``key_site_attempted``). Warnings stand once each: attempts outside the plan and invalid ones by their order, then what the gate lacks.
    """
    o = outcomes(plan, attempts, pages, by)
    inside = lambda words: F.count_if(F.coalesce(F.col("outcome").isin(*words), F.lit(False)))
    # a plan's sites are some tens, so lists of them are short
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ordinal", "site_id")))), lambda x: x["site_id"])
    g = o.groupBy(by).agg(
        F.count("*").alias("required_publishers"), inside(ACCOUNTED).alias("accounted_publishers"), inside(COMPLETED).alias("completed_publishers"), F.sum("original_pages").alias("opened_original_pages"),
        listed(F.col("outcome").isNull()).alias("missing_publishers"), listed(F.col("outcome") == "failed").alias("failed_publishers"), listed(F.col("outcome") == "search_results_only").alias("unresolved_publishers"),
        F.bool_or((F.col("site_id") == F.lit(key_site)) & F.coalesce(F.col("outcome").isin(*ACCOUNTED), F.lit(False))).alias("key_site_attempted"),
    )
    passed = F.col("completed_publishers") == F.col("required_publishers")
    status = F.when(passed & (F.col("opened_original_pages") > 0), "complete").when(passed, "degraded").otherwise("incomplete")
    odd = ordered_distinct(off_plan(required_sites(plan, by), attempts, by), [by], "warning", "seq", "odd")
    lacks = F.array_compact(F.array(
        F.when(F.col("opened_original_pages") == 0, "no original page was opened"), *[F.when(F.size(f"{k}_publishers") > 0, F.concat(F.lit(text), F.array_join(f"{k}_publishers", ", "))) for k, text in (
            ("missing", "silently skipped: "), ("failed", "failed: "), ("unresolved", "not resolved beyond search results: "))],
    ))
    j = g.join(odd, by, "left")
    return j.select(
        by, "required_publishers", "accounted_publishers", "completed_publishers", (F.col("accounted_publishers") == F.col("required_publishers")).alias("all_accounted_for"), passed.alias("passed"), status.alias("status"), F.coalesce("key_site_attempted", F.lit(False)).alias("key_site_attempted"),
        "opened_original_pages", "missing_publishers", "failed_publishers", "unresolved_publishers", F.concat(F.coalesce("odd", F.array().cast("array<string>")), lacks).alias("warnings"),
    )
