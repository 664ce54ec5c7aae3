"""Facts, their validation, news coverage gates and evidence packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("claim", "publisher", "source_url", "retrieved_at", "period")
#: Roles that point to evidence without being it.
LEADS = ("discovery_lead", "publisher_index")
#: Outcomes that account for a publisher, and those that settle it.
ACCOUNTED = ("opened_original", "no_relevant_result", "paywalled", "login_required", "search_results_only")
COMPLETED = ("opened_original", "no_relevant_result", "paywalled", "login_required")


def substantive() -> Column:
    """A fact that supports something: no lead, and more than metadata; a missing role counts."""
    return ~F.coalesce(F.col("evidence_role").isin(*LEADS), F.lit(False)) & ~F.coalesce(F.col("observation_scope") == "metadata_only", F.lit(False))


def validate_facts(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Facts with their errors and warnings; within ``keys`` a fact id may stand once, the first by ``seq`` is the one."""
    # facts without an id repeat nothing; each is a partition of its own, so that no task gathers them
    alone = F.when(F.coalesce(F.col("fact_id"), F.lit("")) == "", F.col("seq"))
    by = Window.partitionBy(*(keys or []), "fact_id", alone)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    url = F.coalesce(F.col("source_url"), F.lit(""))
    errors = [F.when(blank("fact_id"), "missing fact_id"), F.when(~blank("fact_id") & (F.row_number().over(by.orderBy("seq")) > 1), "duplicate fact_id")]
    errors += [F.when(blank(c), f"missing {c}") for c in REQUIRED]
    errors += [
        F.when(~F.regexp_like(url, F.lit(r"^https?://[^/?#]+")), "invalid source_url"), F.when(~blank("retrieved_at") & F.try_to_timestamp(F.col("retrieved_at")).isNull(), "invalid retrieved_at"),
        F.when(F.col("value").isNotNull() & blank("unit"), "missing unit"),
    ]
    return facts.withColumns({"errors": F.array_compact(F.array(*errors)), "warnings": F.array_compact(F.array(F.when(F.contains(url, F.lit("REDACTED")), "redacted credentials")))})


def validate_documents(validated: DataFrame, by: str) -> DataFrame:
    """A row for each document: validity, counts, and how many facts are only leads or metadata."""
    return validated.groupBy(by).agg(
        F.count("*").alias("facts"), F.sum(F.size("errors")).cast("long").alias("error_count"), (F.sum(F.size("errors")) == 0).alias("valid"),
        F.count_if(~substantive()).alias("metadata_only"), F.count_if(substantive()).alias("substantive"),
    )


def evidence_pack(*sources: DataFrame) -> DataFrame:
    """The union of fact tables, by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def source_gate(attempts: DataFrame, by: str, min_sources: int = 3, min_facts: int = 3) -> DataFrame:
    """Whether the first-choice sources of each ``by`` suffice: enough succeeded, enough items matched, each has an outcome.

    ``attempts`` has source, outcome (success, failed or null), retrieval (fresh, cached, stale) and matched.
    """
    ok = F.col("outcome") == "success"
    g = attempts.groupBy(by).agg(
        F.count("*").alias("selected"), F.count_if(ok).alias("successes"), F.count_if(F.col("outcome") == "failed").alias("failures"), F.count_if(ok & (F.col("retrieval") == "stale")).alias("stale"),
        F.count_if(ok & (F.col("retrieval") == "cached")).alias("cached"), F.coalesce(F.sum(F.when(ok, F.col("matched"))), F.lit(0)).alias("facts"), F.count_if(F.col("outcome").isNull()).alias("silent"),
    )
    enough = F.col("successes") >= F.least(F.lit(max(1, min_sources)), F.col("selected"))
    found = F.col("facts") >= max(1, min_facts)
    status = F.when(F.col("successes") == 0, "failed").when((F.col("failures") > 0) | (F.col("stale") > 0), "degraded").when(F.col("cached") == F.col("successes"), "cached").otherwise("fresh")
    return g.select(by, "selected", "successes", "failures", "facts", (F.col("silent") == 0).alias("all_source_outcomes_explicit"), (enough & found).alias("primary_sufficient"), status.alias("status"),
                    F.concat_ws(",", F.when(~enough, "too few sources"), F.when(~found, "too few items")).alias("reasons"))


def match_sites(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Pages with the planned site whose domain their host is or ends in; of several the longest domain.

    Each host is spelled out into its suffixes, so this is an equi-join, not a comparison of all pairs.
    """
    labels = F.split(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spelled = pages.select("page_id", F.explode(suffixes).alias("domain"))
    hit = spelled.join(plan, "domain")
    return hit.groupBy("page_id").agg(F.max_by("domain", F.length("domain")).alias("domain"))


def page_outcome(access: Column, method: Column) -> Column:
    return F.when(access == "paywalled", "paywalled").when(access == "login_required", "login_required").when((method == "visible_original_page") & access.isin("open", "signed_in"), "opened_original").otherwise("search_results_only")


def coverage_gate(plan: DataFrame, attempts: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """Whether every required publisher of each plan has a settled outcome.

    The last attempt says what happened, a later page overrides it, and a page opened in full overrides all.
    ``plan``: by, site_id; ``attempts``: site_id, seq, outcome; ``pages``: site_id, seq, access_state, capture_method.
    """
    a = attempts.groupBy("site_id").agg(F.max_by("outcome", "seq").alias("tried"))
    p = pages.withColumn("o", page_outcome(F.col("access_state"), F.col("capture_method"))).groupBy("site_id").agg(
        F.count("*").alias("observed"), F.count_if(F.col("o") == "opened_original").alias("originals"), F.max_by("o", "seq").alias("last_page")
    )
    j = plan.join(a, "site_id", "left").join(p, "site_id", "left")
    outcome = F.when((F.col("originals") > 0) | (F.col("tried") == "opened_original"), "opened_original").otherwise(F.coalesce("last_page", "tried"))
    j = j.withColumn("outcome", outcome)
    inside = lambda names: F.count_if(F.coalesce(F.col("outcome").isin(*names), F.lit(False)))
    g = j.groupBy(by).agg(
        F.count("*").alias("required_publishers"), inside(ACCOUNTED).alias("accounted"), inside(COMPLETED).alias("completed"), F.count_if(F.col("outcome").isNull()).alias("missing"),
        F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "search_results_only").alias("unresolved"), F.coalesce(F.sum("originals"), F.lit(0)).alias("opened_original_pages"),
    )
    passed = (F.col("missing") == 0) & (F.col("failed") == 0) & (F.col("unresolved") == 0) & (F.col("completed") == F.col("required_publishers"))
    return g.withColumn("passed", passed).withColumn("status", F.when(passed & (F.col("opened_original_pages") > 0), "complete").when(passed, "degraded").otherwise("incomplete"))


def collection_gate(primary: DataFrame, fallback: DataFrame, by: str) -> DataFrame:
    """Primary and fallback coverage together: the fallback counts only where the primary fails, and then it must pass."""
    j = primary.join(fallback.select(by, F.col("passed").alias("fallback_passed")), by, "left")
    required = ~F.col("primary_sufficient") | ~F.col("all_source_outcomes_explicit")
    through = F.coalesce("fallback_passed", F.lit(False))
    passed = F.col("all_source_outcomes_explicit") & F.when(required, through).otherwise(F.col("primary_sufficient"))
    return j.select(by, "primary_sufficient", required.alias("fallback_required"), F.col("fallback_passed").isNotNull().alias("fallback_provided"), through.alias("fallback_passed"), passed.alias("passed"),
                    F.when(required & through, "degraded").when(passed, "complete").otherwise("incomplete").alias("status"))
