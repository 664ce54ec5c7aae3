"""Host reputation by empirical Bayes: labelled page outcomes, shrunk from host to registered domain to suffix.

Built from DataFrame operations alone. Outcomes are counted by host before anything is shuffled, so
a host with a third of the pages is one row a task; hosts are counted by domain, domains by suffix.
Each level's share of good pages has a beta prior around the estimate of the level above, whose
strength is fitted by moments over all its members. A page is judged by the lower bound of its
host's posterior, unless a rule fits its address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_classes

#: (verdict, host and start of the path); the longest that fits decides.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Second labels that make a suffix of two labels under a country's label.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
#: The address's pattern: what follows the first ``://``, host and path.
ADDRESS = r"://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Policy:
    """A page is allowed if its host's share of good pages is at least ``floor``, ``deviations`` of the posterior below its mean."""

    floor: float = 0.5
    deviations: float = 1.645
    #: The bounds of a prior's strength, in pages.
    weakest: float = 1.0
    strongest: float = 10_000.0


def host_of(url: Column) -> Column:
    """The host with A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The suffix that names are registered under: the last label, or two where a country's has such second labels. Addresses of four numbers have themselves."""
    name = _name(host)
    two = F.regexp_extract(name, rf"[^.]+\.((?:{'|'.join(SECOND)})\.[a-z][a-z])$", 1)
    return F.when(_numeric(name), name).when(two != "", two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more, or the host where it has no more."""
    name = _name(host)
    two = F.regexp_extract(name, rf"([^.]+\.(?:{'|'.join(SECOND)})\.[a-z][a-z])$", 1)
    return F.when(_numeric(name), name).when(two != "", two).otherwise(F.regexp_extract(name, r"([^.]+\.[^.]*|[^.]*)$", 1))


def _name(host: Column) -> Column:
    """The host without user, port and closing dot."""
    return F.regexp_replace(host, r"^[^@]*@|:[0-9]*$|\.(?::[0-9]*)?$", "")


def _numeric(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, null if none does; a rule fits its host and all subdomains where the path begins with its own."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    # of rules of one length the one of the longer host comes first
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        where, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _outcomes(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a host: its pages (``times``), its labelled outcomes (n) and the good ones of these (y)."""
    labelled = outcomes.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("good").alias("y"))
    met = pages.groupBy("page_id", "host").agg(F.count("*").alias("times")).join(labelled, "page_id", "left")
    counted = lambda c: F.coalesce(F.sum(F.col(c) * F.col("times")), F.lit(0))
    return met.groupBy("host").agg(F.sum("times").alias("times"), counted("n").alias("n"), counted("y").alias("y"))


def _strength(members: DataFrame, policy: Policy) -> float:
    """The prior's strength from members (n, y, m: the estimate of the level above), by moments.

    With strength s the square of y - n m has the mean n m (1 - m) (1 + (n - 1) / (s + 1)). Members without two outcomes say nothing; where none says anything the prior is the weakest.
    """
    spread = F.sum(F.pow(F.col("y") - F.col("n") * F.col("m"), 2) - F.col("n") * F.col("m") * (1 - F.col("m")))
    scale = F.sum(F.col("n").cast("double") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    found = members.where("n > 1").agg(spread.alias("spread"), scale.alias("scale")).first()
    if not found["scale"]:
        return policy.weakest
    share = found["spread"] / found["scale"]
    return min(policy.strongest, max(policy.weakest, 1 / share - 1)) if share > 0 else policy.strongest


def reputations(pages: DataFrame, outcomes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(host, times, domain, suffix, n, y, mean, bound) for every host of ``pages`` (page_id, host), from ``outcomes`` (page_id, good).

    ``mean`` is the posterior's, ``bound`` lies ``deviations`` of its standard deviations lower. A page's outcomes may repeat
    and then all count; so do rows of ``pages``. Outcomes of unknown pages and null ones do not. Hosts without an outcome have the estimate
    of their domain, those of a domain without one that of the suffix, then that of all.
    """
    hosts = cut(_outcomes(pages, outcomes).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    overall = (total["y"] + 1) / (total["n"] + 2)
    counts = (F.sum("n").alias("n"), F.sum("y").alias("y"), F.count("*").alias("times"))
    domains = cut(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), *counts))
    suffixes = cut(domains.groupBy("suffix").agg(*counts))

    def estimated(members: DataFrame) -> DataFrame:
        strength = F.lit(_strength(members, policy))
        return members.withColumn("strength", strength + F.col("n")).withColumn("mean", (strength * F.col("m") + F.col("y")) / F.col("strength"))

    def above(level: DataFrame, key: str) -> DataFrame:
        return level.select(key, "times", F.col("mean").alias("m"))

    suffixes = cut(estimated(suffixes.withColumn("m", F.lit(overall))))
    domains = cut(estimated(cut(join_classes(domains.withColumnRenamed("times", "hosts"), above(suffixes, "suffix"), ["suffix"]).withColumnRenamed("hosts", "times"))))
    hosts = cut(join_classes(hosts.withColumnRenamed("times", "pages"), above(domains, "domain"), ["domain"]).withColumnRenamed("pages", "times"))
    bound = F.col("mean") - F.lit(policy.deviations) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    # nine digits: sums of doubles in another order give the same bound
    return estimated(hosts).select("host", "times", "domain", "suffix", "n", "y", F.round("mean", 9).alias("mean"), F.round(bound, 9).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, policy: Policy = Policy(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation, bound): every row of ``pages`` is allowed or blocked.

    A rule that fits decides, the longest of several; other pages are allowed if the bound of their host's posterior is ``floor`` or
    more. Null addresses and those without ``://`` have an empty host and path and are judged as the pages of that host.
    A null id stays null and has no outcome. Rows that repeat stay; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    url = F.col(f"`{url_col}`").cast("string")
    slim = cut(pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")))
    known = cut(reputations(slim, outcomes, policy).select("host", "times", F.col("mean").alias("reputation"), "bound"))
    met = join_classes(slim, known, ["host"]).withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") >= policy.floor, "allow").otherwise("block")
    return met.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"), "reputation", "bound")


def sql(policy: Policy = Policy()) -> str:
    """The same over ``pages`` and ``labels``: a label of a page's id is its outcome, good if of quality and not toxic."""
    second = "|".join(SECOND)
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    strength = lambda level: f"""(SELECT CASE WHEN coalesce(scale, 0) = 0 THEN {policy.weakest}::DOUBLE WHEN spread <= 0 THEN {policy.strongest}::DOUBLE
      ELSE least({policy.strongest}::DOUBLE, greatest({policy.weakest}::DOUBLE, 1 / (spread / scale) - 1)) END FROM (SELECT sum(pow(y - n * m, 2) - n * m * (1 - m)) AS spread, sum(n::DOUBLE * (n - 1) * m * (1 - m)) AS scale FROM {level} WHERE n > 1))"""  # noqa: E731
    ordered = [(v, r, r[: r.index("/")], r[r.index("/") :]) for v, r in sorted(RULES, key=lambda r: (-len(r[1]), -r[1].index("/")))]
    rules = " ".join(f"WHEN (host = '{where}' OR ends_with(host, '.{where}')) AND starts_with(path, '{start}') THEN '{r}'" for _, r, where, start in ordered)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r, _, _ in ordered)
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{ADDRESS}', 1), ''), {upper}) AS host, coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS y FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(y), 0)::DOUBLE AS y, regexp_replace(host, '^[^@]*@|:[0-9]*$|\\.(?::[0-9]*)?$', '', 'g') AS name FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_matches(name, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') AS ip, regexp_extract(name, '([^.]+\\.(?:{second})\\.[a-z][a-z])$', 1) AS two FROM h0),
h AS (SELECT host, n, y, CASE WHEN ip THEN name WHEN two <> '' THEN two ELSE regexp_extract(name, '([^.]+\\.[^.]*|[^.]*)$', 1) END AS domain,
  CASE WHEN ip THEN name WHEN two <> '' THEN regexp_extract(two, '^[^.]+\\.(.*)$', 1) ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix FROM h1),
s0 AS (SELECT suffix, sum(n) AS n, sum(y) AS y, (SELECT (sum(y) + 1) / (sum(n) + 2) FROM h) AS m FROM h GROUP BY 1),
s AS (SELECT suffix, (k * m + y) / (k + n) AS mean FROM (SELECT *, {strength("s0")} AS k FROM s0)),
d0 AS (SELECT domain, sum(n) AS n, sum(y) AS y, any_value(s.mean) AS m FROM h JOIN s USING (suffix) GROUP BY 1),
d AS (SELECT domain, (k * m + y) / (k + n) AS mean FROM (SELECT *, {strength("d0")} AS k FROM d0)),
e0 AS (SELECT host, n, y, d.mean AS m FROM h JOIN d USING (domain)),
e1 AS (SELECT host, k + n AS t, (k * m + y) / (k + n) AS mean FROM (SELECT *, {strength("e0")} AS k FROM e0)),
e AS (SELECT host, round(mean, 9) AS reputation, round(mean - {policy.deviations}::DOUBLE * sqrt(mean * (1 - mean) / (t + 1)), 9) AS bound FROM e1),
j AS (SELECT page_id, host, path, reputation, bound, CASE {rules} END AS rule FROM p JOIN e USING (host))
SELECT page_id, host, path, rule, CASE {verdicts} WHEN bound >= {policy.floor} THEN 'allow' ELSE 'block' END AS verdict, reputation, bound FROM j
"""
