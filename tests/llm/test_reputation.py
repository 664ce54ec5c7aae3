import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import reputation
from tidewell.llm.queries import op12_host_reputation
from tidewell.llm.reputation import Policy

PAGES = "page_id long, url string, html string, host string, verdict string, times long, n long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", "clash", "clash", 5, 5) for i, u in rows], PAGES)


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, good boolean")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = ""
    for at, c in enumerate(rest):
        if c in "/?#":
            path = rest[at:]
            break
        host += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    else:
        path = ""
    for end in "?#":
        path = path.split(end, 1)[0]
    return host, path


def rule_of(host, path):
    fits = [(len(r), v, r) for v, r in reputation.RULES if ("." + host).endswith("." + r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


def registered(host):
    name = host.split("@")[-1].split(":")[0].removesuffix(".")
    labels = name.split(".")
    if len(labels) == 4 and all(x.isdigit() for x in labels):
        return name, name
    if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in reputation.SECOND:
        return ".".join(labels[-3:]), ".".join(labels[-2:])
    return ".".join(labels[-2:]), labels[-1]


def brute(rows, good, policy=Policy()):
    """The same estimates with dictionaries."""
    seen = defaultdict(list)
    for i, g in good:
        if i is not None and g is not None:
            seen[i].append(g)
    n, y = defaultdict(int), defaultdict(int)
    for i, u in rows:
        host = split(u)[0]
        n[host] += len(seen.get(i, [])) if i is not None else 0
        y[host] += sum(seen.get(i, [])) if i is not None else 0

    def rolled(key):
        a, b = defaultdict(int), defaultdict(int)
        for host in n:
            a[key(host)] += n[host]
            b[key(host)] += y[host]
        return a, b

    def fitted(a, b, prior):
        pairs = [(a[k], b[k], prior(k)) for k in a if a[k] > 1]
        scale = sum(c * (c - 1) * m * (1 - m) for c, _, m in pairs)
        spread = sum((g - c * m) ** 2 - c * m * (1 - m) for c, g, m in pairs)
        s = policy.weakest if not scale else policy.strongest if spread <= 0 else min(policy.strongest, max(policy.weakest, scale / spread - 1))
        return s, {k: (s * prior(k) + b[k]) / (s + a[k]) for k in a}

    overall = (sum(y.values()) + 1) / (sum(n.values()) + 2)
    _, suffix = fitted(*rolled(lambda h: registered(h)[1]), lambda k: overall)
    parent = {registered(h)[0]: registered(h)[1] for h in n}
    _, domain = fitted(*rolled(lambda h: registered(h)[0]), lambda k: suffix[parent[k]])
    s, mean = fitted(n, y, lambda k: domain[registered(k)[0]])
    out = []
    for i, u in rows:
        host, path = split(u)
        verdict, rule = rule_of(host, path)
        m = mean[host]
        bound = m - policy.deviations * math.sqrt(m * (1 - m) / (s + n[host] + 1))
        out.append((i, host, path, rule, verdict or ("allow" if round(bound, 9) >= policy.floor else "block"), round(m, 6), round(bound, 6)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], round(r["reputation"], 6), round(r["bound"], 6)) for r in df.collect()], key=str)


URLS = [
    "http://Example.ORG/en/1", "http://example.org/en/2", "https://a.b.example.org/es/x?q=1", "http://notexample.org", "http://notexample.org/", "http://org/", "http://xorg/", "http://a.com/de/", "http://a.com/DE/",
    "http://a.com/fr/x#y", "http://b.co.uk/x", "http://www.b.co.uk:80/y", "http://co.uk/y", "http://10.0.0.1/x", "http://u@b.net./p", None, "", "no address", "http://", "http:///de/", "ftp://É.com/x://y", "x://y://z.com/de/", "http://c.net?x=/de/", "http://c.net#/",
]


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS))
    assert rows_of(reputation.judge(pages(spark, rows), outcomes(spark, []))) == brute(rows, [])


def test_against_dictionaries(spark):
    """A host with a third of all pages, hosts without outcomes, repeated rows and outcomes, null ids and outcomes."""
    rows, good = [], []
    for i in range(600):
        host = "hot.example.net" if i % 3 == 0 else f"h{i % 37}.d{i % 5}.net" if i % 3 == 1 else f"bad{i % 4}.spam.com"
        rows.append((i, f"http://{host}/p{i}"))
        if i % 2:
            good.append((i, i % 7 != 0 if "bad" not in host else i % 5 == 0))
    rows += rows[:20] + [(None, "http://hot.example.net/x"), (5000, "http://new.spam.com/x"), (5001, "http://new.d1.net/x"), (5002, "http://new.info/x")] + [(6000 + i, u) for i, u in enumerate(URLS)]
    good += good[:50] + [(None, True), (3, None), (999999, False)]
    got = rows_of(reputation.judge(pages(spark, rows), outcomes(spark, good)))
    assert got == brute(rows, good)
    verdicts = {r[1]: r[4] for r in got}
    assert verdicts["bad1.spam.com"] == verdicts["new.spam.com"] == "block" and verdicts["hot.example.net"] == verdicts["new.d1.net"] == "allow"


def test_a_strong_prior_shrinks_more(spark):
    rows = [(i, f"http://h{i % 10}.d.net/") for i in range(100)]
    good = [(i, i % 10 != 3) for i in range(100)]
    weak, strong = (brute(rows, good, Policy(weakest=s, strongest=s)) for s in (1.0, 1000.0))
    assert rows_of(reputation.judge(pages(spark, rows), outcomes(spark, good), policy=Policy(weakest=1000.0, strongest=1000.0))) == strong != weak


def test_empty_tables(spark):
    found = reputation.judge(pages(spark, []), outcomes(spark, []))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "reputation", "bound"] and found.count() == 0


def test_query_is_native_and_agrees_with_its_sql(spark, sf_dir):
    found = op12_host_reputation(spark, sf_dir)
    plan = found._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = db.execute(f"SELECT page_id, host, path, rule, verdict, round(reputation, 6), round(bound, 6) FROM ({reputation.sql()})").fetchall()
    assert rows_of(found) == sorted(want, key=str)


@pytest.mark.parametrize("host, want", [("a.b.co.uk", ("b.co.uk", "co.uk")), ("co.uk", ("co.uk", "uk")), ("x.y.z.com:8080", ("z.com", "com")), ("u@z.com.", ("z.com", "com")), ("localhost", ("localhost", "localhost")), ("", ("", "")), ("1.2.3.4", ("1.2.3.4", "1.2.3.4"))])
def test_registered_domains(spark, host, want):
    row = spark.range(1).select(reputation.domain_of(F.lit(host)), reputation.suffix_of(F.lit(host))).first()
    assert tuple(row) == want == registered(host)
