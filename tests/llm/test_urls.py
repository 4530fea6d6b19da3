"""URL filters against a plain version of the rules and of the shrunken reputations."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rowmill.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")]


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]


def site(host):
    name = re.sub(r"(?s)^.*@|:[0-9]*$", "", host)
    labels = name.split(".")
    if re.match(r"^[0-9.]+$", name) or name.startswith("["):
        return name, "#"
    two = ".".join(labels[-2:])
    return (".".join(labels[-3:]), two) if two in urls.TWO_LABEL_SUFFIXES else (two, labels[-1])


def plain(pages, outcomes, most_bad, z):
    bad = {}
    for i, b in outcomes:
        if i is not None and b is not None:
            bad[i] = max(bad.get(i, 0), int(b))
    counts = {}
    for i, u in pages:
        n = counts.setdefault(parts(u)[0], [0, 0])
        if i in bad:
            n[0] += 1
            n[1] += bad[i]

    def above(children, parent):
        out = {}
        for c, (n, k) in children.items():
            x = out.setdefault(parent(c), [0, 0])
            x[0] += n
            x[1] += k
        return out

    def worth(children, parent):
        spread = room = 0.0
        for p in {parent(c) for c in children}:
            own = [(n, k) for c, (n, k) in children.items() if parent(c) == p and n]
            if own:
                n, k = (sum(x[j] for x in own) for j in (0, 1))
                chance = k / n * (1 - k / n)
                spread += sum(x[1] ** 2 / x[0] for x in own) - k * k / n - chance * (len(own) - 1)
                room += chance * (n - sum(x[0] ** 2 for x in own) / n - (len(own) - 1))
        rho = spread / room if room > 1e-9 else urls.USUAL_RHO
        return 1 / min(max(rho, urls.LEAST_RHO), urls.MOST_RHO) - 1

    suffix_of = {site(h)[0]: site(h)[1] for h in counts}
    domains = above(counts, lambda h: site(h)[0])
    suffixes = above(domains, suffix_of.get)
    n, k = (sum(x[j] for x in suffixes.values()) for j in (0, 1))
    top, w = (k + 0.5) / (n + 1), worth(suffixes, lambda s: "")
    s_mean = {s: (k + w * top) / (n + w) for s, (n, k) in suffixes.items()}
    w = worth(domains, suffix_of.get)
    d_mean = {d: (k + w * s_mean[suffix_of[d]]) / (n + w) for d, (n, k) in domains.items()}
    w = worth(counts, lambda h: site(h)[0])
    out = []
    for i, u in pages:
        host, path = parts(u)
        n, k = counts[host]
        m = d_mean[site(host)[0]]
        a, b = k + w * m, n - k + w * (1 - m)
        bound = max(0, a / (a + b) - z * math.sqrt(a * b / (a + b) ** 2 / (a + b + 1)))
        fit = [r for r in RULES if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        out.append((i, host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if bound >= most_bad else "allow", n, round(bound, 6)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    hosts = ["bad.example.com", "good.example.com", "a.farm.co.uk", "b.farm.co.uk", "x.example.net", "example.net", "net", "EXAMPLE.org", "10.0.0.1:80",
             "u@c.org:8080", "[::1]:3", "notexample.net", "é.ÉX.org", ""]
    pages = [(k, f"http://{rng.choice(hosts)}{rng.choice(['/en/1', '/de/x?y=://z', '', '?q=/en/', '/fr/#t', '#/de/', '/en', '/'])}") for k in range(900)]
    pages += [(900 + k, "https://hot.example.com/a") for k in range(1500)]
    pages += [(None, "http://a.net/"), (5000, None), (5001, ""), (5002, "no address"), (5003, "x\ny://h.org/fr/\n"), (3, "http://bad.example.com/"), (3, "http://bad.example.com/"),
              (5004, "http://" + "a." * 3000 + "net/" + "p" * 9000)]
    outcomes = [(i, "bad." in (u or "") or rng.random() < (0.8 if "farm" in (u or "") else 0.1)) for i, u in pages if rng.random() < 0.5]
    return pages, outcomes + [(None, True), (4, None), (3, True), (3, False), (99999, True)]


def _judged(spark, pages, outcomes, **more):
    df = spark.createDataFrame([(*p, "h", "x", 1) for p in pages], "page_id long, url string, host string, rules string, n long")
    known = spark.createDataFrame([(*o, "h") for o in outcomes], "id long, bad boolean, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = urls.judge_urls(df, known, rules, **more)
    return sorted((tuple(r) for r in out.select("id", "host", "path", "rule", "verdict", "n_labelled", F.round("bad_bound", 6)).collect()), key=repr)


def test_verdicts_equal_plain_version(spark, tables):
    got = _judged(spark, *tables)
    want = plain(*tables, 0.3, 1.2816)
    assert [g[:6] for g in got] == [w[:6] for w in want] and all(abs(g[6] - w[6]) < 2e-6 for g, w in zip(got, want))
    verdicts = {r[1]: r[4] for r in got if r[3] is None}
    assert verdicts["bad.example.com"] == "block" and verdicts["good.example.com"] == verdicts["hot.example.com"] == "allow"


def test_without_outcomes_rules_or_pages(spark, tables):
    got = _judged(spark, tables[0][:50], [])
    assert all(r[5] == 0 for r in got) and {r[4] for r in got if r[3] is None} <= {"allow", "block"}
    assert _judged(spark, [], tables[1]) == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame(tables[0][:50], "page_id long, url string")
    assert urls.judge_urls(df, spark.createDataFrame(tables[1], "id long, bad boolean"), none).where("rule is not null").count() == 0


def test_plan_holds_no_python(spark, tables):
    df = spark.createDataFrame(tables[0], "page_id long, url string")
    out = urls.judge_urls(df, spark.createDataFrame(tables[1], "id long, bad boolean"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
