"""URL filters against a tree built by plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

from noticeworks.llm.queries import QUERIES, RULES
from noticeworks.llm.urlfilter import Rule, TemplateParams, judge_urls

DIR = "/root/testdata/sf0.01"
WILD = re.compile(r"^(?:[0-9][0-9._-]*|(?=[^.]*[0-9])[0-9A-Fa-f-]{8,}|.{32,})(?:\.[A-Za-z]{2,5})?$")


def slow(urls, rules, p):
    """The tree of every host by plain loops, depth by depth."""
    placed = []
    for u in urls:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.text)) if fit else None
        parts = list(filter(None, path.split("/")))
        if len(parts) > p.depth:
            parts = [*parts[: p.depth - 1], "/".join(parts[p.depth - 1 :])]
        segs = []
        for s in parts:
            ext = re.search(r"\.[A-Za-z]{2,5}$", s)
            segs.append("*" + (ext[0] if ext else "") if WILD.match(s) else s)
        placed.append((host, path, rule, tuple(segs)))

    def close(part, of, pool_part, pool_of):
        if not of or not pool_of:
            return False
        pool = pool_part / pool_of
        return abs(part / of - pool) <= p.z * math.sqrt(pool * (1 - pool) / of)

    names = [[] for _ in placed]
    parent = [None] * len(placed)
    for k in range(max((len(x[3]) for x in placed), default=0)):
        rows = [i for i, x in enumerate(placed) if len(x[3]) > k]
        node = defaultdict(Counter)
        for i in rows:
            host, _, rule, segs = placed[i]
            c = node[host, tuple(names[i]), segs[k]]
            c["n"] += 1
            c["l"] += rule is not None
            c["b"] += rule is not None and rule.verdict == "block"
            c["ends"] += len(segs) == k + 1
            c["wilds"] += len(segs) > k + 1 and segs[k + 1].startswith("*")
        above = defaultdict(Counter)
        for (h, pre, _), c in node.items():
            above[h, pre].update(c)
            above[h, pre]["kids"] += 1

        def free(h, pre, s):
            t = above[h, pre]
            return not s.startswith("*") and not (t["kids"] > p.many and t["n"] < p.repeats * t["kids"]) and t["kids"] > 1

        side, pool = {}, defaultdict(Counter)
        for x, c in node.items():
            t = above[x[:2]]
            if free(*x) and c["l"] >= p.support:
                side[x] = "~" if close(c["b"], c["l"], t["b"], t["l"]) else "~+" if c["b"] / c["l"] > t["b"] / t["l"] else "~-"
                pool[x[:2], side[x]].update(c)
        given = {}
        for x, c in node.items():
            t, joined = above[x[:2]], None
            if free(*x) and c["l"] < p.support:
                fits = [(g["n"], -i, s) for i, s in enumerate(("~", "~+", "~-")) if (g := pool[x[:2], s])["n"] and close(c["ends"], c["n"], g["ends"], g["n"]) and close(c["wilds"], c["n"], g["wilds"], g["n"])]
                joined = max(fits)[2] if fits else None
            many = t["kids"] > p.many and t["n"] < p.repeats * t["kids"]
            given[x] = x[2] if x[2].startswith("*") else "*" if many else side.get(x) or joined or x[2]
        for i in rows:
            x = placed[i][0], tuple(names[i]), placed[i][3][k]
            parent[i] = above[x[:2]]
        for i in rows:
            names[i].append(given[placed[i][0], tuple(names[i]), placed[i][3][k]])
    final = [(x[0], tuple(n)) for x, n in zip(placed, names, strict=True)]
    lab, blk = Counter(), Counter()
    for f, (host, _, rule, _) in zip(final, placed, strict=True):
        for key in (f, host):
            lab[key] += rule is not None
            blk[key] += rule is not None and rule.verdict == "block"
    out = []
    for f, up, (host, path, rule, _) in zip(final, parent, placed, strict=True):
        bad = False
        if lab[f] >= p.support:
            share = blk[host] / lab[host]
            share = share if up is None else (up["b"] + p.smoothing * share) / (up["l"] + p.smoothing)
            bad = (blk[f] + p.smoothing * share) / (lab[f] + p.smoothing) >= p.purity
        out.append((host, path, rule.text if rule else None, rule.verdict if rule else "block" if bad else "allow"))
    return out


def test_op9_equals_brute_force(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op9_urls"](spark, DIR).collect()}
    assert got == dict(zip((r.page_id for r in pages), slow([r.url for r in pages], RULES, TemplateParams()), strict=True))


def test_wildcards_merges_and_odd_urls(spark):
    rng = random.Random(9)
    rules = [Rule("block", "x.org", "/a/1"), Rule("block", "x.org", "/b/1"), Rule("allow", "x.org", "/c/"), Rule("block", "y.org", "/u"), Rule("allow", "org", "/u/ok")]
    urls = [f"http://{rng.choice(['x.org', 'WWW.x.org', 'y.org'])}/{rng.choice('abcd')}/{rng.choice([1, 12, 3, 45])}{rng.choice(['', '.html'])}" for _ in range(300)]
    urls += [f"https://y.org/{rng.choice(['u', 'v'])}/{''.join(rng.choices('pqrstuv', k=6))}/end?q=/x#y" for _ in range(200)] * 2
    urls += [None, "", "no scheme", "://", "a://H", "a://b://c/d", "x:///p", "http://x.org?a/1", "http://x.org/a/1\n/é/" + "9" * 5000, "http://notx.org/a/1", "http://y.org/u/ok"]
    for params in (TemplateParams(), TemplateParams(many=20, repeats=5, support=2, purity=0.6), TemplateParams(smoothing=0.5, purity=0.5, z=9.0)):
        rows = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, Host string, verdict int")
        got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(rows, rules, params=params).collect())
        assert got == [(i, *x) for i, x in enumerate(slow(urls, rules, params))]
    assert judge_urls(rows, rules).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert judge_urls(rows.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(rows, []).collect()} == {"allow"}


def test_pages_without_a_rule_get_both_verdicts_on_one_host(spark):
    """Templates decide: labelled ones, their merged siblings, children below merged branches; a lone label does not."""
    rules = [Rule("block", "x.org", "/ads/1"), Rule("block", "x.org", "/promo/1"), Rule("allow", "x.org", "/docs/a"), Rule("block", "x.org", "/odd")]
    urls = [f"http://x.org/{b}/{i}" for b in ("ads", "promo", "deals") for i in range(100, 160)] + [f"http://x.org/{b}/{i}" for b in ("ads", "promo", "deals") for i in range(200, 260)]
    urls += [f"http://x.org/docs/{a}{b}/{n}" for a in "ab" for b in "pqrs" for n in ("intro", "api")] * 3 + ["http://x.org/odd", "http://x.org/odder", "http://y.org/ads/1", None]
    got = {r.url: r.verdict for r in judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got["http://x.org/ads/205"] == got["http://x.org/promo/230"] == "block"
    assert got["http://x.org/deals/105"] == "block"  # no labels, but built like the merged branch
    assert got["http://x.org/docs/bp/intro"] == got["http://y.org/ads/1"] == got[None] == "allow"
    assert all(got[u] == x[3] for u, x in zip(urls, slow(urls, rules, TemplateParams()), strict=True))


def test_slugs_below_variable_names_pool(spark):
    """/u/<name>/<slug>: names become a wildcard first, so their slugs are counted together."""
    rng = random.Random(2)
    names = ["".join(rng.choices("bcdfgh", k=7)) for _ in range(80)]
    urls = [f"http://x.org/u/{n}/{s}" for n in names for s in ("photos", "likes")]
    rules = [Rule("block", "x.org", f"/u/{n}/likes") for n in names[:9]] + [Rule("allow", "x.org", f"/u/{n}/photos") for n in names[:9]]
    got = {r.url: r.verdict for r in judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got == {u: x[3] for u, x in zip(urls, slow(urls, rules, TemplateParams()), strict=True)}
    assert got[f"http://x.org/u/{names[50]}/likes"] == "block" and got[f"http://x.org/u/{names[50]}/photos"] == "allow"


def test_rules_leave_both_verdicts_on_the_table(spark):
    out = judge_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url"), RULES)
    counts = {r.verdict: r["count"] for r in out.filter("rule IS NULL").groupBy("verdict").count().collect()}
    assert counts["allow"] > 100 and counts["block"] > 100


def test_columns_of_the_caller_stay(spark):
    rows = spark.createDataFrame([("http://a.com/en/1", "keep", 1, 2)], "url string, __rule string, row int, template int")
    out = judge_urls(rows, [Rule("block", "com", "/en/")])
    assert out.columns == ["url", "__rule", "row", "template", "host", "path", "rule", "verdict"]
    assert tuple(out.first()) == ("http://a.com/en/1", "keep", 1, 2, "a.com", "/en/1", "com/en/", "block")


def test_deep_paths(spark):
    urls = ["http://x.org/" + "a/" * n + str(n) for n in (1, 3, 15, 16, 17, 40, 3000)] * 2
    params = TemplateParams(support=1, depth=5)
    got = [r.verdict for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), [Rule("block", "x.org", "/a/a/a/")], params=params).orderBy("page_id").collect()]
    assert got == [x[3] for x in slow(urls, [Rule("block", "x.org", "/a/a/a/")], params)]
