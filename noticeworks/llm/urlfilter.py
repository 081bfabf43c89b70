"""URL filters: stated rules, and a path-template tree learned per host for what they leave open.

Paths become templates: numbers, hashes and long segments are wildcards (with their extension). Then the tree of a host is generalised
from the root down, one depth after the other, each on the names that the depth before has got:

- where a node has many children that hardly repeat, all of them become one wildcard;
- labelled children become one branch if their share of blocked pages does not differ from that of all labelled siblings (two-proportion
  test), those beyond it become another one, those below it a third;
- children without enough labels join the branch that they are built like: as large a share of their pages ends there, and as large a
  share goes on with a wildcard (two-proportion tests again); of several, the one of most pages.

A template is rejected if it has enough labelled pages of its own, and the share of blocked among them, smoothed towards the share below its
parent and this towards that of its host, reaches a threshold. What has no labelled company is allowed.

The tree is never a tree in memory: every node is a row keyed by host and prefix, pages are summed up per template before
anything else, and parents meet children by sums and joins, so a host with a third of all pages is one partial sum per task. The
templates are written once per depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WILD = "*"
#: Merged branches: like all labelled siblings, more often blocked, less often.
MERGED = ("~", "~+", "~-")


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host, its subdomains, and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TemplateParams:
    """When children become one wildcard, when branches count as alike, and when a template is rejected."""

    many: int = 50
    repeats: float = 3.0
    z: float = 1.96
    support: int = 5
    smoothing: float = 2.0
    purity: float = 0.8
    #: Segments behind this many count as one.
    depth: int = 16


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, of equally long ones the first; null if none. The rules are a short list and become one expression."""
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in rules]
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i].text))
    return F.coalesce(*[F.when(fits[i], F.lit(rules[i].text)) for i in order], F.lit(None).cast("string"))


def segments(path: Column, depth: int = TemplateParams.depth) -> Column:
    """Segments of a path, variable ones as wildcards that keep a file extension; what is behind ``depth`` of them is one."""

    def general(s: Column) -> Column:
        wild = s.rlike(r"^(?:[0-9][0-9._-]*|(?=[^.]*[0-9])[0-9A-Fa-f-]{8,}|.{32,})(?:\.[A-Za-z]{2,5})?$")
        return F.when(wild, F.concat(F.lit(WILD), F.regexp_extract(s, r"\.[A-Za-z]{2,5}$", 0))).otherwise(s)

    cut = F.filter(F.split(path, "/"), lambda s: s != "")
    tail = F.array_join(F.slice(cut, depth, F.greatest(F.size(cut), F.lit(1))), "/")
    return F.transform(F.when(F.size(cut) > depth, F.concat(F.slice(cut, 1, depth - 1), F.array(tail))).otherwise(cut), general)


def _named(templates: DataFrame, k: int, p: TemplateParams) -> DataFrame:
    """(host, prefix, seg, name, p_l, p_b) of the segments at depth ``k`` below the prefixes that the depths before have got."""
    after = F.get("segs", F.lit(k + 1))
    nodes = templates.filter(F.size("segs") > k).groupBy("host", "prefix", F.get("segs", F.lit(k)).alias("seg")).agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"),
        F.sum(F.when(F.size("segs") == k + 1, F.col("n")).otherwise(0)).alias("ends"),
        F.sum(F.when(F.coalesce(after.startswith(WILD), F.lit(False)), F.col("n")).otherwise(0)).alias("wilds"),
    )
    parents = nodes.groupBy("host", "prefix").agg(F.count("*").alias("kids"), F.sum("n").alias("p_n"), F.sum("l").alias("p_l"), F.sum("b").alias("p_b"))
    seen = nodes.join(parents, ["host", "prefix"])

    def close(part: str, of: str, pool_part: str, pool_of: str) -> Column:
        share, pool = F.try_divide(part, of), F.try_divide(pool_part, pool_of)
        return F.coalesce(F.abs(share - pool) <= p.z * F.sqrt(F.try_divide(pool * (1 - pool), F.col(of))), F.lit(False))

    many = (F.col("kids") > p.many) & (F.col("p_n") < p.repeats * F.col("kids"))
    free = ~F.col("seg").startswith(WILD) & ~many & (F.col("kids") > 1)
    like, more, less = MERGED
    beyond = F.try_divide("b", "l") > F.try_divide("p_b", "p_l")
    side = F.when(free & (F.col("l") >= p.support), F.when(close("b", "l", "p_b", "p_l"), F.lit(like)).when(beyond, F.lit(more)).otherwise(F.lit(less)))
    seen = seen.withColumn("side", side)
    sums = [F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"g{i}_{c}") for i, s in enumerate(MERGED) for c in ("n", "ends", "wilds")]
    pools = seen.filter("side IS NOT NULL").groupBy("host", "prefix").agg(*sums)
    f0, f1, f2 = (free & (F.col("l") < p.support) & close("ends", "n", f"g{i}_ends", f"g{i}_n") & close("wilds", "n", f"g{i}_wilds", f"g{i}_n") for i in range(3))
    g0, g1, g2 = (F.col(f"g{i}_n") for i in range(3))
    built = (
        F.when(f0 & (~f1 | (g0 >= g1)) & (~f2 | (g0 >= g2)), F.lit(like)).when(f1 & (~f0 | (g1 > g0)) & (~f2 | (g1 >= g2)), F.lit(more)).when(f2, F.lit(less))
    )
    name = F.when(F.col("seg").startswith(WILD), F.col("seg")).when(many, F.lit(WILD)).otherwise(F.coalesce("side", built, "seg"))
    return seen.join(pools, ["host", "prefix"], "left").select("host", "prefix", "seg", name.alias("name"), "p_l", "p_b")


def learn_templates(labelled: DataFrame, params: TemplateParams) -> DataFrame:
    """(host, template, final, purity, rejected) for each host and template of ``labelled`` (host, path, label: true blocked, false allowed, null unknown).

    The purity is null on a host without a label.
    """
    templates = (
        labelled.withColumn("segs", segments(F.col("path"), params.depth))
        .withColumn("template", F.array_join("segs", "/"))
        .groupBy("host", "template")
        .agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("blocked"), F.first("segs").alias("segs"))
    )
    none = F.lit(None).cast("long")
    templates = cut_lineage(templates.withColumns({"prefix": F.lit(""), "p_l": none, "p_b": none}))
    for k in range(templates.agg(F.coalesce(F.max(F.size("segs")), F.lit(0))).first()[0]):
        named = _named(templates, k, params).withColumnsRenamed({"p_l": "k_l", "p_b": "k_b"})
        here = templates.filter(F.size("segs") > k).withColumn("seg", F.get("segs", F.lit(k))).join(named, ["host", "prefix", "seg"])
        here = here.withColumns({"prefix": F.concat("prefix", F.lit("/"), "name"), "p_l": F.col("k_l"), "p_b": F.col("k_b")}).select(*templates.columns)
        templates = cut_lineage(templates.filter(F.size("segs") <= k).unionByName(here))
    hosts = templates.groupBy("host").agg(F.sum("labelled").alias("h_l"), F.sum("blocked").alias("h_b"))
    pure = templates.groupBy("host", F.col("prefix").alias("final")).agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.first("p_l").alias("p_l"), F.first("p_b").alias("p_b"))
    host = F.try_divide("h_b", "h_l")
    parent = F.when(F.col("p_l").isNull(), host).otherwise((F.col("p_b") + params.smoothing * host) / (F.col("p_l") + params.smoothing))
    purity = (F.col("b") + params.smoothing * parent) / (F.col("l") + params.smoothing)
    rejected = (F.col("l") >= params.support) & F.coalesce(purity >= params.purity, F.lit(False))
    judged = pure.join(hosts, "host").select("host", "final", purity.alias("purity"), rejected.alias("rejected"))
    return templates.select("host", "template", F.col("prefix").alias("final")).join(judged, ["host", "final"])


def judge_urls(pages: DataFrame, rules: list[Rule], *, url_col: str = "url", params: TemplateParams = TemplateParams()) -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict (block or allow).

    A rule's verdict stands; pages without a rule are judged by the template they share with pages under rules, and allowed if it is not
    rejected. Null urls and those without ``://`` have an empty host and path. Repeated rows are judged alike and each count; no rows give
    none; long urls are read whole. Columns of ``pages`` named like an added one are replaced, any others stay.
    """
    added, url = ("host", "path", "rule", "verdict"), F.col(url_col)
    kept = [c for c in pages.columns if c.lower() not in added or c == url_col]
    placed = pages.select(F.struct(*kept).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    placed = placed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r.text for r in rules if r.verdict == "block"])
    learned = learn_templates(placed.select("host", "path", blocked.alias("label")), params)
    rejected = learned.filter("rejected").select("host", "template", F.lit(True).alias("bad"))
    judged = placed.withColumn("template", F.array_join(segments(F.col("path"), params.depth), "/")).join(rejected, ["host", "template"], "left")
    verdict = F.when(F.coalesce(blocked, F.col("bad"), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    out = [F.col("row").getField(c).alias(c) for c in kept if c not in added]
    return judged.select(*out, "host", "path", "rule", verdict.alias("verdict"))


def oracle_sql(rules: list[Rule], params: TemplateParams = TemplateParams(), depth: int = 4) -> str:
    """The same judgement over ``pages`` as DuckDB SQL, for paths of at most ``depth`` segments."""
    order = sorted(rules, key=lambda r: -len(r.text))
    fits = " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in order)
    blocking = ", ".join(f"'{r.text}'" for r in rules if r.verdict == "block")
    p = params

    def close(part: str, of: str, pool_part: str, pool_of: str) -> str:
        return f"coalesce(abs({part} / {of} - {pool_part} / {pool_of}) <= {p.z} * sqrt({pool_part} / {pool_of} * (1 - {pool_part} / {pool_of}) / {of}), false)"

    levels = "".join(rf"""
    nodes{k} AS (
        SELECT host, prefix, segs[{k}] AS seg, sum(n) AS n, sum(l) AS l, sum(b) AS b, sum(CASE WHEN len(segs) = {k} THEN n ELSE 0 END) AS ends,
            sum(CASE WHEN len(segs) > {k} AND starts_with(segs[{k + 1}], '{WILD}') THEN n ELSE 0 END) AS wilds
        FROM t{k - 1} WHERE len(segs) >= {k} GROUP BY ALL),
    seen{k} AS (
        SELECT *, NOT starts_with(seg, '{WILD}') AND NOT many AND kids > 1 AS free FROM (
            SELECT *, kids > {p.many} AND p_n < {p.repeats} * kids AS many
            FROM nodes{k} JOIN (SELECT host, prefix, count(*) AS kids, sum(n) AS p_n, sum(l) AS p_l, sum(b) AS p_b FROM nodes{k} GROUP BY ALL) USING (host, prefix))),
    sided{k} AS (SELECT *, CASE WHEN free AND l >= {p.support} THEN CASE WHEN {close("b", "l", "p_b", "p_l")} THEN '{MERGED[0]}'
        WHEN b / l > p_b / p_l THEN '{MERGED[1]}' ELSE '{MERGED[2]}' END END AS side FROM seen{k}),
    pools{k} AS (SELECT host, prefix, side, sum(n) AS n, sum(ends) AS ends, sum(wilds) AS wilds FROM sided{k} WHERE side IS NOT NULL GROUP BY ALL),
    built{k} AS (
        SELECT s.host, s.prefix, seg, g.side AS joined, row_number() OVER (PARTITION BY s.host, s.prefix, seg ORDER BY g.n DESC, g.side) AS rank
        FROM sided{k} s JOIN pools{k} g ON s.host = g.host AND s.prefix = g.prefix
        WHERE free AND l < {p.support} AND {close("s.ends", "s.n", "g.ends", "g.n")} AND {close("s.wilds", "s.n", "g.wilds", "g.n")}),
    named{k} AS (
        SELECT host, prefix, seg, p_l AS k_l, p_b AS k_b,
            CASE WHEN starts_with(seg, '{WILD}') THEN seg WHEN many THEN '{WILD}' ELSE coalesce(side, joined, seg) END AS name
        FROM sided{k} LEFT JOIN (SELECT * FROM built{k} WHERE rank = 1) USING (host, prefix, seg)),
    t{k} AS (
        SELECT t.host, t.segs, n, l, b, CASE WHEN name IS NULL THEN t.prefix ELSE concat(t.prefix, '/', name) END AS prefix,
            CASE WHEN name IS NULL THEN p_l ELSE k_l END AS p_l, CASE WHEN name IS NULL THEN p_b ELSE k_b END AS p_b
        FROM t{k - 1} t LEFT JOIN named{k} m ON t.host = m.host AND t.prefix = m.prefix AND len(t.segs) >= {k} AND t.segs[{k}] = m.seg),""" for k in range(1, depth + 1))  # fmt: skip
    return rf"""
    WITH placed AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    ruled AS (SELECT *, CASE {fits} END AS rule FROM placed),
    cut AS (
        SELECT *, CASE WHEN rule IN ({blocking}) THEN 1 WHEN rule IS NOT NULL THEN 0 END AS label,
            list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE
                WHEN regexp_matches(s, '^[0-9][0-9._-]*(?:\.[A-Za-z]{{2,5}})?$') OR regexp_matches(s, '^.{{32,}}(?:\.[A-Za-z]{{2,5}})?$')
                    OR (regexp_matches(s, '^[0-9A-Fa-f-]{{8,}}(?:\.[A-Za-z]{{2,5}})?$') AND regexp_matches(s, '^[^.]*[0-9]'))
                THEN concat('{WILD}', regexp_extract(s, '\.[A-Za-z]{{2,5}}$')) ELSE s END) AS segs FROM ruled),
    t0 AS (SELECT host, segs, count(*) AS n, count(label) AS l, coalesce(sum(label), 0) AS b, '' AS prefix, NULL::BIGINT AS p_l, NULL::BIGINT AS p_b FROM cut GROUP BY host, segs),
    {levels.strip()}
    pure AS (
        SELECT host, prefix, l, (b + {p.smoothing} * CASE WHEN p_l IS NULL THEN h_b / h_l ELSE (p_b + {p.smoothing} * h_b / h_l) / (p_l + {p.smoothing}) END) / (l + {p.smoothing}) AS purity
        FROM (SELECT host, prefix, sum(l) AS l, sum(b) AS b, first(p_l) AS p_l, first(p_b) AS p_b FROM t{depth} GROUP BY host, prefix)
        JOIN (SELECT host, sum(l) AS h_l, sum(b) AS h_b FROM t{depth} GROUP BY host) USING (host)),
    rejected AS (SELECT t.host, t.segs FROM t{depth} t JOIN pure USING (host, prefix) WHERE pure.l >= {p.support} AND purity >= {p.purity})
    SELECT page_id, c.host AS host, path, rule, CASE WHEN label = 1 OR (label IS NULL AND r.host IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
    FROM cut c LEFT JOIN rejected r ON c.host = r.host AND c.segs = r.segs
    """
