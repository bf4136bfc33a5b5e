"""URL filter: a path-template tree for each host, judged by labelled purity.

Rules label the urls they fit; a url without a rule is judged by its template.
Each host's paths form a tree, one level a segment, as deep as its paths; digit runs
become ``#``. A child stays a branch of its own if ``SUPPORT`` urls or more go through
it, or if it has at least 1/``SHARE`` of its node's urls and its segment occurs in
``SUPPORT`` urls of all hosts at that level; the others are variable and become ``*``.
From the third level on a node of fewer than ``SUPPORT`` urls is not divided further:
the rest of its paths are ``*``, so there are as many rounds as levels that so many
urls share. Of a host's first-level branches those with ``ENOUGH`` labels each, equal
labelled purity (in quarters) and alike subtrees (leaf shares in quarters, of which one
at least names more than wildcards) are merged and pool their labels leaf by leaf.
A leaf's share of blocked labels is smoothed towards that of the same template on all
hosts, that towards its branch's, and that towards the share of all labels; a template
is rejected from one half on.

Only DataFrame functions are used. Urls are counted by (host, shape) first; all
tree work runs on these counts. A host with a third of all urls is a hot key:
joins on nodes broadcast the at most 256 hot keys and shuffle the others.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no
rule, and is judged by the template of the empty path; with no label at all the
smoothed share is one half, and urls without a rule are blocked; repeated rows get
the same verdict; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import join_skewed, save

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SUPPORT, SHARE, ENOUGH = 8, 16, 8
SMOOTH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""

    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null without one)."""

    rule, verdict = F, F
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments of a path (one at least), digit runs as ``#``."""

    return F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), "[0-9]+", "#"), "/", -1)


def key(*columns: str) -> Column:
    return F.concat_ws("\x01", *columns)


def next_level(active: DataFrame, level: int) -> DataFrame:
    """``active`` (with node and parts) one segment further: the new node, and whether
    its path ends there (``ended``)."""

    active = active.withColumn("seg", F.get("parts", F.lit(level))).withColumn("kid", key("node", "seg"))
    kids = save(active.groupBy("kid", "node", "seg").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")), "url-kids")
    nodes = save(kids.groupBy("node").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kids")), "url-nodes")
    common = save(kids.groupBy("seg").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("places")), "url-segments")
    told = save(join_skewed(kids, nodes, "node", "kids").drop("kids"), "url-told")
    told = join_skewed(told, common, "seg", "places")
    own = (F.col("n") >= SUPPORT) | ((F.col("n") * SHARE >= F.col("total")) & (F.col("seen") >= SUPPORT))
    small = F.lit(level >= 2) & (F.col("total") < SUPPORT)
    told = save(told.select("kid", "rows", F.when(own, F.col("seg")).otherwise(F.lit("*")).alias("name"), small.alias("small")), "url-names")
    found = join_skewed(active, told, "kid", "rows")
    left = F.size("parts") - F.lit(level)
    node = F.when(F.col("small"), F.concat("node", F.repeat(F.lit("\x01*"), left))).otherwise(key("node", "name"))
    return save(found.withColumn("ended", F.col("small") | (left == 1)).withColumn("node", node).drop("kid", "seg", "name", "small", "rows"), "url-level")


def templates(counts: DataFrame) -> DataFrame:
    """``counts`` (place, host, parts, n, ...) with each path's template: its first-level
    branch ``g`` and the ``rest``."""

    active, level, leaves = counts.withColumn("node", F.col("host")), 0, None
    while True:
        found = next_level(active, level)
        done = found.filter("ended").drop("ended")
        leaves = done if leaves is None else leaves.unionByName(done)
        active, level = found.filter("NOT ended").drop("ended"), level + 1
        if not active.head(1):
            break
    inside = F.substring("node", F.length("host") + 2, F.length("node"))
    at = F.instr(inside, "\x01")
    g = F.when(at > 0, F.substring(inside, F.lit(1), at - 1)).otherwise(inside)
    rest = F.when(at > 0, F.substring(inside, at + 1, F.length(inside))).otherwise(F.lit(""))
    return save(leaves.select("place", "host", "n", "free", "block", "known", g.alias("g"), F.when(at > 0, F.concat(F.lit("/"), rest)).otherwise(rest).alias("rest")), "url-templates")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every url."""

    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    place = F.concat_ws("\x01", "host", F.array_join("parts", "\x01"))
    rows = save(rows.select("*", rule.alias("rule"), verdict.alias("ruled"), segments(F.col("path")).alias("parts")).withColumn("place", place), "url-rows")
    counts = rows.groupBy("place", "host", "parts").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule").isNull()).alias("free"),
        F.count_if(F.col("ruled") == "block").alias("block"), F.count("ruled").alias("known"),
    )
    counts = templates(save(counts, "url-counts"))
    leaves = save(counts.groupBy("host", "g", "rest").agg(F.sum("n").alias("n"), F.sum("block").alias("block"), F.sum("known").alias("known")).withColumn("branch", key("host", "g")), "url-leaves")
    total = save(leaves.groupBy("branch").agg(F.sum("n").alias("total"), F.sum("block").alias("bb"), F.sum("known").alias("bk"), F.count(F.lit(1)).alias("rows")), "url-branches")
    # A branch's shares by quarters: entries under one eighth drop out, so eight at most are gathered.
    shares = join_skewed(leaves.select("branch", "rest", "n"), total.select("branch", "total", "rows"), "branch", "rows").withColumn("q", F.expr("(8 * n + total) div (2 * total)"))
    sign = F.array_join(F.sort_array(F.collect_list(F.when(F.col("q") > 0, F.concat_ws("=", "rest", F.col("q").cast("string"))))), "\x02")
    names = F.max(((F.col("q") > 0) & (F.regexp_replace("rest", "[*/\x01]", "") != "")).cast("int"))
    signs = shares.groupBy("branch").agg(sign.alias("sign"), names.alias("names")).join(total, "branch")
    alike = (F.col("names") == 1) & (F.col("bk") >= ENOUGH)
    quarter = F.expr("(8 * bb + bk) div greatest(2 * bk, 1)").cast("string")
    signs = save(signs.select("branch", "bb", "bk", "rows", F.when(alike, F.concat_ws("=", F.lit("m"), quarter, "sign")).alias("sign")), "url-signs")
    merged = join_skewed(leaves, signs, "branch", "rows")
    merged = merged.withColumn("merged", F.when(F.col("sign").isNotNull(), key("host", "sign", "rest")).otherwise(F.concat(F.lit("o\x01"), key("host", "g", "rest")))).withColumn("template", key("g", "rest"))
    merged = save(merged.select("host", "g", "rest", "block", "known", "bb", "bk", "merged", "template"), "url-merged")
    all_ = merged.agg(F.sum("block"), F.sum("known")).first()
    overall = ((all_[0] or 0) + 1.0) / ((all_[1] or 0) + 2.0)

    def labels_of(group: str, b: str, k: str) -> DataFrame:
        return save(merged.groupBy(group).agg(F.sum("block").alias(b), F.sum("known").alias(k), F.count(F.lit(1)).alias("group_rows")), f"url-{group}")

    told = save(join_skewed(merged.select("host", "g", "rest", "bb", "bk", "merged", "template"), labels_of("template", "tb", "tk"), "template", "group_rows").drop("group_rows"), "url-priors")
    told = join_skewed(told, labels_of("merged", "b", "k"), "merged", "group_rows").drop("group_rows")
    base = (F.col("bb") + SMOOTH * F.lit(overall)) / (F.col("bk") + SMOOTH)
    prior = (F.col("tb") + SMOOTH * base) / (F.col("tk") + SMOOTH)
    bad = (F.col("b") + SMOOTH * prior) / (F.col("k") + SMOOTH)
    told = save(told.select(key("host", "g", "rest").alias("leaf"), bad.alias("bad")), "url-purity")
    places = counts.withColumn("leaf", key("host", "g", "rest"))
    per_leaf = places.groupBy("leaf").agg(F.count(F.lit(1)).alias("leaf_rows"))
    told = save(told.join(per_leaf, "leaf"), "url-judged")
    verdicts = save(join_skewed(places.select("leaf", "place", "free").filter("free > 0"), told, "leaf", "leaf_rows").select("place", "free", F.when(F.col("bad") >= 0.5, F.lit("block")).otherwise(F.lit("allow")).alias("found")), "url-verdicts")
    out = ["page_id", "host", "path", "rule"]
    by_rule = rows.filter("rule IS NOT NULL").select(*out, F.col("ruled").alias("verdict"))
    free = join_skewed(rows.filter("rule IS NULL").select(*out, "place"), verdicts, "place", "free")
    return by_rule.unionByName(free.select(*out, F.col("found").alias("verdict")))


_WHEN = "\n".join("WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}') THEN '{0}{1}'".format(h, p) for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)))
_VERDICT = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)


_D = "::DOUBLE"
SQL = rf"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0) AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
r AS (SELECT *, CASE {_WHEN} END AS rule, string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/') AS parts FROM p),
s AS (SELECT page_id, host, path, rule, CASE rule {_VERDICT} END AS ruled, parts FROM r),
c AS (SELECT host, parts, count(*) AS n, count(*) FILTER (ruled = 'block') AS block, count(ruled) AS known FROM s GROUP BY ALL),
t AS (SELECT host, parts, n, block, known, 0::BIGINT AS i, '' AS node FROM c
  UNION ALL
  SELECT host, parts, n, block, known, CASE WHEN small THEN len(parts) ELSE i + 1 END,
    CASE WHEN small THEN node || repeat(chr(1) || '*', len(parts) - i)
         ELSE node || chr(1) || CASE WHEN kid >= {SUPPORT} OR (kid * {SHARE} >= total AND seen >= {SUPPORT}) THEN parts[i + 1] ELSE '*' END END
  FROM (SELECT *, i >= 2 AND total < {SUPPORT} AS small FROM
    (SELECT *, sum(n) OVER (PARTITION BY host, node) AS total, sum(n) OVER (PARTITION BY host, node, parts[i + 1]) AS kid, sum(n) OVER (PARTITION BY parts[i + 1]) AS seen
     FROM t WHERE i < len(parts)))),
l AS (SELECT host, parts, n, block, known, string_split(substr(node, 2), chr(1))[1] AS g,
    CASE WHEN len(string_split(substr(node, 2), chr(1))) > 1 THEN '/' || array_to_string(string_split(substr(node, 2), chr(1))[2:], chr(1)) ELSE '' END AS rest FROM t WHERE i = len(parts)),
f AS (SELECT host, g, rest, sum(n) AS n, sum(block) AS block, sum(known) AS known FROM l GROUP BY ALL),
q AS (SELECT *, ((8 * n + sum(n) OVER b) // (2 * sum(n) OVER b)) AS q FROM f WINDOW b AS (PARTITION BY host, g)),
g AS (SELECT host, g, sum(block) AS bb, sum(known) AS bk,
    coalesce(array_to_string(list_sort(list(rest || '=' || q::BIGINT) FILTER (q > 0)), chr(2)), '') AS sign,
    bool_or(q > 0 AND replace(replace(replace(rest, '*', ''), '/', ''), chr(1), '') <> '') AS names FROM q GROUP BY ALL),
m AS (SELECT f.*, bb, bk, CASE WHEN names AND bk >= {ENOUGH} THEN 'm=' || ((8 * bb + bk) // greatest(2 * bk, 1))::BIGINT || '=' || sign ELSE 'o' || chr(1) || f.g END AS sign FROM f JOIN g USING (host, g)),
z AS (SELECT *, sum(block) OVER x AS mb, sum(known) OVER x AS mk, sum(block) OVER y AS tb, sum(known) OVER y AS tk, sum(block) OVER () AS ab, sum(known) OVER () AS ak FROM m
    WINDOW x AS (PARTITION BY host, sign, rest), y AS (PARTITION BY g, rest)),
v AS (SELECT host, g, rest, (mb + {SMOOTH} * ((tb + {SMOOTH} * ((bb + {SMOOTH} * ((ab + 1.0{_D}) / (ak + 2.0{_D}))) / (bk + {SMOOTH}))) / (tk + {SMOOTH}))) / (mk + {SMOOTH}) AS bad FROM z)
SELECT page_id, s.host, path, rule, coalesce(ruled, CASE WHEN bad >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM s JOIN l ON s.host = l.host AND s.parts = l.parts JOIN v ON v.host = l.host AND v.g = l.g AND v.rest = l.rest
"""
