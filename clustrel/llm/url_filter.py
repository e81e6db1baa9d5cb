"""URL filters: rules first, then a tree of path templates per host. Only DataFrame functions are used.

Rules (host, path) decide what they fit; the URLs that they decide are the labels from which the tree learns. A
path is first reduced to a shape (runs of digits and long hexadecimal runs become marks), and equal shapes of a
host are summed up before anything else. Then the tree grows level by level. Below a node with many different
segments, those with under a hundredth of its pages are variable and become ``*``. What is left, a bounded number
of branches, is put in order of the share of labelled pages that rules block; neighbours in that order whose shares
don't differ significantly (chi-square) merge, and their segment is written ``(a|b)``. Branches without labelled
pages show no likeness to any, so they stay by themselves. A template's purity is (blocked + 1) / (labelled + 2);
templates of 0.9 or more are rejected with all their pages, labelled or not, and all others are allowed.

Edge cases: a null URL, or one without ``://``, has an empty host and path, which no rule fits; a path of more than
DEPTH segments keeps its first ones, and the rest is one segment ``**``; empty segments don't count; a segment
that is itself ``*`` counts as variable; repeated rows are judged each for itself, and each counts; an empty table
gives no rows; columns other than page_id and url aren't read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrel.llm.common import forget, stored


class Rule(NamedTuple):
    """A verdict for a host with its subdomains, and a beginning of the path."""

    verdict: str
    host: str
    path: str


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the tree; different segments that a node may have before rare ones are variable; of 100 pages.
DEPTH, FAN, SHARE = 6, 16, 100
#: Chi-square of one degree of freedom at a chance of 0.01.
CHI = 6.635
#: Purity at which a template is rejected, in tenths.
PURE = 9


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, ruling: the longest rule that fits, and its verdict, or nulls."""
    host, path = parsed(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    which = F.lit(None).cast("int")
    for i, r in sorted(enumerate(rules), key=lambda x: (len(x[1].host + x[1].path), -x[0])):  # the longest is asked first, of equal ones the first
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        which = F.when(fits, i).otherwise(which)
    out = out.withColumn("which", which)
    named = lambda f: F.get(F.array(*(F.lit(f(r)) for r in rules)).cast("array<string>"), F.col("which"))
    return out.withColumns({"rule": named(lambda r: r.host + r.path), "ruling": named(lambda r: r.verdict)}).drop("which")


def shape(path: Column) -> Column:
    """A path with marks for what varies by itself."""
    marked = F.regexp_replace(F.regexp_replace(path, r"[0-9A-Fa-f]{16,}", "{x}"), r"[0-9]+", "{n}")
    return F.regexp_replace(F.regexp_replace(marked, r"/+", "/"), r"^/|/$", "")


def _grown(paths: DataFrame, level: int) -> DataFrame:
    """paths with one more segment in their templates, where they have one."""
    paths = paths.withColumn("seg", F.get("segs", F.lit(level)))
    node, sums = ["host", "template"], [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    kids = paths.where("seg is not null").groupBy(*node, "seg").agg(*sums)
    fans = kids.groupBy(*node).agg(F.count(F.lit(1)).alias("fan"), F.sum("n").alias("pages"))
    rare = (F.col("fan") > FAN) & (F.col("n") * SHARE < F.col("pages"))
    kids = kids.join(fans, node).withColumn("sym", F.when(rare, "*").otherwise(F.col("seg")))
    kids = stored(kids.select(*node, "seg", "sym", "n", "labelled", "blocked"), "kids")
    branches = kids.groupBy(*node, "sym").agg(*sums)  # at most FAN + SHARE + 1 of a node
    by = Window.partitionBy(*node).orderBy(F.col("blocked") / F.col("labelled"), "sym")
    seen = branches.where("labelled > 0").withColumns({"n1": F.lag("labelled").over(by), "b1": F.lag("blocked").over(by)})
    seen = seen.withColumns({c: F.col(x).cast("double") for c, x in (("n1", "n1"), ("b1", "b1"), ("n2", "labelled"), ("b2", "blocked"))})
    cross = F.expr("b1 * (n2 - b2) - b2 * (n1 - b1)")
    chi = F.when(F.expr("b1 + b2 = 0 or b1 + b2 = n1 + n2"), 0.0).otherwise(F.expr("n1 + n2") * cross * cross / F.expr("n1 * n2 * (b1 + b2) * (n1 + n2 - b1 - b2)"))
    seen = seen.withColumn("cut", F.when(F.col("n1").isNull() | (chi > CHI), 1).otherwise(0)).withColumn("group", F.sum("cut").over(by))
    every = Window.partitionBy(*node, "group")
    seen = seen.withColumns({"syms": F.sort_array(F.collect_set("sym").over(every))})
    joined = F.when(F.size("syms") > 1, F.concat(F.lit("("), F.array_join("syms", "|"), F.lit(")"))).otherwise(F.col("sym"))
    named = seen.select(*node, "sym", joined.alias("merged"))
    step = kids.select(*node, "seg", "sym").join(named, [*node, "sym"], "left").select(*node, "seg", F.coalesce("merged", "sym").alias("merged"))
    longer = F.when(F.col("merged").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.col("merged")))
    out = paths.join(step, [*node, "seg"], "left").withColumn("template", longer)
    out = stored(out.select("host", "shape", "segs", "n", "labelled", "blocked", "template"), "paths")
    forget(kids)
    return out


def templates(pages: DataFrame) -> DataFrame:
    """host, shape, template, n_pages, labelled, blocked, rejected of pages(host, path, ruling): the template of every shape, and its pages."""
    one = lambda c: F.count_if(c).alias
    paths = pages.groupBy("host", shape(F.col("path")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), one(F.col("ruling").isNotNull())("labelled"), one(F.coalesce(F.col("ruling") == "block", F.lit(False)))("blocked")
    )
    segs = F.filter(F.split("shape", "/"), lambda s: s != "")
    segs = F.when(F.size(segs) > DEPTH, F.concat(F.slice(segs, 1, DEPTH), F.array(F.lit("**")))).otherwise(segs)
    paths = stored(paths.withColumns({"segs": segs, "template": F.lit("")}), "paths")
    for level in range(paths.agg(F.max(F.size("segs"))).first()[0] or 0):  # DEPTH + 1 at most
        paths, old = _grown(paths, level), paths
        forget(old)
    total = paths.groupBy("host", "template").agg(F.sum("n").alias("n_pages"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    total = total.withColumn("rejected", (F.col("blocked") + 1) * 10 >= (F.col("labelled") + 2) * PURE)
    return paths.select("host", "shape", "template").join(total, ["host", "template"])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, n_pages, labelled, blocked, purity of every row of pages(page_id, url)."""
    rows = ruled(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    tree = templates(rows.select("host", "path", "ruling"))
    out = rows.withColumn("shape", shape(F.col("path"))).join(tree, ["host", "shape"], "left")
    verdict = F.coalesce("ruling", F.when(F.col("rejected"), "block").otherwise("allow"))
    purity = (F.col("blocked") + 1) / (F.col("labelled") + 2)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "n_pages", "labelled", "blocked", purity.alias("purity"))


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _level_sql(k: int) -> str:
    return f"""s{k} AS MATERIALIZED (SELECT *, segs[{k + 1}] AS seg FROM t{k}),
k{k} AS MATERIALIZED (SELECT host, template, seg, sum(n)::BIGINT AS n, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
m{k} AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER v > {FAN} AND n * {SHARE} < sum(n) OVER v THEN '*' ELSE seg END AS sym FROM k{k} WINDOW v AS (PARTITION BY host, template)),
b{k} AS MATERIALIZED (SELECT host, template, sym, sum(labelled)::DOUBLE AS n2, sum(blocked)::DOUBLE AS b2 FROM m{k} GROUP BY ALL HAVING sum(labelled) > 0),
l{k} AS MATERIALIZED (SELECT *, lag(n2) OVER v AS n1, lag(b2) OVER v AS b1 FROM b{k} WINDOW v AS (PARTITION BY host, template ORDER BY b2 / n2, sym)),
c{k} AS MATERIALIZED (SELECT *, CASE WHEN n1 IS NULL THEN 1 WHEN b1 + b2 = 0 OR b1 + b2 = n1 + n2 THEN 0 WHEN (n1 + n2) * (b1 * (n2 - b2) - b2 * (n1 - b1)) * (b1 * (n2 - b2) - b2 * (n1 - b1))
  / (n1 * n2 * (b1 + b2) * (n1 + n2 - b1 - b2)) > {CHI} THEN 1 ELSE 0 END AS cut FROM l{k}),
g{k} AS MATERIALIZED (SELECT *, sum(cut) OVER (PARTITION BY host, template ORDER BY b2 / n2, sym ROWS UNBOUNDED PRECEDING) AS grp FROM c{k}),
j{k} AS MATERIALIZED (SELECT host, template, unnest(syms) AS sym, CASE WHEN len(syms) > 1 THEN '(' || array_to_string(syms, '|') || ')' ELSE syms[1] END AS merged
  FROM (SELECT host, template, grp, list(sym ORDER BY sym) AS syms FROM g{k} GROUP BY ALL)),
t{k + 1} AS MATERIALIZED (SELECT s.host, s.shape, s.segs, s.n, s.labelled, s.blocked, CASE WHEN s.seg IS NULL THEN s.template ELSE s.template || '/' || coalesce(j.merged, m.sym) END AS template
  FROM s{k} s LEFT JOIN m{k} m ON m.host = s.host AND m.template = s.template AND m.seg = s.seg LEFT JOIN j{k} j ON j.host = m.host AND j.template = m.template AND j.sym = m.sym)"""


def _rule_sql(field) -> str:
    asked = sorted(RULES, key=lambda r: -len(r.host + r.path))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{field(r)}'" for r in asked) + " END"


OP11_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS MATERIALIZED (SELECT *, {_rule_sql(lambda r: r.host + r.path)} AS rule, {_rule_sql(lambda r: r.verdict)} AS ruling,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '[0-9A-Fa-f]{{16,}}', '{{x}}', 'g'), '[0-9]+', '{{n}}', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') AS shape FROM q),
a AS MATERIALIZED (SELECT host, shape, list_filter(string_split(shape, '/'), lambda s: s <> '') AS segs, count(*) AS n, count(ruling) AS labelled, count(*) FILTER (WHERE ruling = 'block') AS blocked FROM r GROUP BY host, shape),
t0 AS MATERIALIZED (SELECT host, shape, CASE WHEN len(segs) > {DEPTH} THEN list_append(segs[1:{DEPTH}], '**') ELSE segs END AS segs, n, labelled, blocked, '' AS template FROM a),
{", ".join(_level_sql(k) for k in range(DEPTH + 1))},
f AS (SELECT host, template, sum(n)::BIGINT AS n_pages, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked FROM t{DEPTH + 1} GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN (f.blocked + 1) * 10 >= (f.labelled + 2) * {PURE} THEN 'block' ELSE 'allow' END) AS verdict,
       template, n_pages, f.labelled, f.blocked, (f.blocked + 1) / (f.labelled + 2) AS purity
FROM r JOIN (SELECT host, shape, template FROM t{DEPTH + 1}) USING (host, shape) JOIN f USING (host, template)
"""
