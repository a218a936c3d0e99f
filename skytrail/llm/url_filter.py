"""URL filters: fixed rules first, then a path-template tree.  Per host, variable segments become
wildcards, siblings that cannot be told apart merge, and templates are rejected by a lower bound of the
smoothed purity of their labelled pages.

Only DataFrame functions.  The tree is built over distinct (host, segments) patterns with counts,
so no step sees all pages of a host at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytrail.llm.common import small, stash, table

#: (verdict, host, path prefix) of the query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DEPTH = 4  # levels that the SQL writes out; paths of more segments are beyond it
WIDE = 20  # a node of more children keeps those that have this part of its pages; the others are one wildcard
Z = 2.0  # bad shares that are fewer standard errors apart are not told apart
SMOOTH = 4.0  # labelled pages that the overall share counts as
SURE = 1.645  # standard errors that a template's purity must lie above the limit
LIFT, LIMIT = 2.0, 0.5  # the limit: so many times the overall share, at most LIMIT
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))


def host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for null urls and urls without "://"."""
    rest = F.coalesce(after_scheme(F.col("_url")), F.lit(""))
    df = pages.withColumn("_url", F.col("url").cast("string")).withColumn("_rest", rest)
    return df.withColumns({"host": F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), UPPER, LOWER), "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)}).drop("_url", "_rest")


def rule_column(rules: list[tuple[str, str, str]], value) -> Column:
    """value(verdict, rule string) of the longest rule that fits host and path, or null; of equally
    long ones the first counts."""
    out = F
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = out.when(fits, F.lit(value(verdict, host + path)))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def segments() -> Column:
    """The path's segments, none of an empty path."""
    parts = F.split(F.regexp_replace("path", r"^/", ""), "/")
    return F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(parts)


def siblings(child: DataFrame) -> DataFrame:
    """child: host, template, seg, n, labelled, bad.  Adds `to`, the branch that each child becomes.

    In a node of more than WIDE children, all that hold less than a WIDEth of its pages are the wildcard
    *, so that at most WIDE + 1 branches are left.  These are compared with one another: in the order
    of their bad shares, neighbours that differ by less than Z standard errors are one branch, {a|b}.
    Branches without a label tell nothing, and are one of their own.
    """
    node = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("all_n"))
    rare = (F.col("children") > WIDE) & (F.col("n") * WIDE < F.col("all_n"))
    moves = child.join(node, ["host", "template"]).withColumn("_b", F.when(rare, "*").otherwise(F.col("seg")))
    branch = moves.groupBy("host", "template", "_b").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("x"))
    w = Window.partitionBy("host", "template").orderBy(F.col("l") == 0, (F.col("x") + 0.5) / (F.col("l") + 1), "_b")  # at most WIDE + 1 rows
    l, x, share = F.col("l"), F.col("x"), (F.col("x") + 0.5) / (F.col("l") + 1)
    l0, x0, share0 = F.lag("l").over(w), F.lag("x").over(w), F.lag(share).over(w)
    pooled = (x + x0 + 1) / (l + l0 + 2)
    apart = (l > 0) & (share - share0 > Z * F.sqrt(pooled * (1 - pooled) * (1 / (l + 1) + 1 / (l0 + 1)))) | (l == 0) & (l0 > 0)
    branch = branch.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = F.sort_array(F.collect_list("_b").over(Window.partitionBy("host", "template", "_k")))
    name = F.when(F.size(names) > 1, F.concat(F.lit("{"), F.array_join(names, "|"), F.lit("}"))).otherwise(F.col("_b"))
    return moves.join(branch.select("host", "template", "_b", name.alias("to")), ["host", "template", "_b"]).select("host", "template", "seg", "to")


def templates(patterns: DataFrame) -> DataFrame:
    """patterns: host, segs, n, labelled, bad.  Adds the template of each pattern, level by level,
    until no pattern has a segment left.

    Segments that all patterns below a node share are passed at once, as an only child is neither
    rare nor merged; so the rounds follow the branchings, not the length of the longest path.
    """
    columns = [*patterns.columns, "template"]
    level = patterns.withColumn("template", F.lit("")).withColumn("rest", F.col("segs"))
    done, i = [], 0
    while True:
        done.append(level.filter(F.size("rest") == 0).select(*columns))
        level = level.filter(F.size("rest") > 0)
        if level.isEmpty():
            return reduce(DataFrame.union, done)
        low, high = F.min("rest").alias("low"), F.max("rest").alias("high")
        # What the least and the greatest list begin with, all between them begin with.
        differ = F.expr("array_position(zip_with(low, high, (a, b) -> a <=> b), false)")
        ahead = level.groupBy("host", "template").agg(low, high).select("host", "template", F.when(differ == 0, F.size("low")).otherwise(differ.cast("int") - 1).alias("_ahead"))
        level = level.join(ahead, ["host", "template"])
        level = level.withColumn("template", F.when(F.col("_ahead") > 0, F.concat("template", F.lit("/"), F.array_join(F.slice("rest", F.lit(1), F.col("_ahead")), "/"))).otherwise(F.col("template")))
        level = level.withColumn("rest", F.slice("rest", F.col("_ahead") + 1, F.size("rest"))).withColumn("seg", F.get("rest", F.lit(0))).drop("_ahead")
        level = stash(level, f"node{i}")
        done.append(level.filter("seg is null").select(*columns))
        level = level.filter("seg is not null")
        child = level.groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        level = level.join(siblings(child), ["host", "template", "seg"]).withColumn("template", F.concat("template", F.lit("/"), "to"))
        level = stash(level.withColumn("rest", F.slice("rest", F.lit(2), F.size("rest"))).select(*columns, "rest"), f"level{i}")
        i += 1


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (its smoothed share of bad pages).

    The method blocks a template whose purity is, by SURE standard errors, above LIFT times the share of
    bad pages among all that are labelled, or above LIMIT if that is less.

    labels: page_id and bad (0 or 1); null labels do not count.  Pages without a url have empty host
    and path and are judged by the template of these.  Repeated rows count as often as they occur.
    Without labels nothing is rejected by the method.
    """
    known = labels.filter("bad in (0, 1) and page_id is not null").groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").cast("long").alias("_bad"))
    rows = host_and_path(pages.select("page_id", "url"))
    rows = rows.join(known, F.col("page_id") == F.col("_id"), "left").select("page_id", "host", "path", "_bad")
    rows = stash(rows.withColumn("segs", segments()), "urls")
    keys = ["host", "segs"]
    patterns = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("_bad").alias("labelled"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    found = templates(stash(patterns, "patterns"))
    prior = rows.agg(F.coalesce(F.avg("_bad"), F.lit(0.0)).alias("prior"))
    tree = found.groupBy("host", "template").agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b")).crossJoin(F.broadcast(prior))  # one row
    purity = (F.col("_b") + SMOOTH * F.col("prior")) / (F.col("_l") + SMOOTH)
    tree = tree.withColumn("purity", purity).withColumn("_sure", F.col("purity") - SURE * F.sqrt(F.col("purity") * (1 - F.col("purity")) / (F.col("_l") + SMOOTH)))
    tree = tree.select("host", "template", "purity", (F.col("_sure") > F.least(F.lit(LIMIT), LIFT * F.col("prior"))).alias("_reject"))
    judged = stash(found.select(*keys, "template").join(tree, ["host", "template"]), "templates")
    side = judged.select(*[F.col(k).alias(f"_{k}") for k in keys], "template", "purity", "_reject")
    out = rows.join(small(side, side.count(), 200_000), (rows["host"] == side["_host"]) & (rows["segs"] == side["_segs"]))
    method = F.when(F.col("_reject"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule_column(rules, lambda v, r: r).alias("rule"), F.coalesce(rule_column(rules, lambda v, r: v), method).alias("verdict"), "template", "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the document that their url ends in: bad if its quality is 0."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    doc = F.expr("try_cast(regexp_extract(coalesce(url, ''), '^[^?#]*/([0-9]+)(?:/|[.][a-z]+)?(?:[?#].*)?$', 1) as bigint)")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("quality").alias("q"))
    known = pages.withColumn("_doc", doc).join(labels, "_doc").select("page_id", F.when(F.col("q") == 0, 1).when(F.col("q") == 1, 0).alias("bad"))
    return judge(pages, known).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


def _oracle() -> str:
    """The query in SQL: the levels of the tree are written out one after another."""
    cols = [f"s{i}" for i in range(DEPTH)]
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for v, h, p in longest]
    rule, verdict = ("case " + " ".join(f"when {c} then '{x[k]}'" for c, *x in fits) + " end" for k in (0, 1))

    def seg(i: int) -> str:
        s = f"parts[{i + 1}]" if i < DEPTH - 1 else f"case when len(parts) >= {DEPTH} then array_to_string(parts[{DEPTH}:], '/') end"
        return f"case when path = '' then null else {s} end s{i}"

    sql = rf"""with u as (
  select page_id, url, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') rest from pages),
h as (
  select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
q as (select doc_id, max(quality) q from labels group by 1),
k as (
  select page_id, case q when 0 then 1 when 1 then 0 end bad
  from (select page_id, try_cast(regexp_extract(coalesce(url, ''), '^[^?#]*/([0-9]+)(?:/|[.][a-z]+)?(?:[?#].*)?$', 1) as bigint) doc_id from pages) join q using (doc_id)),
p as (
  select h.page_id, host, path, string_split(regexp_replace(path, '^/', ''), '/') parts, bad
  from h left join (select page_id, max(bad) bad from k where bad is not null group by 1) using (page_id)),
r as (select page_id, host, path, bad, {", ".join(map(seg, range(DEPTH)))} from p),
lv0 as (select host, {", ".join(cols)}, count(*) n, count(bad) labelled, coalesce(sum(bad), 0) bad, '' template from r group by all)"""
    for i in range(DEPTH):
        part = "partition by host, template"
        sql += f""",
child{i} as (select host, template, s{i}, sum(n) n, sum(labelled) labelled, sum(bad) bad from lv{i} where s{i} is not null group by 1, 2, 3),
way{i} as (select *, case when count(*) over ({part}) > {WIDE} and n * {WIDE} < sum(n) over ({part}) then '*' else s{i} end b from child{i}),
branch{i} as (select host, template, b, sum(labelled)::double l, sum(bad)::double x, (sum(bad) + 0.5e0) / (sum(labelled) + 1) share from way{i} group by 1, 2, 3),
next{i} as (select *, lag(l) over w l0, lag(x) over w x0, lag(share) over w share0 from branch{i} window w as ({part} order by l = 0, share, b)),
cut{i} as (select *, (l > 0 and share - share0 > {Z}e0 * sqrt((x + x0 + 1) / (l + l0 + 2) * (1 - (x + x0 + 1) / (l + l0 + 2)) * (1 / (l + 1) + 1 / (l0 + 1))) or l = 0 and l0 > 0)::int new_ from next{i}),
group{i} as (select *, sum(coalesce(new_, 0)) over ({part} order by l = 0, share, b rows unbounded preceding) k from cut{i}),
name{i} as (select host, template, k, case when count(*) > 1 then '{{{{' || string_agg(b, '|' order by b) || '}}}}' else min(b) end moved from group{i} group by 1, 2, 3),
move{i} as (select host, template, s{i}, moved from way{i} join group{i} using (host, template, b) join name{i} using (host, template, k)),
lv{i + 1} as (
  select a.host, {", ".join(f"a.{c}" for c in cols)}, a.n, a.labelled, a.bad, case when a.s{i} is null then a.template else a.template || '/' || moved end template
  from lv{i} a left join move{i} b on a.host = b.host and a.template = b.template and a.s{i} = b.s{i})""".replace("{{", "{").replace("}}", "}")
    match = " and ".join(["r.host = t.host", *(f"r.{c} is not distinct from t.{c}" for c in cols)])
    return (
        sql
        + f""",
prior as (select coalesce(avg(bad), 0) prior from r),
pure as (select host, template, sum(labelled) l, any_value(prior) prior, (sum(bad) + {SMOOTH}e0 * any_value(prior)) / (sum(labelled) + {SMOOTH}e0) purity from lv{DEPTH}, prior group by 1, 2),
tree as (select *, purity - {SURE}e0 * sqrt(purity * (1 - purity) / (l + {SMOOTH}e0)) > least({LIMIT}e0, {LIFT}e0 * prior) reject from pure)
select page_id, r.host as host, path, {rule.replace("(host", "(r.host").replace("(host,", "(r.host,")} as rule,
  coalesce({verdict.replace("(host", "(r.host").replace("(host,", "(r.host,")}, case when reject then 'block' else 'allow' end) verdict, t.template as template, round(purity, 9) purity
from r join lv{DEPTH} t on {match} join tree on tree.host = t.host and tree.template = t.template"""
    )


ORACLE = _oracle()
