"""URL filter by a path-template tree.

Per host, level by level and as deep as labels can tell: a path segment stays literal if its own labelled pages differ
significantly from those of its siblings, however small its share of them; all others, among them those without labels enough for
a test, become the wildcard ``*``. Literal siblings whose labelled shares of bad pages do
not differ significantly are merged into one branch. The leaves are templates. A template is rejected
if its smoothed share of bad labels reaches one half. Explicit rules go first, the longest that fits.

Work is per distinct host and path, counted before any shuffle. All steps are DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reckonry.plans.staging import stage

#: Fixed by the task: verdict, host, path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Labels that a segment needs for a test, two-sided 5 % level, weight of the overall share, share of bad labels that rejects.
LEAST, SIGNIFICANT, PRIOR_WEIGHT, REJECT = 5, 1.96, 4.0, 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(after, r"\A([^/?#]*)", 1), capitals, capitals.lower())
    return host, F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def templates(urls: DataFrame) -> DataFrame:
    """host, path, template for the distinct host and path pairs of ``urls(host, path, bad)``.

    ``bad`` is true, false or null (no label). The tree goes down as deep as labels can still part a branch: one whose labels
    are too few or all the same ends there, with ``**`` for the rest of its paths.
    """
    segments = F.split(F.expr("if(startswith(path, '/'), substr(path, 2), path)"), "/", -1)
    tree = stage(urls.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
    ).select("host", "path", "labelled", "bad", segments.alias("segments"), F.col("host").alias("prefix")), "paths")
    total = tree.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()  # one row
    prior = (total["b"] or 0) / total["l"] if total["l"] else 0.0
    ended, level = [], 0
    while True:
        level += 1
        ended.append(tree.where(f"size(segments) < {level}").select("host", "path", "labelled", "bad", "prefix"))
        here = tree.where(f"size(segments) >= {level}").withColumn("segment", F.get("segments", F.lit(level - 1)))
        whole = here.groupBy("prefix").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        # written, so that their true size decides how they meet the paths
        whole = stage(whole.where(f"all_labelled > {LEAST} and all_bad > 0 and all_bad < all_labelled"), "branches")
        rest = here.join(whole.select("prefix"), "prefix", "left_anti")
        ended.append(rest.select("host", "path", "labelled", "bad", F.concat("prefix", F.lit("/**")).alias("prefix")))
        if whole.isEmpty():
            break
        here = here.join(whole, "prefix")
        counted = here.groupBy("prefix", "segment", "all_labelled", "all_bad").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        branches = stage(_merged(counted.where(_unlike_siblings()), prior), "branches")
        named = here.join(branches.withColumnsRenamed({"prefix": "of", "segment": "named"}),
                          (F.col("prefix") == F.col("of")) & (F.col("segment") == F.col("named")), "left")
        tree = stage(named.select("host", "path", "labelled", "bad", "segments", F.concat(
            "prefix", F.lit("/"), F.coalesce("branch", F.lit("*"))).alias("prefix")), "paths")
    tree = stage(reduce(lambda x, y: x.unionByName(y), ended), "templates")
    purity = tree.groupBy("prefix").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).select(
        "prefix", "labelled", ((F.col("bad") + PRIOR_WEIGHT * prior) / (F.col("labelled") + PRIOR_WEIGHT)).alias("bad_share"))
    return tree.select("host", "path", "prefix").join(purity, "prefix").select(
        "host", "path", F.col("prefix").alias("template"), "labelled", "bad_share", (F.col("bad_share") >= REJECT).alias("rejected"))


def _unlike_siblings() -> Column:
    """Whether a segment's labels, ``LEAST`` at least, differ from those of its siblings taken together (two-sample test)."""
    n, bad, others, others_bad = F.col("labelled"), F.col("bad"), F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    share = F.col("all_bad") / F.col("all_labelled")
    error = F.sqrt(share * (1 - share) * (1 / n + 1 / others))
    return (n >= LEAST) & (others > 0) & (F.abs(bad / n - others_bad / others) > SIGNIFICANT * error)


def _merged(literal: DataFrame, prior: float) -> DataFrame:
    """prefix, segment, branch: neighbours by bad share go together unless a two-sample test parts them.

    A branch is named by its first segment and how many more it has.
    """
    share = (F.col("bad") + PRIOR_WEIGHT * prior) / (F.col("labelled") + PRIOR_WEIGHT)
    order = Window.partitionBy("prefix").orderBy("share", "segment")
    rated = literal.withColumn("share", share).withColumn("weight", F.col("labelled") + PRIOR_WEIGHT)
    pooled = (F.col("share") * F.col("weight") + F.lag("share").over(order) * F.lag("weight").over(order)) / (
        F.col("weight") + F.lag("weight").over(order))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("weight") + 1 / F.lag("weight").over(order)))
    apart = F.coalesce((F.col("share") - F.lag("share").over(order)) > SIGNIFICANT * error, F.lit(False)).cast("int")
    grouped = rated.withColumn("apart", apart).withColumn("set", F.sum("apart").over(order))
    members = Window.partitionBy("prefix", "set")
    more = F.count("*").over(members) - 1
    return grouped.select("prefix", "segment", F.concat(
        F.min("segment").over(members), F.when(more > 0, F.concat(F.lit("|+"), more.cast("string"))).otherwise("")).alias("branch"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template for every row of ``pages(page_id, url, bad)``.

    URLs that are null or no URL have an empty host and path, which is a template of its own. Rows are
    judged by their URL, so repeats and null ids don't matter; other columns are not read.
    """
    host, path = parts(F.col("url"))
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "bad")
    found = templates(cut)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return cut.select("page_id", "host", "path").join(found, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with ``bad``: the label of the document that the last number of the URL's path names."""
    _, path = parts(F.col("url"))
    numbered = pages.select("page_id", "url", F.regexp_extract(path, r"(\d{1,18})[^\d/]*/?\z", 1).alias("digits")).select(
        "page_id", "url", F.expr("try_cast(digits as long)").alias("doc"))
    bad = labels.groupBy(F.col("doc_id").alias("doc")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return numbered.join(bad, "doc", "left").select("page_id", "url", "bad")


def op3_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("pages", "labels"))
    return judge(labelled(pages, labels))


#: Levels that the SQL spells out; deeper than any path of the given tables.
_SQL_LEVELS = 12


def _sql() -> str:
    """The same tree level by level, with the rules as a chain of conditions."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(u.host = '{h}' or ends_with(u.host, '.{h}')) and starts_with(u.path, '{p}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in rules) + " end"
    said = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in rules) + " end"
    levels, weight = "", f"{PRIOR_WEIGHT}::double"
    for k in range(1, _SQL_LEVELS + 1):
        levels += f""", a{k} as (
  select prefix, sum(labelled) as nn, sum(bad) as bb from t{k - 1} where open and len(segments) >= {k} group by 1 having nn > {LEAST} and bb > 0 and bb < nn
), c{k} as (
  select t.prefix, segments[{k}] as segment, nn, bb, sum(labelled) as n1, sum(bad) as b1 from t{k - 1} t join a{k} a on a.prefix = t.prefix
  where open and len(segments) >= {k} group by all
), l{k} as (
  select prefix, segment, (b1 + {weight} * prior) / (n1 + {weight}) as share, n1 + {weight} as weight from c{k}, prior
  where n1 >= {LEAST} and nn > n1 and abs(b1 / n1 - (bb - b1) / (nn - n1)) > {SIGNIFICANT}::double * sqrt(bb / nn * (1 - bb / nn) * (1 / n1 + 1 / (nn - n1)))
), g{k} as (
  select *, (share * weight + lag(share) over o * lag(weight) over o) / (weight + lag(weight) over o) as pooled,
    lag(share) over o as share0, lag(weight) over o as weight0 from l{k} window o as (partition by prefix order by share, segment)
), s{k} as (
  select *, sum(case when share - share0 > {SIGNIFICANT}::double * sqrt(pooled * (1 - pooled) * (1 / weight + 1 / weight0)) then 1 else 0 end)
    over (partition by prefix order by share, segment) as part from g{k}
), b{k} as (
  select s.prefix, s.segment, m.branch from s{k} s join (
    select prefix, part, min(segment) || case when count(*) > 1 then '|+' || (count(*) - 1) else '' end as branch from s{k} group by all) m
  on m.prefix = s.prefix and m.part = s.part
), t{k} as (
  select t.host, t.path, t.labelled, t.bad, t.segments, t.open and len(t.segments) >= {k} and a.prefix is not null as open,
    case when not t.open or len(t.segments) < {k} then t.prefix when a.prefix is null then t.prefix || '/**' else t.prefix || '/' || coalesce(b.branch, '*') end as prefix
  from t{k - 1} t left join a{k} a on a.prefix = t.prefix left join b{k} b on b.prefix = t.prefix and b.segment = t.segments[{k}]
)"""
    return rf"""
with p as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as after from pages
), q as (
  select page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(after, '^[^/?#]*([^?#]*)', 1) as path from p
), y as (select doc_id, bool_or(quality = 0 or toxic = 1) as bad from labels group by 1
), u as (
  select page_id, host, path, y.bad from q left join y on y.doc_id = try_cast(regexp_extract(path, '(\d{{1,18}})[^\d/]*/?\z', 1) as bigint)
), t0 as (
  select host, path, count(bad)::double as labelled, coalesce(sum(bad::int), 0)::double as bad, true as open,
    string_split(case when starts_with(path, '/') then substr(path, 2) else path end, '/') as segments, host as prefix from u group by host, path
), prior as (select case when sum(labelled) > 0 then sum(bad)::double / sum(labelled) else 0 end as prior from t0
){levels}, f as (
  select prefix, (sum(bad) + {weight} * any_value(prior)) / (sum(labelled) + {weight}) >= {REJECT} as rejected from t{_SQL_LEVELS}, prior group by 1
)
select u.page_id, u.host, u.path, {rule} as rule, coalesce({said}, case when f.rejected then 'block' else 'allow' end) as verdict, t.prefix as template
from u join t{_SQL_LEVELS} t on t.host = u.host and t.path = u.path join f on f.prefix = t.prefix
"""


QUERY = op3_url_templates
SQL = _sql()
