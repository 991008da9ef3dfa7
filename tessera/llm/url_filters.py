"""URL filters: explicit rules first, then a path-template tree for what no rule fits.

The tree: the path of a url is cut into segments, and a host's paths make a tree of segments, level by level from the top. Below
each parent every segment is tested against its siblings: it stays apart only if its labelled pages differ from theirs (a
binomial test against the siblings' smoothed rate, stricter the more siblings are tested); all others (ids, slugs, and
branches that are statistically alike) are generalised into one wildcard. Segments that stay apart are then merged with one
another: in order of their rates, neighbours that don't differ become one branch, written `(a|b)`. So each url ends with a
template such as `host/en/*`. A node whose labels are all equal, or that has none, can't split, so the tree goes on to the depth
at which no node splits, and no further. A template's purity is the share of blocked ones among its labelled urls, smoothed towards that of the template above it, up to the host and
all hosts; templates over the threshold are rejected. The labels are the verdicts of the rules, where these fit (or a column of
labels).

Every level works on counts by (template, segment) and not on urls; a parent's wildcard is one row whatever the number of its
segments. Parents with a large share of the paths are joined by a broadcast of their few branches.

Defined cases: a null url or one without `://` has an empty host and path and no rule, and the method's verdict on the empty
host; urls are judged whole, at any length, and repeated rows each; an empty table gives an empty table; other columns are
ignored, so their names can't clash; of equally long rules none can fit the same url twice, so there are no ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, lookup, materialise, release

#: rule string: verdict. A rule is a host and a path.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Deviations from which rates differ, before the number of siblings is counted in.
Z = 2.58
#: Weight of the template above, in labelled urls, and the smoothed purity from which a template is rejected.
PRIOR, REJECT = 4.0, 0.7
WILDCARD = "*"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _differs(n: Column, bad: Column, m: Column, bad_m: Column, tests: Column) -> Column:
    """Whether n labels with bad blocked ones are improbable at the smoothed rate of m others: deviations, less half a label, above
    the bound for so many tests."""
    q = (bad_m + 1) / (m + 2)
    off = F.abs(bad - n * q) - 0.5
    return (n > 0) & (m > 0) & (off > 0) & (off * off > (Z * Z + 2 * F.log(tests)) * n * q * (1 - q))


def _branches(children: DataFrame) -> DataFrame:
    """children: above, segment, known, bad, paths -> above, segment, branch (the name of its merged branch) and paths of those that
    stay apart. A parent's branches are few: each has labels that differ from its siblings'."""
    of = children.groupBy("above").agg(F.sum("known").alias("known_all"), F.sum("bad").alias("bad_all"), F.count("*").alias("tests"))
    # only parents with labels of both kinds can split, and of their children only those with labels
    of = of.filter((F.col("bad_all") > 0) & (F.col("bad_all") < F.col("known_all")))
    tried = children.filter("known > 0").join(of, "above")
    apart = tried.filter(_differs(F.col("known"), F.col("bad"), F.col("known_all") - F.col("known"), F.col("bad_all") - F.col("bad"), F.col("tests")))
    order = W.partitionBy("above").orderBy((F.col("bad") + 1) / (F.col("known") + 2), "segment")
    new = F.coalesce(_differs(F.col("known"), F.col("bad"), F.lag("known").over(order), F.lag("bad").over(order), F.lit(1)), F.lit(True))
    numbered = apart.withColumn("new", new.cast("int")).withColumn("group", F.sum("new").over(order))
    whole = W.partitionBy("above", "group")
    names = F.array_sort(F.collect_list(F.when(F.col("segment") == WILDCARD, F.lit("%2A")).otherwise(F.col("segment"))).over(whole))
    branch = F.when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("("), F.array_join(names, "|"), F.lit(")")))
    return numbered.select("above", "segment", branch.alias("branch"), "paths")


def path_templates(urls: DataFrame) -> DataFrame:
    """urls: host, path, label (1 blocked, 0 allowed, null unknown) -> one row a distinct (host, path): n, template, purity and
    rejected."""
    segments = F.filter(F.split(F.col("path"), "/"), lambda x: x != "")
    sums = [F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad")]
    level = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    total = level.agg(F.sum("known"), F.sum("bad")).first()
    start = F.lit(((total[1] or 0) + 1) / ((total[0] or 0) + 2))
    smoothed = lambda purity: (F.col("bad_all") + PRIOR * purity) / (F.col("known_all") + PRIOR)
    level = materialise(level.withColumns({"segments": segments, "template": F.col("host"), "purity": start, "open": F.lit(True)}), "paths")
    depth = 0
    while True:
        # the purity of the templates that the last level made, and whether they can split
        of = level.filter("open").groupBy("template").agg(F.sum("known").alias("known_all"), F.sum("bad").alias("bad_all"), F.count("*").alias("paths"))
        of = materialise(of.withColumnRenamed("template", "at"), "nodes")
        shut = level.filter(~F.col("open"))
        now = lookup(level.filter("open").withColumn("at", F.col("template")), of, "at", "paths")
        more = F.size("segments") > depth
        mixed = (F.col("bad_all") > 0) & (F.col("bad_all") < F.col("known_all"))
        name = F.when(more & ~mixed, F.concat("template", F.lit(f"/{WILDCARD}"))).otherwise(F.col("template"))
        judged = now.select("host", "path", "n", "known", "bad", "segments", name.alias("template"), smoothed(F.col("purity")).alias("purity"), (more & mixed).alias("open"))
        level, before = materialise(shut.unionByName(judged), "paths"), level
        release(before, of)
        if level.filter("open").isEmpty():
            break
        here = level.filter("open").withColumn("child", F.struct(F.col("template").alias("above"), F.get("segments", F.lit(depth)).alias("segment")))
        children = here.groupBy("child.above", "child.segment").agg(*sums, F.count("*").alias("paths"))
        found = materialise(_branches(children).select(F.struct("above", "segment").alias("child"), "branch", "paths"), "branches")
        named = lookup(here, found, "child", "paths").withColumn("template", F.concat("template", F.lit("/"), F.coalesce("branch", F.lit(WILDCARD))))
        level, before = materialise(level.filter(~F.col("open")).unionByName(named.select(*level.columns)), "paths"), level
        release(before, found)
        depth += 1
    return level.select("host", "path", "n", "template", "purity", (F.col("purity") >= REJECT).alias("rejected"))


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each row."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = [r for r, v in rules.items() if v == "block"]
    label = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocked).cast("int"))
    judged = path_templates(urls.withColumn("label", label))
    keyed = judged.select(F.struct("host", "path").alias("at"), "template", "purity", "rejected", "n")
    out = lookup(urls.withColumn("at", F.struct("host", "path")), materialise(keyed, "templates"), "at", "n")
    by_rule = F.when(F.col("rule").isin(blocked), F.lit("block")).when(F.col("rule").isNotNull(), F.lit("allow"))
    verdict = F.coalesce(by_rule, F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
