"""URL filters: explicit rules, and a tree of path templates judged by labelled purity.

Per host, the segments of a path go down a tree. At each level variable
segments become wildcards: by form (digits, long hexadecimal strings) and by
statistics (a node most of whose children are rare). A branch whose labelled
rate does not differ from that of its siblings by more than chance (a two-sided test of two
proportions, with at least LEAST labels on both sides) is merged with the others like it into one wildcard. Without
labels nothing is merged by them. A template's purity is its
share of good labels, smoothed with the overall share; templates below the limit
are rejected.

The tree goes as deep as there is a node that either rule can touch: one with CHILDREN urls or more.
The levels are aggregations of distinct (host, path) rows with their counts, combined
before they are shuffled. A host with a third of all urls is only as
large as its different paths of one form; children are counted per node, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.session import materialize, release, table

#: Rules of the query: verdict and host with path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: A node with at least so many children, fewer than RARE urls in each on average, is variable.
CHILDREN, RARE = 16, 4.0
#: Labels that a branch and its siblings must have to be compared; not below half of CHILDREN, or nodes would close too early.
LEAST = 8
#: Two-sided 95 % point of the normal distribution.
Z = 1.96
#: Weight of the overall share in labelled pages, and the least purity of a template.
PRIOR, PURITY = 8.0, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. The rules are a list that fits a plan."""
    if len(rules) > 5000:
        raise ValueError("more rules than fit a plan")
    fits = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        at = rule.index("/")
        own = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        fits = F.when(own, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def form(segment: Column) -> Column:
    """A segment with its digit runs and long hexadecimal strings as wildcards.

    Braces of the url are doubled and a lone asterisk is put in braces, so that no segment passes for a wildcard.
    """
    plain = F.when(segment == "*", F.lit("{*}")).otherwise(F.regexp_replace(segment, "([{}])", "$1$1"))
    hexed = F.regexp_replace(plain, "(?i)(?<![0-9a-z])(?=[0-9a-f-]*[0-9])[0-9a-f]{8}[0-9a-f-]{4,}(?![0-9a-z])", "{x}")
    return F.regexp_replace(hexed, "[0-9]+", "{n}")


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template) from rows (host, path, n, labelled, good), distinct by host and path."""
    df = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != ""))
    df = df.withColumn("segments", F.transform("segments", form))
    df = df.withColumn("tail", F.when(F.col("path").endswith("/"), F.lit("/")).otherwise(F.lit("")))
    # what distinguishes paths from here on is their form
    key = materialize(df.select("host", "path", F.array_join("segments", "/").alias("form"), "tail", "n", "labelled", "good"))
    tree = key.groupBy("host", "form").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    tree = materialize(tree.withColumn("rest", F.filter(F.split("form", "/"), lambda s: s != "")).withColumn("prefix", F.lit("")))
    closed, level = [], 0
    while tree.limit(1).count():
        here = tree.withColumn("child", F.get("rest", F.lit(level)))
        child = here.where("child is not null").groupBy("host", "prefix", "child").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("good").alias("g"))
        child = materialize(child)
        node = child.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("nn"), F.sum("l").alias("ll"), F.sum("g").alias("gg"))
        # with fewer urls no rule below can hold: k and l are at most n
        both = child.join(node.where(F.col("nn") >= min(CHILDREN, 2 * LEAST)), ["host", "prefix"])
        variable = (F.col("k") >= CHILDREN) & (F.col("nn") < RARE * F.col("k")) & (F.col("n") < RARE)
        l, others = F.col("l"), F.col("ll") - F.col("l")
        rate = F.try_divide("gg", "ll")
        spread = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), l) + F.try_divide(F.lit(1), others)))
        apart = F.abs(F.try_divide("g", l) - F.try_divide(F.col("gg") - F.col("g"), others))
        alike = (l >= LEAST) & (others >= LEAST) & (apart <= Z * spread)
        both = both.select("host", "prefix", "child", F.when(variable | F.coalesce(alike, F.lit(False)), F.lit("*")).otherwise(F.col("child")).alias("named"))
        new = materialize(here.join(both, ["host", "prefix", "child"], "left").drop("child"))
        release(child)
        rest = F.slice("rest", level + 1, F.greatest(F.size("rest"), F.lit(1)))
        closed.append(new.where("named is null").select("host", "form", F.concat_ws("/", "prefix", F.nullif(F.array_join(rest, "/"), F.lit(""))).alias("template")))
        tree = new.where("named is not null").withColumn("prefix", F.concat_ws("/", "prefix", "named")).drop("named")
        level += 1
    whole = tree.select("host", "form", F.col("prefix").alias("template"))
    for frame in closed:
        whole = whole.unionByName(frame)
    return key.join(whole, ["host", "form"]).select("host", "path", F.concat("template", "tail").alias("template"), "n", "labelled", "good")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] | None = None, page_id: str = "page_id", url: str = "url", least: float = PURITY) -> DataFrame:
    """One row per row of ``pages``: (page_id, host, path, rule, verdict, template, purity).

    ``labels`` has rows (page_id, good): pages known to be good (1) or not (0); of several
    for a page the worst counts. The longest rule that fits decides; without one the template does.
    Null urls and those without "://" have an empty host and path, the template
    of an empty path, and are judged by it. A page without an id has no label. Repeated rows have a row each, an
    empty table none. Without labels every purity is one half, which the limit keeps. Other columns of both tables
    are not read, whatever their names.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = labels.select(F.col("page_id").alias("_page"), F.col("good").cast("int").alias("good")).where("good is not null").groupBy("_page").agg(F.min("good").alias("good"))
    seen = rows.join(known, rows.page_id == known._page, "left")
    paths = seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    named = materialize(templates(materialize(paths)))
    whole = named.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("labelled")), F.lit(0.5)).alias("share"))
    score = named.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g"))
    # one row of one number
    score = score.join(F.broadcast(whole)).select("host", "template", F.round((F.col("g") + PRIOR * F.col("share")) / (F.col("l") + PRIOR), 6).alias("purity"))
    score = named.select("host", "path", "template").join(score, ["host", "template"])
    out = rows.join(score, ["host", "path"])
    hit = matched_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    method = F.when(F.col("purity") < least, F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumn("_hit", hit)
    return out.select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", method).alias("verdict"), "template", "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the document whose number ends their path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    of = pages.select("page_id", number.try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    return judge(pages, of.join(labels, "doc_id").select("page_id", "good"))
