"""URL filter: a path-template tree per host, cut by smoothed labelled purity.

1. ``parsed`` splits host and path.  2. ``RULES`` decide urls that they fit.
3. The tree decides the rest.  Path segments become tokens (numbers, hex and
mixed ids are generalised at once).  Every host has a tree, and its share of bad
labels counts, smoothed towards that of all labels, only where a two-sample test
tells the host from all others.

A node's branches are merged by the same test.  A branch that does not differ
from its siblings taken together joins the wildcard ``*``, as do all that have no
labels.  Those that differ are put in order of their shares; neighbours that do
not differ from each other, and lie on one side of ``reject``, are one class.  The
test asks for more the more branches a node has, so that among any number of
branches without a difference one is seldom found.  A class has its share
smoothed towards the node's; where no branch differs, the node's share stays.  A
template is rejected when its share is at least ``reject``.

What labelled paths of a node have in common is passed in one step, so a round
of jobs is one branching of labelled paths, whatever their length.  Paths leave
the table where they end, where they part from all labelled ones, and where a
class has labels of one kind or too few: their template goes on as ``**``.

Labels are (page_id, bad); the query takes ``labels`` by equal id, the only
labelled table there is, with toxic or low-quality rows as bad.  Those labels
are of documents and tell nothing about urls; tests have labels that follow the
templates.

Edge cases: a null url or one without ``://`` has an empty host and path and
is judged by the template of the empty path; paths count with all their
segments; without labels nothing is rejected; repeated rows are judged one by one and keep their
number; null ids never match a label; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.exprs import ascii_lower, let
from pathloom.llm.storage import saved

# Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Settings:
    """prior: pseudo-labels at the share of the template above. alpha: chance that a node without differences shows one.
    least: labels of a class that is split further. reject: least smoothed bad share of a rejected template."""

    prior: float = 10.0
    alpha: float = 0.01
    least: int = 10
    reject: float = 0.5


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """struct<rule, verdict> of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def token(segment: Column) -> Column:
    """A segment with ids generalised: {n}, {h}, {x}, keeping a file ending."""
    stem = F.regexp_extract(segment, r"^(.*?)((?:\.[A-Za-z]{1,5})?)$", 1)
    ending = F.regexp_extract(segment, r"^(.*?)((?:\.[A-Za-z]{1,5})?)$", 2)
    kind = (
        F.when(stem.rlike("^[0-9]+$"), "{n}")
        .when(stem.rlike("^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), "{h}")
        .when((F.length(stem) >= 8) & stem.rlike("[0-9].*[0-9].*[0-9]"), "{x}")
    )
    return F.when(kind.isNull(), segment).otherwise(F.concat(kind, ending))


def tokens_of(path: Column) -> Column:
    """Tokens of all segments; a closing slash is a token of its own."""
    head = F.transform(F.array_remove(F.split(path, "/"), ""), token)
    return F.concat(head, F.when(path.endswith("/"), F.array(F.lit(""))).otherwise(F.expr("cast(array() as array<string>)")))


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, fixed (rule and verdict) and tokens."""
    out = pages.select(pages[key].alias(key), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    return out.select(key, "host", "path", rule_of(F.col("host"), F.col("path")).alias("fixed"), tokens_of(F.col("path")).alias("tokens"))


def leaves(pages: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row per host and token path: pages, labelled pages and bad ones.

    Pages are first counted apart from labels; only labelled ids meet the pages.
    """
    one = labels.where("id is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    seen = pages.join(one, pages[key] == one["id"], "left")
    return seen.groupBy("host", "tokens").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )


def _differs(bad: Column, labelled: Column, bad2: Column, labelled2: Column, tests: Column, alpha: float) -> Column:
    """Whether two shares differ, tested with their common variance; the bound grows with the number of tests."""
    share = F.try_divide(bad + bad2, labelled + labelled2)
    spread = share * (1 - share) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), labelled2))
    z = F.try_divide(F.abs(F.try_divide(bad, labelled) - F.try_divide(bad2, labelled2)), F.sqrt(spread))
    return F.coalesce((spread > 0) & (z >= F.sqrt(2 * F.log(2 * F.greatest(tests, F.lit(1)) / alpha))), F.lit(False))


def _smooth(bad: Column, labelled: Column, above: Column, settings: Settings) -> Column:
    return (bad + settings.prior * above) / (labelled + settings.prior)


def _in_common(a: Column, b: Column) -> Column:
    """How many tokens two paths share from their start on."""
    return let(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("bigint")).cast("int"))


def _hosts(tree: DataFrame, settings: Settings) -> DataFrame:
    """(host, share): towards that of all labels, or equal to it where the host does not differ from all others."""
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    whole = hosts.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.count(F.when(F.col("labelled") > 0, 1)).alias("k")).first()
    n, b = F.lit(whole["n"]), F.lit(whole["b"])
    p_all = F.lit(whole["b"] / max(whole["n"], 1))
    apart = _differs(F.col("bad"), F.col("labelled"), b - F.col("bad"), n - F.col("labelled"), F.lit(whole["k"]), settings.alpha)
    return hosts.select("host", F.when(apart, _smooth(F.col("bad"), F.col("labelled"), p_all, settings)).otherwise(p_all).alias("share"))


def _classes(rows: DataFrame, settings: Settings) -> DataFrame:
    """(host, template, branch, name, share, labelled, bad): the class of every branch and the sums of the class."""
    node = ["host", "template"]
    branches = rows.groupBy(*node, "share", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    nodes = branches.groupBy(*node).agg(F.sum("labelled").alias("all"), F.sum("bad").alias("all_bad"), F.count(F.when(F.col("labelled") > 0, 1)).alias("k"))
    own = branches.join(nodes, node)
    own = own.withColumn("apart", _differs(F.col("bad"), F.col("labelled"), F.col("all_bad") - F.col("bad"), F.col("all") - F.col("labelled"), F.col("k"), settings.alpha))
    raw = F.try_divide("bad", "labelled")
    line = Window.partitionBy(*node).orderBy("raw", "branch")  # of branches that differ
    before = lambda c: F.lag(c).over(line)
    new = before("raw").isNull() | _differs(F.col("bad"), F.col("labelled"), before("bad"), before("labelled"), F.col("k"), settings.alpha) | ((F.col("raw") >= settings.reject) != (before("raw") >= settings.reject))
    apart = own.where("apart").withColumn("raw", raw).withColumn("new", new.cast("int")).withColumn("class", F.sum("new").over(line)).drop("raw", "new")
    both = saved(apart.unionByName(own.where("not apart").withColumn("class", F.lit(0).cast("bigint"))), "urls-branches")
    whole = both.groupBy(*node, "class").agg(F.sum("labelled").alias("c_labelled"), F.sum("bad").alias("c_bad"), F.count(F.lit(1)).alias("n"), F.min("share").alias("above"), F.min("all").alias("all"))
    quiet = (F.col("class") == 0) & (F.col("c_labelled") == F.col("all"))  # no branch differs
    share = F.when(quiet, F.col("above")).otherwise(_smooth(F.col("c_bad"), F.col("c_labelled"), F.col("above"), settings))
    whole = whole.select(*node, "class", "n", share.alias("below"), "c_labelled", "c_bad")
    name = F.when(F.col("n") == 1, F.substring("branch", 2, 1 << 30)).when(F.col("class") == 0, "*").otherwise(F.concat(F.lit("*"), F.col("class").cast("string")))
    return both.select(*node, "branch", "class").join(whole, [*node, "class"]).select(*node, "branch", name.alias("name"), "below", "c_labelled", "c_bad")


def generalised(tree: DataFrame, settings: Settings) -> DataFrame:
    """(host, tokens, template, share) of every host and token path, from the root of each host down.

    The table has one row per host and token path, not per page, and holds only
    paths whose class is still split.
    """
    node, empty = ["host", "template"], F.expr("cast(array() as array<string>)")
    more = lambda rest: F.when(F.size(rest) > 0, F.array(F.lit("**"))).otherwise(empty)
    open_ = saved(tree.join(_hosts(tree, settings), "host").select("host", "tokens", "labelled", "bad", empty.alias("template"), F.col("tokens").alias("rest"), "share"), "urls-open")
    done: list[DataFrame] = []
    while True:
        # What the labelled paths of a node have in common.
        heads = open_.where("labelled > 0").groupBy(*node).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("labelled").alias("all"), F.sum("bad").alias("all_bad"))
        heads = heads.where((F.col("all") >= settings.least) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all"))).select(*node, F.slice("lo", F.lit(1), _in_common(F.col("lo"), F.col("hi"))).alias("path"))
        met = open_.join(heads.withColumn("split", F.lit(True)), node, "left").withColumn("path", F.coalesce("path", empty)).withColumn("along", _in_common(F.col("rest"), F.col("path")))
        after = lambda n: F.slice("rest", n + 1, F.size("rest"))
        met = saved(met.select(
            "host", "tokens", "labelled", "bad", "share", F.concat("template", F.slice("path", F.lit(1), F.col("along"))).alias("template"), after(F.col("along")).alias("rest"),
            (F.coalesce("split", F.lit(False)) & (F.col("along") == F.size("path"))).alias("split"),
        ), "urls-steps")
        done.append(met.where("not split").select("host", "tokens", F.concat("template", more(F.col("rest"))).alias("template"), "share"))
        here = met.where("split").withColumn("branch", F.when(F.size("rest") > 0, F.concat(F.lit("/"), F.get("rest", F.lit(0)))).otherwise(""))
        if here.isEmpty():
            return reduce(DataFrame.unionByName, done)
        step = here.join(_classes(here, settings), [*node, "branch"])
        ended = F.size("rest") == 0
        open_ = saved(step.select(
            "host", "tokens", "labelled", "bad", F.when(ended, F.col("template")).otherwise(F.concat("template", F.array("name"))).alias("template"), F.when(ended, F.col("rest")).otherwise(F.slice("rest", F.lit(2), F.size("rest"))).alias("rest"),
            F.col("below").alias("share"), (~ended & (F.col("c_labelled") >= settings.least) & (F.col("c_bad") > 0) & (F.col("c_bad") < F.col("c_labelled"))).alias("split"),
        ), "urls-open")
        done.append(open_.where("not split").select("host", "tokens", F.concat("template", more(F.col("rest"))).alias("template"), "share"))
        open_ = open_.where("split").drop("split")


def judge(pages: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, template, bad_share of every row of ``pages``.

    The verdict table has one row per host and token path and is written, so
    that it is sent to all only if its files are small; else a host with a
    large part of all pages is a skewed join, which is split at run time.
    """
    rows = parsed(pages, key, url)
    share = F.round("share", 6)
    table = generalised(saved(leaves(rows, labels, key), "urls-leaves"), settings).select(
        "host", "tokens", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), share.alias("bad_share"),
        F.when(share >= settings.reject, "block").otherwise("allow").alias("judged"),
    )
    met = rows.join(saved(table, "urls-verdicts"), ["host", "tokens"], "left")
    return met.select(
        key, "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "judged").alias("verdict"), "template", "bad_share",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over the whole ``pages`` table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad")
    )
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), labels)
