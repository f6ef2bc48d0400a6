"""URL filters by a path-template tree, in DataFrame operations only.

Rules (host, path) decide the URLs they fit. All others are judged by the templates of their host: segment by segment,
a segment becomes a wildcard if it holds a digit or if most URLs of its branch have a segment of their own there; a file
ending stays. At every inner node, from the leaves up, branches that differ in their own segment only are tested: one
whose labelled share does not differ from that of the others by a two-sample test becomes `?`, and the branches that do
so below one parent are one template from there on. The share of blocked URLs among its labelled ones, smoothed towards
the host's and the host's towards that of all, is its purity; templates that reach `REJECT` are rejected. Labels are the
rules' own verdicts.

Work after the first aggregation is on distinct (host, path) pairs and on templates. Joins of paths with nodes and
templates are spread by a hash of the path, so a very common host or template is no single task. A level costs a round
only where some node branches.

Defined results: a NULL URL, or one without `://`, has an empty host and path and is judged like any other. Paths of any
depth are read whole. Repeated rows get equal verdicts. Equal shares are alike, also where all or none are blocked; a
branch without labels, or without labelled siblings, is merged with nothing and takes its host's share. An empty table
gives no rows. Rows without an id are judged and returned; further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.functions.single import attach
from dockflow.session import scratch_dir, staged

#: A branch needs so many URLs before the variety of its segments counts.
LEAST = 8
VARIETY = 0.5
#: Pseudo-counts of the smoothing, the deviations of the similarity test, and the purity that rejects.
WEIGHT = 4.0
DEVIATIONS = 1.96
REJECT = 0.8
#: Parts into which the paths of one node are spread.
PARTS = 256

#: Rules of the production query: what they say, then host and path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; empty without `://`."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits `host` and `path`, and what it says; NULL if none does."""
    rule = says = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, says = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(says)
    return rule, says


def _spread(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """`many` (distinct host and path) with the columns of `few`, by `keys`, which may be few and hold very many paths.

    A row of `few` is copied once for each hash of the paths that meet it, so no task gets more than one part in `PARTS`
    of a key.
    """
    many = many.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS)))
    return many.join(many.select(*keys, "part").distinct().join(few, keys), [*keys, "part"]).drop("part")


def _templates(paths: DataFrame) -> DataFrame:
    """Adds `template` to distinct (host, path) rows."""
    def step(segment: Column, various: Column) -> Column:
        wild = segment.rlike("[0-9]") | various
        ending = F.regexp_extract(segment, r"\.[a-z]+$", 0)
        return F.concat(F.lit("/"), F.when(wild, F.concat(F.lit("*"), ending)).otherwise(segment))

    def plain(segments: Column) -> Column:
        return F.array_join(F.transform(segments, lambda x: step(x, F.lit(False))), "")

    now = paths.withColumn("rest", F.split(F.ltrim(F.col("path"), F.lit("/")), "/")).withColumn("template", F.lit(""))
    spark, ended = paths.sparkSession, []
    while True:
        now = now.withColumn("segment", F.get("rest", F.lit(0)))
        seen = now.groupBy("host", "template", "segment").agg(
            F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("rest").alias("low"), F.max("rest").alias("high")
        )
        node = seen.groupBy("host", "template").agg(
            F.sum("n").alias("all"), F.count("*").alias("kinds"), F.sum("rows").alias("rows"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
        # What the least and the greatest rest begin with, all of them begin with: a chain without branches.
        same = F.zip_with("low", "high", lambda x, y: F.coalesce(x == y, F.lit(False)))
        chain = F.coalesce(F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1, F.size("low"))
        node = node.withColumn("chain", chain).drop("low", "high")
        various = (F.col("all") >= LEAST) & (F.col("kinds") > VARIETY * F.col("all"))
        now = _spread(now, node, ["host", "template"])
        # So few paths have no branch with enough variety below them: the rest of each needs no counts.
        few = F.col("rows") <= LEAST * VARIETY
        taken = F.when(few, F.size("rest")).otherwise(F.greatest("chain", F.lit(1)))
        one = step(F.col("segment"), various)
        beyond = F.slice("rest", 2, F.greatest(F.col("taken") - 1, F.lit(0)))
        now = now.withColumn("taken", taken).select(
            "host", "path", "n", "good", "bad", F.concat("template", one, plain(beyond)).alias("template"),
            F.slice("rest", F.col("taken") + 1, F.size("rest")).alias("rest"),
        )
        # Every level reads the one before twice: written, the plan stays one level deep.
        now = staged(now)
        ended.append(scratch_dir(spark))
        done = now.where(F.size("rest") == 0).drop("rest")
        done.write.parquet(ended[-1])
        now = now.where(F.size("rest") > 0)
        if now.isEmpty():
            break
    return spark.read.schema(done.schema).parquet(*ended)


def _alike() -> Column:
    """Whether the share of blocked ones of (good, bad) is that of the others in (good_all, bad_all), by two samples."""
    one, rest = F.col("good") + F.col("bad"), F.col("good_all") + F.col("bad_all") - F.col("good") - F.col("bad")
    pooled = F.try_divide(F.col("bad_all"), F.col("good_all") + F.col("bad_all"))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), one) + F.try_divide(F.lit(1.0), rest)))
    apart = F.abs(F.try_divide(F.col("bad"), one) - F.try_divide(F.col("bad_all") - F.col("bad"), rest))
    return F.coalesce(apart <= DEVIATIONS * spread, F.lit(False))


def _branching(branch: DataFrame) -> list[int]:
    """The levels, deepest first, at which some node has several children; at most as many as the longest path has."""
    segments = F.split(F.substring("template", 2, F.length("template")), "/")
    level = F.posexplode(F.transform(segments, lambda x, i: F.struct(
        F.xxhash64(F.slice(segments, F.lit(1), i)).alias("above"), x.alias("segment"))))
    node = branch.select("host", level.alias("level", "at")).groupBy("host", "level", "at.above")
    several = node.agg(F.min("at.segment").alias("low"), F.max("at.segment").alias("high")).where("low < high")
    return [r.level for r in several.select("level").distinct().orderBy(F.desc("level")).collect()]


def _merged(branch: DataFrame) -> DataFrame:
    """Adds `merged` to (host, template, good, bad): the template with `?` where branches are alike, leaves first.

    Below one parent, branches that differ in their own segment only, as merged so far, are tested against each other;
    `?` occurs in no path. Levels at which no node has two children have nothing to merge and take no round.
    """
    counts = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    rows = branch.withColumn("merged", F.col("template"))
    for level in _branching(branch):
        segments = F.split(F.substring("merged", 2, F.length("merged")), "/")
        around = F.concat(F.lit("/"), F.array_join(F.transform(
            segments, lambda x, i: F.when(i == level, F.lit("?")).otherwise(x)), "/"))  # noqa: B023
        deep = rows.where(F.size(segments) > level)
        each = deep.groupBy("host", "merged").agg(*counts).withColumn("around", around)
        total = each.groupBy("host", "around").agg(F.sum("good").alias("good_all"), F.sum("bad").alias("bad_all"))
        alike = each.join(total, ["host", "around"]).where(_alike()).select("host", "merged", "around")
        rows = staged(rows.join(alike, ["host", "merged"], "left").select(
            "host", "template", "good", "bad", F.coalesce("around", "merged").alias("merged")))
    return rows


def _purity(placed: DataFrame) -> DataFrame:
    """(host, template, merged, purity) after merging of similar branches and smoothing."""
    counts = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    branch = _merged(staged(placed.groupBy("host", "template").agg(*counts)))
    class_ = branch.groupBy("host", "merged").agg(*counts)
    host = branch.groupBy("host").agg(F.sum("good").alias("good_host"), F.sum("bad").alias("bad_host"))
    total = host.agg(F.sum("good_host").alias("good_total"), F.sum("bad_host").alias("bad_total"))
    rows = attach(class_.join(host, "host"), total)
    everywhere = (F.col("bad_total") + 1.0) / (F.col("good_total") + F.col("bad_total") + 2.0)
    at_host = (F.col("bad_host") + WEIGHT * everywhere) / (F.col("good_host") + F.col("bad_host") + WEIGHT)
    purity = (F.col("bad") + WEIGHT * at_host) / (F.col("good") + F.col("bad") + WEIGHT)
    scored = rows.select("host", "merged", F.round(purity, 9).alias("purity"))
    return branch.select("host", "template", "merged").join(scored, ["host", "merged"])


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """`key`, host, path, rule, verdict, template, merged template, purity of every row."""
    host, path = parts(F.col(url))
    rule, says = matched(rules)
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.select("key", "host", "path", rule.alias("rule"), says.alias("says"))
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("says") == "allow").alias("good"),
        F.count_if(F.col("says") == "block").alias("bad"),
    )
    placed = staged(_templates(staged(paths)))
    scored = _spread(placed.select("host", "path", "template"), _purity(placed), ["host", "template"])
    found = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    out = rows.join(scored, ["host", "path"])
    return out.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("says", found).alias("verdict"),
        "template", "merged", "purity",
    )
