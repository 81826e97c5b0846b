"""URL filters: a tree of path templates per host, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.llm.words import lower_az

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
END = ""


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, start = text[:text.index("/")], text[text.index("/"):]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """A path whose digits, and words of hexadecimal digits and hyphens that hold one, are generalised.

    A word is tried at its start only and never given back, so the time is linear in the length of a path.
    """
    return F.regexp_replace(path, "(?<![0-9a-fA-F-])[a-fA-F-]*+[0-9][0-9a-fA-F-]*+", "#")


def past_common(rows: DataFrame) -> DataFrame:
    """Rows (..., template, rest) with the segments that all rows of a host and template have next moved to the template, and
    `open`, whether any of those rows goes on differently from another."""
    ends = rows.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    # Arrays are in order of their segments: what the least and the greatest begin with, so do all between them.
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
    common = F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int")
    ends = ends.select("host", "template", F.slice("low", F.lit(1), common).alias("common"), (differ > 0).alias("open"))
    return rows.join(ends, ["host", "template"]).select(
        "host", "shape", "n", "bad", "good",
        F.concat("template", F.array_join(F.transform("common", lambda s: F.concat(F.lit("/"), s)), "")).alias("template"),
        F.slice("rest", F.size("common") + 1, F.size("rest")).alias("rest"), "open",
    )


def one_level(rows: DataFrame, tolerance: float) -> DataFrame:
    """Rows (..., template, rest) with the next segment moved to the template, as it is or as a wildcard."""
    rows = rows.withColumns({
        "segment": F.coalesce(F.get("rest", F.lit(0)), F.lit(END)), "next": F.coalesce(F.get("rest", F.lit(1)), F.lit(END)),
    })
    pairs = rows.groupBy("host", "template", "segment", "next").agg(F.sum("n").alias("n"))
    branches = pairs.groupBy("host", "template", "segment").agg(F.sum("n").alias("own"), F.count("*").alias("kinds"))
    whole = branches.groupBy("host", "template").agg(F.sum("own").alias("all"), F.count("*").alias("branches"))
    nexts = pairs.groupBy("host", "template", "next").agg(F.sum("n").alias("of_next"))
    # Shares of segments that do not follow a branch at all are what is left of the whole.
    met = pairs.join(branches, ["host", "template", "segment"]).join(whole, ["host", "template"]).join(nexts, ["host", "template", "next"])
    share = F.col("of_next") / F.col("all")
    far = met.groupBy("host", "template", "segment").agg(
        ((F.sum(F.abs(F.col("n") / F.col("own") - share)) + 1 - F.sum(share)) / 2).alias("far"),
        F.max("own").alias("own"), F.max("kinds").alias("kinds"), F.max("all").alias("all"), F.max("branches").alias("branches"),
    )
    # Shares are summed in any order, so a tie must not hang on the last bit.
    alike = (F.col("branches") > 1) & (F.col("far") <= tolerance + 0.5 * F.sqrt(F.col("kinds") / F.col("own")) + 1e-9)
    variable = (F.col("branches") >= 8) & (F.col("own") * F.col("branches") <= 2 * F.col("all")) & (2 * F.col("branches") > F.col("all"))
    merged = far.select("host", "template", "segment", (alike | variable).alias("merged"))
    name = F.when(F.col("segment") == END, END).when(F.col("merged"), "/*").otherwise(F.concat(F.lit("/"), "segment"))
    return rows.join(merged, ["host", "template", "segment"]).select(
        "host", "shape", "n", "bad", "good", F.concat("template", name).alias("template"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"),
    )


def path_tree(shapes: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(host, shape, n, bad, good, template) for rows (host, shape, n, bad, good), one per host and shape.

    Level by level from the host: a branch is one segment below a template. If the segments that follow it are spread like
    those that follow all branches of that template together (half the summed difference of shares is at most `tolerance`
    and what chance gives for so few pages), the branch is merged with its like into a wildcard; so is a branch
    among many rare ones, since that segment is a variable.

    Segments that all rows below a template share branch nowhere and are passed at once. So there are as many rounds as
    branchings on one path, whatever its depth, and a round reads only what still branches.
    """
    rest = F.filter(F.split("shape", "/"), lambda s: s != "")
    rows, done, level = shapes.select("host", "shape", "n", "bad", "good", F.lit(END).alias("template"), rest.alias("rest")), None, 0
    while True:
        passed = runtime.written(past_common(rows), f"passed-{level}")
        ended = passed.where("not open").select("host", "shape", "n", "bad", "good", "template")
        done = ended if done is None else done.unionAll(ended)
        going = passed.where("open").drop("open")
        if going.limit(1).count() == 0:
            return done
        rows, level = runtime.written(one_level(going, tolerance), f"level-{level}"), level + 1


def rejected(tree: DataFrame, purity: float = 0.8, share: float = 0.5, weight: float = 2.0) -> DataFrame:
    """Adds `rejected` to rows of a tree.

    The purity of a template is the share of blocked among its labelled pages, drawn by `weight` pages towards that of
    its host, and that towards one half. A template goes if it is pure and at least `share` of its pages are labelled.
    Pages are summed per template and then per host, so a host of many shapes is no group of one task.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    templates = tree.groupBy("host", "template").agg(*sums)
    labelled = F.col("bad") + F.col("good")
    hosts = templates.groupBy("host").agg(((F.sum("bad") + weight / 2) / (F.sum(labelled) + weight)).alias("host_purity"))
    pure = (F.col("bad") + weight * F.col("host_purity")) / (labelled + weight) >= purity
    judged = templates.join(hosts, "host").select("host", "template", (pure & (labelled / F.col("n") >= share)).alias("rejected"))
    return tree.join(judged, ["host", "template"])


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for every row of `pages`.

    Pages with a rule are the labelled ones. All pages are counted by host and shape of path first, so the tree is built
    on those counts and a large host is many small rows. A null url, or one without ://, has an empty host and path, which
    is a host like any other. Repeated rows are counted and returned each. Paths may have any length and depth. No rows: no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = runtime.written(rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), shape_of(F.col("path")).alias("shape")), "urls")
    shapes = runtime.written(rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count_if(F.col("by_rule") == "block").alias("bad"), F.count_if(F.col("by_rule") == "allow").alias("good")
    ), "url-shapes")
    judged = rejected(path_tree(shapes)).select("host", "shape", "template", "rejected")
    by_method = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.join(judged, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "template"
    )
