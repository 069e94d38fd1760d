"""URL filters: curated host/path rules, then mined association rules.

Curated rules decide first (longest fitting rule wins). For every other url
the verdict comes from rules that Spark's FP-growth mines from labelled urls: token
combinations that go with the label "bad" often enough (support), surely
enough (confidence) and more often than urls do at large (lift). Mined rules are matched through an inverted index: each
rule hangs on its rarest token, so a url only meets rules that share that token.

All of it is DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule must have this many bad rows, whatever the input's size.
MIN_ROWS = 4
#: The token that bad rows hold when they are mined; no url has it.
BAD = "!bad"
#: Rules are learnt from at most about this many labelled rows, as FP-growth holds every frequent token on the driver.
SAMPLE_ROWS = 200_000
#: Up to this many rules are broadcast; more are joined by shuffle, dealt over SALTS tasks a token.
MAX_BROADCAST_RULES, SALTS = 50_000, 64


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def curated(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null.

    The list is code or configuration, so it is a literal of the plan; ties in
    length go to the alphabetically first rule.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host, its labels, path parts, query keys, fragment.

    A host's parents are combinations of its labels. Runs of digits in a path become 0, so that article numbers don't make tokens of their own. A null url has none.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    whole = F.when(host != "", F.array(F.concat(F.lit("host="), host)))
    names = F.when(host != "", F.transform(labels, lambda x: F.concat(F.lit("label="), x)))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(F.translate(x, UPPER, LOWER), "[0-9]+", "0")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "^([^:]*)://", 1)))
    mark = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment")))
    none = F.array().cast("array<string>")
    return F.when(url.isNull(), none).otherwise(F.array_distinct(F.concat(scheme, *(F.coalesce(x, none) for x in (whole, names, parts, keys, mark)))))


def mine(labelled: DataFrame, *, min_rows: int = MIN_ROWS, min_confidence: float = 0.6, min_support: float = 0.0, min_lift: float = 1.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rules (items, anchor, support, confidence, lift) from rows (url, bad boolean).

    A rule is a set of url tokens that is in ``min_rows`` bad rows or more (and in the share ``min_support`` of all
    rows, if given), goes with the label often enough, and ``min_lift`` times as often as all rows do; rules no surer than one of their subsets are dropped.
    FP-growth runs over all rows, the bad ones holding one token more, so that each set is counted with and without it. Above a token whose rows are all bad no set can be
    surer, so such tokens are rules of their own and take no part in combinations.
    Beyond ``sample_rows`` rows a sample by hash of the url is learnt from. Repeated rows count each, rows with a null url or label take no part. An empty input gives no rules.
    """
    whole = labelled.where("url is not null and bad is not null").select("url", "bad")
    n = whole.count()
    if n > sample_rows:
        whole = whole.where(F.pmod(F.xxhash64("url", F.lit("mine")), F.lit(1 << 30)) < F.lit(int(sample_rows / n * (1 << 30))))
    each = written(whole.select("bad", tokens(F.col("url")).alias("items")).withColumn("row", F.monotonically_increasing_id()), "url-rows")
    n, n_bad = each.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    floor = max(1, min_rows, math.ceil(min_support * n))
    single = each.select(F.explode("items").alias("item"), "bad").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b")).where(F.col("b") >= floor)
    single = written(single, "url-tokens")
    growing = single.where("b < n").select("item")
    marked = F.when(F.first("bad"), F.concat(F.collect_list("item"), F.array(F.lit(BAD)))).otherwise(F.collect_list("item"))
    rows = written(each.select("row", "bad", F.explode("items").alias("item")).join(growing, "item").groupBy("row").agg(marked.alias("items")).select("items"), "url-rows")
    n_rows = rows.count()
    grown = labelled.sparkSession.createDataFrame([], "items array<string>, freq bigint")
    if n_rows >= floor:
        grown = written(FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / n_rows).fit(rows).freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-sets")
    held = grown.where(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("b")).where(F.size("items") > 1)
    wider = held.join(grown.withColumnRenamed("freq", "n"), "items")
    least = wider.select("items", "n", "b", F.explode("items").alias("item")).join(single.select("item", F.col("n").alias("item_n")), "item")
    wider = least.groupBy("items", "n", "b").agg(F.min(F.struct("item_n", "item")).alias("least")).select("items", F.col("least.item").alias("anchor"), "n", "b")
    every = wider.unionByName(single.select(F.array("item").alias("items"), F.col("item").alias("anchor"), "n", "b"))
    confidence = F.col("b") / F.col("n")
    sure = every.withColumn("confidence", confidence).where((F.col("confidence") >= min_confidence) & (F.col("confidence") * n >= min_lift * n_bad))
    rules = written(sure.select("items", "anchor", F.col("b").alias("support"), "confidence", (F.col("confidence") * n / max(1, n_bad)).alias("lift")), "url-rules")
    wide = rules.select(F.col("items").alias("wide"), F.col("confidence").alias("wide_confidence"), F.explode("items").alias("anchor"))
    beaten = wide.join(rules.select("items", "anchor", "confidence"), "anchor").where((F.size("items") < F.size("wide")) & (F.size(F.array_except("items", "wide")) == 0) & (F.col("confidence") >= F.col("wide_confidence"))).select(F.col("wide").alias("items")).distinct()
    return written(rules.join(beaten, "items", "left_anti"), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Surest fitting mined rule of each distinct url that has one: (url, mined_rule, mined_confidence).

    Of rules as sure, the one of more bad rows wins, then the alphabetically last. Rules should be a table that is cheap to read again.
    """
    each = urls.select("url").where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    each = each.select("url", "tokens", F.explode("tokens").alias("anchor"))
    if rules.count() <= MAX_BROADCAST_RULES:  # tokens that no rule hangs on are never shuffled
        met = each.join(F.broadcast(rules), "anchor")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["anchor", "salt"])
    met = met.where(F.size(F.array_except("items", "tokens")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "support", F.array_join("items", " ").alias("rule"))).alias("best"))
    return best.select("url", F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def curate(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every page with host, path, rule, verdict: what the curated rules say, null for a page that none fits."""
    said = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return said.withColumn("by", curated(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("verdict"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[Rule], **mining) -> DataFrame:
    """Every page with host, path, rule, verdict, mined_rule, mined_confidence.

    ``pages`` has page_id and url; ``labelled`` has url and bad. Columns of
    pages other than these two are not carried. Null urls have an empty host
    and path, fit no rule and are allowed; repeated rows stay repeated; very long urls are read whole; with
    no labels nothing is mined, and what no curated rule blocks is allowed.
    """
    own = pages.select("page_id", "url")
    hits = written(matched(own, mine(labelled, **mining)), "url-hits")  # a table, so that a url of many pages can be split where it is joined
    said = own.where("url is not null").join(hits, "url", "left").unionByName(own.where("url is null"), allowMissingColumns=True)
    said = said.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "mined_rule", "mined_confidence")
    said = said.withColumn("by", curated(F.col("host"), F.col("path"), rules))
    return said.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule", "mined_confidence")


#: Fixed values of the query's contract.
CONTRACT_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def query(spark, sf_dir):
    """op3: every page; a page's label is its document's (bad: quality 0 or toxic 1)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(pages, pages.join(marks, "page_id").select("url", "bad"), CONTRACT_RULES)


def curated_query(spark, sf_dir):
    """The curated part of op3, every page."""
    return curate(spark.read.parquet(f"{sf_dir}/pages.parquet"), CONTRACT_RULES)


CURATED_ORACLE = r"""
WITH rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, verdict FROM parts LEFT JOIN fits USING (page_id)
"""
