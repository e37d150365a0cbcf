"""URL filters: rules by host and path, and rules that are mined from labelled URLs.

``decide`` applies hand-written rules: a rule fits its host and all subdomains where the path starts with the rule's; the longest
wins. For all other URLs association rules decide. A URL becomes a set of tokens: labels of its host with their place (``tld:``,
``domain:``, ``sub:``), its scheme, path segments (``path:``; numbers as one token), names and name=value pairs of its query.
Spark's FP-growth mines the sets of tokens that stand together with the label *block*; a set is a rule if it has
``MIN_SUPPORT`` of all URLs (``MIN_COUNT`` at least) and ``MIN_CONFIDENCE`` of the URLs with these tokens are labelled block. A URL without a label
counts against a rule, so what is known of a few labelled sites does not condemn a whole top-level domain. A rule of
which a part is a rule of at least its confidence says nothing new, and is pruned. URLs are matched by an inverted index:
a rule is looked up under the token of it that fewest URLs have, and stands if the URL has all the others.

A rule is a set of at most ``MAX_RULE`` tokens; all such rules are found, and their counts are exact: only what cannot be in one
is left out. That is a token of fewer blocked URLs than a rule needs, and in larger sets a token that is blocked wherever it
stands, as it is a rule by itself and prunes them. Where a URL has more than ``MAX_ITEMS`` tokens after that, the sets
of FP-growth could grow as 2 ** tokens, and sets are counted level by level instead (``_by_levels``), with the same result.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens, no rule, and is allowed; tokens that
repeat in a URL count once; rows that repeat are judged each; where nothing is labelled block there are no mined rules; an
empty table gives no rows; of equally long rules the first stands; other columns pass through ``judge``,
but those named like its results, which are replaced."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from capturelake.llm.common import arrow_rows, materialize, table

ALLOW, BLOCK = "allow", "block"
#: Verdict, host, path.
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.001, 20, 0.9
MAX_ITEMS, MAX_RULE = 12, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What comes after the first ://, up to ? or #; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^?#]*)", 1)).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^([^/]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"(?s)^[^/]*(.*)$", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path in one), and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL."""
    url = F.coalesce(url, F.lit(""))
    named = lambda kind, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    at = F.instr(url, "://")
    scheme = F.when(at > 1, F.array(F.translate(F.substring(url, F.lit(1), at - 1), UPPER, LOWER))).otherwise(F.array().cast("array<string>"))
    labels = F.filter(F.split(F.regexp_replace(host(url), r"^.*@|:\d*$", ""), r"\."), lambda x: x != "")
    n = F.size(labels)
    sub = F.when(n > 2, F.slice(labels, 1, F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    last = lambda i: F.when(n >= i, F.array(F.element_at(labels, -i))).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.split(path(url), "/"), lambda x: F.regexp_replace(x, r"\d+", "0"))
    query = F.split(F.when(at > 0, F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)).otherwise(""), "&")
    return F.array_distinct(F.concat(named("scheme", scheme), named("tld", last(1)), named("domain", last(2)), named("sub", sub), named("path", segments), named("query", F.transform(query, lambda x: F.substring_index(x, "=", 1))), named("pair", F.filter(query, lambda x: F.contains(x, F.lit("="))))))


@dataclass(frozen=True)
class Rule:
    """Tokens that stand together; the share of URLs with them that are blocked, and of all URLs that are blocked and have them."""

    tokens: tuple[str, ...]
    confidence: float
    support: float


def _by_growth(rows: DataFrame, least: int, max_rule: int) -> DataFrame:
    """tokens, hits, freq of the sets of at least ``least`` blocked rows (blocked, items), by FP-growth."""
    marked = rows.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows.count(), numPartitions=parts).fit(marked).freqItemsets
    with_label = sets.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1) & (F.size("items") <= max_rule + 1)).select(F.array_sort(F.array_remove("items", BLOCK)).alias("tokens"), F.col("freq").alias("hits"))
    alone = sets.filter(~F.array_contains("items", BLOCK) & (F.size("items") <= max_rule)).select(F.array_sort("items").alias("tokens"), "freq")
    return with_label.join(alone, "tokens")


def _by_levels(rows: DataFrame, least: int, max_rule: int) -> DataFrame:
    """As _by_growth, without sets that no kept rule can be: those that hold a set which is blocked wherever it stands, or one that
    stands wherever a part of it does. Sets of a URL grow by one token a level, and only from sets that are left."""
    counted = lambda df: df.groupBy("tokens").agg(F.count_if("blocked").alias("hits"), F.count("*").alias("freq")).filter(F.col("hits") >= least)
    held = rows.select("blocked", "items", F.explode(F.transform("items", lambda x: F.array(x))).alias("tokens"))
    out = found = materialize(counted(held))
    for size in range(2, max_rule + 1):
        alive = found.filter("hits < freq")
        held = materialize(held.join(alive.select("tokens"), "tokens", "left_semi"))
        last = F.element_at("tokens", -1)
        held = held.select("blocked", "items", F.explode(F.transform(F.filter("items", lambda x: x > last), lambda x: F.concat("tokens", F.array(x)))).alias("tokens"))
        sets = materialize(counted(held))
        parts = sets.select("tokens", "freq", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("part"))
        fresh = parts.join(alive.select(F.col("tokens").alias("part"), F.col("freq").alias("of")), "part").groupBy("tokens", "freq").agg(F.count("*").alias("n"), F.min("of").alias("of"))
        found = materialize(sets.join(fresh.filter((F.col("n") == size) & (F.col("of") > F.col("freq"))).select("tokens"), "tokens", "left_semi"))
        out = out.unionByName(found)
        if found.head() is None:
            break
    return out


def mine(urls: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, max_items: int = MAX_ITEMS, max_rule: int = MAX_RULE) -> list[Rule]:
    """Rules for the label block. Label is block, anything else, or null; all but block count against a rule.

    max_items says how long URLs may be for FP-growth; it changes no rule."""
    rows = urls.select(F.coalesce(urls[label_col] == BLOCK, F.lit(False)).alias("blocked"), tokens(urls[url_col].cast("string")).alias("tokens"))
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()))
    total = rows.count()
    least = max(1, min_count, math.ceil(min_support * total - 1e-9))
    each = rows.select("id", "blocked", F.explode("tokens").alias("token"))
    often = materialize(each.groupBy("token").agg(F.count_if("blocked").alias("hits"), F.count("*").alias("freq")).filter(F.col("hits") >= least))
    sure = often.filter("hits = freq").select(F.array("token").alias("tokens"), "hits", "freq")
    marked = materialize(each.join(often.filter("hits < freq"), "token").groupBy("id", "blocked").agg(F.array_sort(F.collect_list("token")).alias("items")))
    longest = marked.agg(F.max(F.size("items"))).first()[0]
    sets = sure
    if longest:
        sets = sure.unionByName((_by_growth if longest <= max_items else _by_levels)(marked, least, max_rule))
    found = materialize(sets.withColumn("confidence", F.col("hits") / F.col("freq")).filter(F.col("confidence") >= min_confidence).select("tokens", "hits", "confidence"))
    n = F.size("tokens")
    part = lambda m: F.filter("tokens", lambda x, i: F.floor(m / F.pow(F.lit(2), i)).cast("int") % 2 == 1)
    parts = found.filter(n > 1).select("tokens", "confidence", F.explode(F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 2), part)).alias("part"))
    better = found.select(F.col("tokens").alias("part"), F.col("confidence").alias("other"))
    idle = parts.join(better, "part").filter(F.col("other") >= F.col("confidence")).select("tokens").distinct()
    kept = found.join(idle, "tokens", "left_anti").collect()  # the rules: each stands for a share of min_support of the URLs
    return sorted((Rule(tuple(r.tokens), r.confidence, r.hits / total) for r in kept), key=lambda r: (-r.confidence, -r.support, r.tokens))


class Index:
    """Rules by the token of them that fewest rules have; the best rule of a URL is the first in the order of ``mine``."""

    def __init__(self, rules: list[Rule]):
        count: dict[str, int] = defaultdict(int)
        for r in rules:
            for t in r.tokens:
                count[t] += 1
        self.under: dict[str, list[tuple[int, frozenset[str]]]] = defaultdict(list)
        for n, r in enumerate(rules):
            self.under[min(r.tokens, key=lambda t: (count[t], t))].append((n, frozenset(r.tokens)))
        self.under = dict(self.under)

    def best(self, held: list[str]) -> int | None:
        have, out = set(held), None
        for t in held:
            for n, needs in self.under.get(t, ()):
                if (out is None or n < out) and needs <= have:
                    out = n
        return out


def match(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """urls with mined (tokens of the best rule, joined by spaces; null where none stands) and confidence."""
    if not rules:
        return urls.withColumn("mined", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    arrow_rows(urls.sparkSession, 10_000)
    index, names, sure = Index(rules), [" ".join(r.tokens) for r in rules], [r.confidence for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [index.best(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            more = [pa.array([None if b is None else names[b] for b in best], pa.string()), pa.array([None if b is None else sure[b] for b in best], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], "mined", "confidence"])

    rows = urls.select("*", tokens(urls[url_col].cast("string")).alias("__tokens"))
    return rows.mapInArrow(run, StructType([*urls.schema.fields, StructField("mined", StringType()), StructField("confidence", DoubleType())]))


def decide(urls: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """urls with host, path, rule and label (the rule's verdict)."""
    url = urls[url_col].cast("string")
    rows = urls.withColumn("host", host(url)).withColumn("path", path(url))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", rule).withColumn("label", verdict)


def judge(urls: DataFrame, mined: list[Rule], url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """urls with host, path, rule, mined, confidence and verdict: the longest rule's, else block where a mined rule stands, else allow."""
    out = match(decide(urls, url_col, rules), mined, url_col)
    return out.withColumn("verdict", F.coalesce("label", F.when(F.col("mined").isNotNull(), BLOCK), F.lit(ALLOW))).drop("label")


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that hand-written rules decide are the labelled ones; all others count as not blocked in mining."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(urls, mine(decide(urls))).select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")
