"""URL filter: list rules first, association rules for the rest.

List rules name a host (with all subdomains) and a path prefix; the longest that fits decides.  They are matched with
one hash lookup for each pair of a host suffix and a rule-path length, in DataFrame functions.

URLs that no list rule decides get the verdict of mined rules.  Spark's FP-growth finds combinations of URL tokens
that occur often in URLs labelled by people or by their content together with a label; rules are kept by confidence, by support, and only if no rule
with fewer tokens is as good.  They match by an inverted index: a rule stands under its rarest token, so a URL looks at
the few rules that stand under its own tokens.  The best rule (confidence, support, tokens) gives the verdict; a URL
that none fits is allowed.

The miner sees about ``max_labelled`` labelled URLs (a documented bound: those whose ids have the lowest hashes).  Every
rule it finds is pruned on the executors, and those that are left are all kept.  They cannot be many, however many pages
there are: each holds in at least ``min_support`` of the baskets, and a basket of t tokens holds no more than
t + t^2 / 2 + t^3 / 6 combinations, so there are at most that (its mean) divided by ``min_support``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class ListRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The list rules of the contract.
LIST_RULES = (
    ListRule("com", "/", "allow"),
    ListRule("example.com", "/en/", "block"),
    ListRule("www.example.com", "/en/", "allow"),
    ListRule("net", "/es/", "block"),
    ListRule("net", "/fr/", "block"),
)
LABEL = "label="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def list_rule(host: Column, path: Column, rules: tuple[ListRule, ...] = LIST_RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest list rule (host and path together; then host) that fits, else null.

    A host of n labels has n suffixes, so this makes n times (number of rule-path lengths) lookups, however many rules
    there are."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted({len(r.path) for r in rules})])
    prefixes = F.transform(F.filter(lengths, lambda n: F.length(path) >= n), lambda n: F.substring(path, F.lit(1), n))
    names = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    found = F.filter(names, lambda n: F.element_at(verdicts, n).isNotNull())
    longest = F.array_max(F.transform(found, lambda n: F.struct(F.length(n).alias("size"), n.alias("name")))).getField("name")
    return longest, F.element_at(verdicts, longest)


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: scheme, labels and suffixes of the host, first parts of the path, extension, query
    keys, fragment."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.element_at(parts, -1)
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    several = [
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.array(F.concat(F.lit("top:"), F.element_at(labels, -1))),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")))),
        F.when(F.size(parts) > 0, F.array(F.concat(F.lit("dir:"), F.element_at(parts, 1)))),
        F.when(F.size(parts) > 0, F.when(last.contains("."), F.array(F.concat(F.lit("ext:"), F.regexp_extract(last, r"\.([^.]*)$", 1))))),
        F.transform(F.filter(query, lambda q: q != ""), lambda q: F.concat(F.lit("arg:"), F.regexp_extract(q, "^([^=]*)", 1))),
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^([A-Za-z0-9+.-]*)://", 1))),
        F.when(url.contains("#"), F.array(F.lit("fragment"))),
    ]
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in several]))


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float
    lift: float

    def rank(self) -> tuple:
        return (self.confidence, self.support, -len(self.tokens), self.tokens)


def pruned(rules: DataFrame) -> DataFrame:
    """rules (tokens, in order; verdict, confidence, ...) without those of which fewer tokens imply the same verdict
    with at least the same confidence."""
    # each number below 2^n - 1 names a part: its bits are the tokens that stay
    part = "transform(sequence(1, shiftleft(1, size(tokens)) - 2), b -> filter(tokens, (t, k) -> (shiftright(b, k) & 1) = 1))"
    parts = rules.where("size(tokens) > 1").select("tokens", "verdict", "confidence", F.explode(F.expr(part)).alias("part"))
    smaller = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("least"))
    worse = parts.join(smaller, ["part", "verdict"]).where("least >= confidence").select("tokens", "verdict").distinct()
    return rules.join(worse, ["tokens", "verdict"], "left_anti")


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, max_labelled: int = 100_000, max_tokens: int = 3) -> tuple[MinedRule, ...]:
    """labelled: (id, tokens, label).  Rules whose tokens imply a label; none if nothing is labelled."""
    known = labelled.where("label IS NOT NULL")
    share = max_labelled / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    basket = C.cut(known.select(F.array_append("tokens", F.concat(F.lit(LABEL), "label")).alias("items")))
    if not basket.head(1):
        return ()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(basket)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL)).where(F.size("antecedent") <= max_tokens)
    rules = rules.where(~F.exists("antecedent", lambda a: a.startswith(LABEL))).where("lift > 1.0")
    verdict = F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 100).alias("verdict")
    found = pruned(C.cut(rules.select(F.sort_array("antecedent").alias("tokens"), verdict, "confidence", "support", "lift")))
    kept = [MinedRule(tuple(r.tokens), r.verdict, r.confidence, r.support, r.lift) for r in found.collect()]  # bounded as said above
    return tuple(sorted(kept, key=MinedRule.rank, reverse=True))


class RuleIndex:
    """Mined rules under the token of each that fewest rules hold."""

    def __init__(self, rules: tuple[MinedRule, ...]):
        count: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                count[t] = count.get(t, 0) + 1
        self.under: dict[str, list[tuple[int, frozenset[str], str]]] = {}
        for place, r in enumerate(rules):  # rules come best first
            rarest = min(r.tokens, key=lambda t: (count[t], t))
            self.under.setdefault(rarest, []).append((place, frozenset(r.tokens), r.verdict))

    def verdict(self, found: list[str]) -> tuple[str, int]:
        """Verdict and place of the best rule that fits; allow and -1 if none does."""
        have, best = set(found), (1 << 60, "allow")
        for t in have:
            for place, need, verdict in self.under.get(t, ()):
                if place >= best[0]:
                    break
                if need <= have:
                    best = (place, verdict)
                    break
        return best[1], -1 if best[0] == 1 << 60 else best[0]


def judge_urls(pages: DataFrame, labels: DataFrame | None, rules: tuple[ListRule, ...] = LIST_RULES, **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined: tokens of the mined rule used, or null) for every row of pages
    (page_id, url).

    labels (doc_id, quality, toxic): a page whose id it holds is labelled block if toxic or of quality 0 in any row,
    else allow; without labels nothing is mined.  What the list decides is no label: its verdicts are chosen by the very
    tokens that the miner would find, and rules learned from them reach beyond the list.  Null or odd urls have an empty
    host and path, fit no list rule and are allowed unless a mined rule fits.  Rows alike are judged each; an empty table
    gives no rows."""
    pages = C.pick(pages, page_id="page_id", url="url")
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = list_rule(F.col("host"), F.col("path"), rules)
    known = split.withColumn("rule", name).withColumn("listed", verdict)
    known = known.withColumn("tokens", tokens(F.col("host"), F.col("path"), F.coalesce("url", F.lit(""))))
    mined: tuple[MinedRule, ...] = ()
    if labels is not None:
        given = C.pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
        given = given.where("doc_id IS NOT NULL AND bad IS NOT NULL").select(F.col("doc_id").alias("id"), F.when(F.col("bad") == 1, "block").otherwise("allow").alias("label"))
        mined = mine(known.select(F.col("page_id").alias("id"), "tokens").join(given, "id"), **mining)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(mined)
        for batch in batches:
            verdicts, used = [], []
            for listed, found in zip(batch.column("listed").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                by_rule, place = (listed, -1) if listed is not None else index.verdict(found)
                verdicts.append(by_rule)
                used.append(" ".join(mined[place].tokens) if place >= 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("page_id", "host", "path", "rule")] + [pa.array(verdicts, pa.string()), pa.array(used, pa.string())], ["page_id", "host", "path", "rule", "verdict", "mined"])

    rows = known.select(F.col("page_id").cast("long"), "host", "path", "rule", "listed", "tokens")
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, mined string")


def op2_url_association_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
