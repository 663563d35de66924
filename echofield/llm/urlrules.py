"""URL filters: fixed rules by host and path, and association rules that FP-growth mines from labelled pages.

A url is a set of tokens: host, its domains, path words, extension, query names. Frequent sets with the label "bad" give rules.
A rule must cover pages that are surely bad more often than all labelled pages are, by the lower end of a confidence interval,
and must do so again on pages that no rule was mined from. Each page counts for the surest rule that covers it, so a weak rule
cannot live on the pages of a strong one. An inverted index from each rule's rarest token finds the rules that a url satisfies.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, fold

#: Fixed rules: allow and block by host and path.
ALLOW = ("example.com/en/7", "net/de/")
BLOCK = ("com/en/", "example.net/de/8", "org/es/")
#: Least share of the labelled pages that a rule covers, and least number, so that sets of tokens stay few.
SUPPORT, LEAST_PAGES = 0.002, 5
#: How many standard errors the confidence interval of a rule reaches down, and by what factor its lower end is above the share
#: of bad pages at least.
ERRORS, LIFT = 1.96, 1.0
#: Of five folds of the labelled pages the one that confirms rules, and how often at most rules that fail are taken out.
CONFIRMS, ROUNDS = 1, 10
#: Domains of a host that are tokens besides the host, from the last.
DOMAINS = 8
#: Up to so many tokens a page, FP-growth finds all sets of them, 2 ** TOKENS a page at most; where a page has more, sets are
#: found by size, without those that cannot count.
TOKENS = 12
BAD = "label=bad"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column) -> Column:
    """The longest of the fixed rules that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(ALLOW + BLOCK, key=len):
        domain, _, rest = rule.partition("/")
        found = F.when(((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest), F.lit(rule)).otherwise(found)
    return found


def tokens_of(url: str, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, a few times as long as the url in all; numbers in its path count as one token."""
    domains = F.transform(F.array(host, *[F.substring_index(host, ".", -k) for k in range(1, DOMAINS + 1)]), lambda x: F.concat(F.lit("host="), x))
    words = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"\d+", "0")))
    last = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    names = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    other = F.filter(F.array(F.when(last != "", F.concat(F.lit("ext="), last)), F.when(F.col(url).contains("#"), F.lit("fragment")), F.when(F.col(url).startswith("http:"), F.lit("plain"))), lambda x: x.isNotNull())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, words, names, other)))


@dataclass
class Rules:
    """Mined rules: sets of tokens, and the index from the rarest token of each."""

    sets: list[frozenset[str]]

    @cached_property
    def index(self) -> dict[str, list[int]]:
        often = Counter(t for s in self.sets for t in s)
        out = defaultdict(list)
        for i, s in enumerate(self.sets):
            out[min(s, key=lambda t: (often[t], t))].append(i)
        return dict(out)

    def of(self, tokens: set[str]) -> list[int]:
        """The rules that hold for a set of tokens."""
        return [i for t in tokens for i in self.index.get(t, ()) if self.sets[i] <= tokens]


def lower_end(bad: float, n: float, errors: float = ERRORS) -> float:
    """Of Wilson's interval for the share of bad pages."""
    if not n:
        return 0.0
    share, z = bad / n, errors * errors
    return (share + z / (2 * n) - errors * ((share * (1 - share) + z / (4 * n)) / n) ** 0.5) / (1 + z / n)


def pruned(found: Iterable[Iterable[str]]) -> Rules:
    """The rules but for those that hold a smaller one, which the smaller one makes needless."""
    kept: dict[str, list[frozenset[str]]] = defaultdict(list)
    out = []
    for tokens in sorted(map(frozenset, found), key=lambda s: (len(s), sorted(s))):
        if not any(k < tokens for t in tokens for k in kept[t]):
            out.append(tokens)
            kept[min(tokens)].append(tokens)
    return Rules(out)


def telling(labelled: DataFrame, least: float) -> DataFrame:
    """The rows with those of their tokens that `least` bad rows have: of tokens that are on the same rows the first, as sets
    with any other cover the same pages and come later."""
    marks = [F.bit_xor(F.xxhash64("row", F.lit(k))) for k in range(2)]
    each = cut(labelled.withColumn("row", F.monotonically_increasing_id())).select("row", F.explode("tokens").alias("token"), F.col("bad").cast("int").alias("bad")).distinct()
    often = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), *[m.alias(f"m{k}") for k, m in enumerate(marks)]).where(F.col("bad") >= least)
    chosen = {r["token"] for r in often.groupBy("n", "m0", "m1").agg(F.min("token").alias("token")).collect()}
    shared = labelled.sparkSession.sparkContext.broadcast(chosen)

    def known(tokens: pa.Array) -> pa.Array:
        return pa.array([sorted(shared.value.intersection(row)) for row in tokens.to_pylist()], pa.list_(pa.string()))

    return labelled.select(arrow_udf(known, "array<string>")("tokens").alias("tokens"), "bad")


def by_growth(found: DataFrame, least: float, share: float) -> dict[frozenset[str], tuple[int, int]]:
    """Bad pages and pages of the sets that FP-growth finds."""
    items = cut(found.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0))
    # The share of bad pages that a rule needs is at least that of all, so no other has to leave the executors.
    total = items.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(1, total)), minConfidence=share).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).select("antecedent", "confidence", "support").collect()
    return {frozenset(r["antecedent"]): (r["support"] * total, r["support"] * total / r["confidence"]) for r in rules}


def by_size(found: DataFrame, least: float, share: float) -> dict[frozenset[str], tuple[int, int]]:
    """The same without sets that a smaller one makes needless, however many tokens pages have: one on the same pages, or one
    whose pages are all bad. Such a smaller set is surer or as sure, so no page is left for the larger one. What holds a
    needless set is needless too, so sets grow from the others only, by the tokens of the pages that hold them."""
    out, counts, open_ = {}, {}, None
    while open_ is None or open_:
        shared = found.sparkSession.sparkContext.broadcast(None if open_ is None else Rules(open_))

        def grown(tokens: pa.Array) -> pa.Array:
            rules, rows = shared.value, []
            for row in tokens.to_pylist():
                held = [()] if rules is None else [sorted(rules.sets[i]) for i in rules.of(set(row))]
                rows.append([[*x, t] for x in held for t in row if not x or t > x[-1]])
            return pa.array(rows, pa.list_(pa.list_(pa.string())))

        sets = found.select(F.explode(arrow_udf(grown, "array<array<string>>")("tokens")).alias("x"), "bad")
        often = sets.groupBy("x").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).where(F.col("bad") >= least).collect()
        before, counts = counts, {frozenset(r["x"]): (r["bad"], r["n"]) for r in often}
        # Those whose parts all have more pages; a part that is not there was needless or rare.
        free = {x: c for x, c in counts.items() if len(x) == 1 or all(before.get(x - {t}, (0, 0))[1] > c[1] for t in x)}
        out |= {x: (bad, n) for x, (bad, n) in free.items() if bad >= share * n}
        counts = {x: c for x, c in free.items() if c[0] < c[1]}
        open_ = list(counts)
    return out


def mine(labelled: DataFrame, support: float = SUPPORT, lift: float = LIFT, errors: float = ERRORS) -> Rules:
    """From (page_id, tokens, bad): all labelled pages count, a fifth of them to confirm. Without bad pages there is no rule. All
    sets of tokens that enough bad pages have are weighed."""
    rows = cut(labelled.select(F.coalesce(fold(F.col("page_id")) == CONFIRMS, F.lit(False)).alias("confirms"), "tokens", F.coalesce("bad", F.lit(False)).alias("bad")))
    n, bad = rows.where("NOT confirms").agg(F.count("*"), F.count_if("bad")).first()
    least = max(LEAST_PAGES, support * n)
    if not bad or n < least:
        return Rules([])
    found = cut(telling(rows.where("NOT confirms").select("tokens", "bad"), least))
    most = found.agg(F.max(F.size("tokens"))).first()[0]
    counts = (by_growth if most <= TOKENS else by_size)(found, least, bad / n)
    lows = {x: lower_end(*c, errors) for x, c in counts.items()}
    sure = sorted((x for x, low in lows.items() if low > lift * bad / n), key=lambda x: (-lows[x], len(x), sorted(x)))
    return pruned(upheld(rows, sure, lift, errors))


def upheld(rows: DataFrame, sure: list[frozenset[str]], lift: float, errors: float) -> list[frozenset[str]]:
    """Of rules, the surest first, those that stay sure by the pages that no surer one covers, and that the confirming pages
    among them bear out. Pages of rules that fail count for the next ones."""
    shares = {r["confirms"]: r["bad"] / r["n"] for r in rows.groupBy("confirms").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).collect()}
    for _ in range(ROUNDS):
        if not sure:
            break
        hits = {(r["rule"], r["confirms"]): (r["bad"], r["n"]) for r in rows.select("confirms", "bad", surest(rows, Rules(sure)).alias("rule")).groupBy("rule", "confirms").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).collect()}
        kept = []
        for i, rule in enumerate(sure):
            bad, n = hits.get((i, True), (0, 0))
            if lower_end(*hits.get((i, False), (0, 0)), errors) > lift * shares[False] and bad > lift * shares[True] * n:
                kept.append(rule)
        if len(kept) == len(sure):
            break
        sure = kept
    return sure


def surest(frame: DataFrame, rules: Rules) -> Column:
    """The first rule that holds for the tokens, or null."""
    shared = frame.sparkSession.sparkContext.broadcast(rules)

    def run(tokens: pa.Array) -> pa.Array:
        fits = shared.value
        return pa.array([min(fits.of(set(row)), default=None) for row in tokens.to_pylist()], pa.int32())

    return arrow_udf(run, "int")("tokens")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path and tokens."""
    return pages.select("page_id", "url").withColumns({"host": host_of("url"), "path": path_of("url")}).withColumn("tokens", tokens_of("url", F.col("host"), F.col("path")))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, tokens, bad) of the parsed pages that have a label: low quality or toxic is bad."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    return pages.join(marks, "page_id").select("page_id", "tokens", "bad")


def judge(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, lift: float = LIFT) -> DataFrame:
    """page_id, host, path, rule and verdict of each page.

    A url that is null or has no :// has an empty host and path, fits no rule and is allowed. A page whose label says low
    quality or toxic is bad. Without bad labels nothing is mined and only the fixed rules block. Repeated rows are judged
    alike, and so are rows without an id, from which nothing is learned. Of very long hosts the last DOMAINS domains and the
    whole host are tokens. Only page_id and url are read; an empty table gives an empty result.
    """
    rows = parsed(pages)
    rules = mine(labelled(rows, labels), support, lift)
    judged = rows.withColumn("rule", fixed_rule(F.col("host"), F.col("path"))).withColumn("mined", surest(rows, rules).isNotNull())
    verdict = F.when(F.col("rule").isin(*ALLOW), "allow").when(F.col("rule").isin(*BLOCK), "block").when(F.col("mined"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
