"""URL filters: longest rule by host and path, else gradient-boosted trees on lexical features. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import materialize

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A part of a host, between dots and hyphens, that is one of these words labels a URL as one to block for
#: training. Gambling, medicine by mail, adult content, advertising and tracking, malware and fraud, piracy, loans.
BLOCKED_WORDS = (
    "casino", "poker", "bet", "bets", "betting", "roulette", "slots", "jackpot", "bingo", "lottery", "pills", "pharmacy", "viagra", "cialis", "adult", "porn",
    "sex", "xxx", "escort", "camgirls", "spam", "ads", "adserver", "banner", "popup", "track", "tracker", "tracking", "clickbait", "malware", "phishing",
    "virus", "scam", "hack", "keygen", "crack", "warez", "torrent", "torrents", "payday", "loans", "replica",
)
#: At most about so many labelled URLs train the trees.
TRAINING_ROWS = 20_000
BINS = 16
TREES = 10
DEPTH = 3
RATE = 0.4
#: A leaf has so many labelled URLs at least.
LEAST_ROWS = 8


def host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule); a null struct if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    out = None
    for verdict, h, p in longest:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    each = F.array_distinct(F.split(text, ""))
    shares = F.transform(F.filter(each, lambda c: c != ""), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of host, path and url as doubles, and the suffix."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return urls.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_labels": count(F.col("host"), r"[^.]+"),
            "f_hyphens": count(F.col("host"), "-"),
            "f_depth": count(F.col("path"), "/[^/]"),
            "f_digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "f_host_digits": count(F.col("host"), "[0-9]"),
            "f_entropy": _entropy(F.col("host")),
            "f_parameters": F.when(query == "", 0.0).otherwise(count(query, "[^&]+")),
            "suffix": F.element_at(F.split("host", r"\."), -1),
        }
    )


FEATURES = ("f_length", "f_host_length", "f_labels", "f_hyphens", "f_depth", "f_digits", "f_host_digits", "f_entropy", "f_parameters", "f_suffix")


class Trees:
    """Boosted trees over binned features: grown from counts on the driver, scored as expressions."""

    def __init__(self, prior: float, cuts: dict[str, list[float]], suffixes: DataFrame | None = None):
        self.prior, self.cuts, self.suffixes = prior, cuts, suffixes
        self.trees: list[dict] = []

    def with_suffix_rate(self, rows: DataFrame) -> DataFrame:
        """Adds f_suffix: the smoothed part of URLs to block among the labelled ones of the suffix; of all for an unknown one."""
        if self.suffixes is None:
            return rows.withColumn("f_suffix", F.lit(self.prior))
        rates = self.suffixes.select(F.col("suffix").alias("__suffix"), "rate")
        met = rows.join(F.broadcast(rates), F.col("suffix") == F.col("__suffix"), "left")  # the sample's suffixes, TRAINING_ROWS at most
        return met.withColumn("f_suffix", F.coalesce("rate", F.lit(self.prior))).drop("__suffix", "rate")

    def bins(self) -> list[Column]:
        """How many cuts are below each feature."""

        def below(name: str) -> Column:
            cuts = self.cuts[name]
            return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(name) > c)) if cuts else F.lit(0)

        return [below(f).alias(f"b{f[1:]}") for f in FEATURES]

    @staticmethod
    def value(node: dict) -> Column:
        if "leaf" in node:
            return F.lit(node["leaf"])
        return F.when(F.col(f"b{FEATURES[node['feature']][1:]}") <= node["bin"], Trees.value(node["low"])).otherwise(Trees.value(node["high"]))

    def margin(self) -> Column:
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for tree in self.trees:
            out = out + self.value(tree)
        return out

    def grow(self, counted: list[tuple[tuple[int, ...], int, int]]) -> "Trees":
        """counted: (bins, label, number of such URLs). Each tree fits the gradients that the former ones leave."""
        counted = sorted(counted)
        margins = [math.log(self.prior / (1 - self.prior))] * len(counted)
        for _ in range(TREES):
            graded = []
            for (bins, label, n), m in zip(counted, margins):
                p = 1 / (1 + math.exp(-m))
                graded.append((bins, n * (label - p), n * p * (1 - p), n))
            tree = node_of(graded, DEPTH)
            self.trees.append(tree)
            margins = [m + leaf_of(tree, bins) for m, (bins, *_) in zip(margins, counted)]
        return self


def leaf_of(node: dict, bins: tuple[int, ...]) -> float:
    while "leaf" not in node:
        node = node["low"] if bins[node["feature"]] <= node["bin"] else node["high"]
    return node["leaf"]


def node_of(rows: list[tuple[tuple[int, ...], float, float, int]], depth: int) -> dict:
    """A leaf, or the split that gains most of rows (bins, gradient, curvature, number); ties go to the first feature and bin."""
    g, h, n = (sum(r[i] for r in rows) for i in (1, 2, 3))
    best = (1e-6, 0, 0)
    for feature in range(len(FEATURES)) if depth else ():
        sums: dict[int, list[float]] = {}
        for bins, a, b, c in rows:
            at = sums.setdefault(bins[feature], [0.0, 0.0, 0])
            at[0] += a
            at[1] += b
            at[2] += c
        a = b = c = 0
        for cut in sorted(sums)[:-1]:
            a, b, c = a + sums[cut][0], b + sums[cut][1], c + sums[cut][2]
            if min(c, n - c) >= LEAST_ROWS:
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                best = max(best, (gain, -feature, -cut))
    if best == (1e-6, 0, 0):
        return {"leaf": RATE * g / (h + 1)}
    feature, cut = -best[1], -best[2]
    low, high = [r for r in rows if r[0][feature] <= cut], [r for r in rows if r[0][feature] > cut]
    return {"feature": feature, "bin": cut, "low": node_of(low, depth - 1), "high": node_of(high, depth - 1)}


def train(labelled: DataFrame) -> Trees:
    """labelled (host, path, url, label 0/1), of bounded size, -> trees.

    Rows are binned and counted by Spark; the driver collects these counts, TRAINING_ROWS at most, and grows the trees. No
    labels, or one kind only, give the prior.
    """
    rows = features(labelled)
    sums = materialize(rows.groupBy("suffix").agg(F.sum("label").alias("y"), F.count("*").alias("n")))
    totals = sums.agg(F.sum("y").alias("y"), F.sum("n").alias("n")).first()
    prior = ((totals.y or 0) + 0.5) / ((totals.n or 0) + 1)
    model = Trees(prior, {}, sums.select("suffix", ((F.col("y") + 20 * prior) / (F.col("n") + 20)).alias("rate")))
    rows = model.with_suffix_rate(rows)
    quantiles = [k / BINS for k in range(1, BINS)]
    cuts = rows.agg(*[F.percentile(f, F.array(*map(F.lit, quantiles))).alias(f) for f in FEATURES]).first()
    model.cuts = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    binned = [f"b{f[1:]}" for f in FEATURES]
    counted = rows.select(*model.bins(), "label").groupBy(*binned, "label").agg(F.count("*").alias("n")).collect()
    return model.grow([(tuple(r[f] for f in binned), r.label, r.n) for r in counted])


def sampled(labelled: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most about ``rows`` of the labelled URLs, chosen by a hash of the url; a repeated url comes with all its rows or none."""
    share = min(1.0, rows / max(1, labelled.count()))
    place = F.pmod(F.xxhash64("url", F.lit(10)), F.lit(1 << 20))
    return labelled.filter(place < int(share * (1 << 20))) if share < 1 else labelled


def word_labels(urls: DataFrame) -> DataFrame:
    """Labels for URLs (url, host, path) with a host: 1 if one of its parts is a word of BLOCKED_WORDS, else 0."""
    parts = F.split("host", r"[.-]")
    blocked = F.arrays_overlap(parts, F.array(*map(F.lit, BLOCKED_WORDS)))
    return urls.filter(F.col("host") != "").select("url", "host", "path", blocked.cast("int").alias("label"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """pages (page_id, url, ...) -> (page_id, host, path, rule, verdict, score), a row per row.

    The longest rule that fits decides; else the trees block from a score of 0.5 on. ``labelled`` (url, label)
    trains them; without it the words of BLOCKED_WORDS label the urls themselves. Either way a bounded sample trains. Labels
    outside 0 and 1 teach nothing. Null urls and
    urls without '://' have no host and no path and are judged by the trees like any other. Repeated rows come
    out repeatedly; an empty table gives none; other columns are ignored.
    """
    urls = pages.select("page_id", "url").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    known = word_labels(urls) if labelled is None else labelled.select("url", F.col("label").cast("int").alias("label"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).filter("label IN (0, 1)")
    model = train(sampled(known))
    seen = model.with_suffix_rate(features(urls)).select("page_id", "host", "path", *model.bins())
    scored = seen.withColumn("score", 1 / (1 + F.exp(-model.margin()))).withColumn("by", matched_rule(F.col("host"), F.col("path"), rules))
    return scored.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
