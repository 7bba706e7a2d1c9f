"""URL verdicts: host and path rules, else gradient-boosted trees on lexical features.

Everything is DataFrame expressions. The trees are trained on the URLs that a
rule decides. Statistics of suffixes and path heads are taken out of fold there:
a URL meets only the counts of hosts of other folds, so no URL's label stands in
its own features. Each tree sees a part of the features, or the suffix, which
the rules name, would be all that is learned. Each level of a tree takes one
aggregation over (node, feature, bin), whose result is bounded, and scoring is
one generated expression.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.plans.workspace import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS, FOLDS = 16, 5
#: Trees between two written tables of scores.
WRITE_AFTER = 4
TREES, DEPTH, RATE, COLUMNS = 24, 3, 0.3, 0.6
FEATURES = ("f_length", "f_host_length", "f_host_labels", "f_hyphens", "f_depth", "f_digit_ratio", "f_entropy", "f_parameters", "f_suffix_rate", "f_suffix_count", "f_head_rate")


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        found = F.when(fits, F.struct(F.lit(at + below).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Features of the URL's characters; null and empty URLs have zeros."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    letters = F.split(text, "")
    per = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    entropy = F.when(n > 0, F.aggregate(per, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)
    count = lambda c, p: F.length(c) - F.length(F.regexp_replace(c, p, ""))
    return df.withColumns(
        {
            "f_length": n.cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_host_labels": count(F.col("host"), r"\.").cast("double"),
            "f_hyphens": count(F.col("host"), "-").cast("double"),
            "f_depth": count(F.col("path"), "/").cast("double"),
            "f_digit_ratio": F.when(n > 0, count(text, "[0-9]") / n).otherwise(0.0),
            "f_entropy": F.round(entropy, 6),
            "f_parameters": F.when(text.contains("?"), 1 + count(F.substring_index(text, "?", -1), "&")).otherwise(0).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "head": F.regexp_extract("path", "^/([^/]*)", 1),
            "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"),
        }
    )


def _bins(cuts: dict[str, list[float]]) -> Column:
    return F.array(*[reduce(lambda a, c: a + (F.col(f) > c).cast("int"), cuts[f], F.lit(0)) for f in FEATURES])


@dataclass
class Tree:
    """Nodes are numbered as in a heap from 1; splits: node to (feature, bin), leaves: node to value."""

    splits: dict[int, tuple[int, int]]
    leaves: dict[int, float]

    def _at(self, node: int, leaf) -> Column:
        if node not in self.splits:
            return leaf(node)
        f, b = self.splits[node]
        return F.when(F.col("bins")[f] <= b, self._at(2 * node, leaf)).otherwise(self._at(2 * node + 1, leaf))

    def node(self) -> Column:
        return self._at(1, F.lit)

    def value(self) -> Column:
        return self._at(1, lambda n: F.lit(self.leaves[n]))


def _best_split(sums: dict[tuple[int, int], tuple[float, float]], features: list[int]) -> tuple | None:
    """(feature, bin, left g and h, right g and h) of the greatest gain, from sums of (g, h) by (feature, bin)."""
    all_g, all_h = (sum(v[k] for (f, _), v in sums.items() if f == features[0]) for k in (0, 1))
    best, most = None, 1e-6
    for f in features:
        g = h = 0.0
        for b in sorted(b for x, b in sums if x == f):
            g, h = g + sums[f, b][0], h + sums[f, b][1]
            gain = g * g / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
            if gain > most and h > 1e-6 and all_h - h > 1e-6:
                best, most = (f, b, (g, h), (all_g - g, all_h - h)), gain
    return best


def boost(rows: DataFrame, work: Workspace, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, columns: float = COLUMNS) -> tuple[float, list[Tree]]:
    """(first score, trees) for logistic loss; rows: distinct bins with n rows, y of which are positive.

    Tree number t looks at a share of the features, drawn by random.Random(t).
    rows are those of a bounded sample: they lie in one partition, so a level is
    one task without a shuffle. Their scores are written after every WRITE_AFTER
    trees, so no plan grows.
    """
    n, positive = rows.agg(F.sum("n"), F.sum("y")).first()
    share = min(max((positive or 0) / max(n or 0, 1), 1e-3), 1 - 1e-3)
    start, found = math.log(share / (1 - share)), []
    scored = work.table(rows.select("bins", "n", "y", F.lit(start).alias("s")), "scores-0")
    for t in range(trees if n else 0):
        seen = sorted(random.Random(t).sample(range(len(FEATURES)), max(1, round(columns * len(FEATURES)))))
        p = 1 / (1 + F.exp(-F.col("s")))
        graded = scored.coalesce(1).select("bins", (F.col("n") * p - F.col("y")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        tree, open_nodes = Tree({}, {}), [1]
        for _ in range(depth):
            # One job a level: every row goes to its node, and the sums are at most nodes x features x bins.
            level = graded.select(tree.node().alias("node"), F.posexplode("bins").alias("f", "b"), "g", "h").where(F.col("node").isin(open_nodes) & F.col("f").isin(seen))
            sums: dict[int, dict] = {}
            for r in level.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r["node"], {})[r["f"], r["b"]] = (r["g"], r["h"])
            if 1 in sums:
                tree.leaves[1] = -rate * sum(v[0] for (f, _), v in sums[1].items() if f == seen[0]) / (sum(v[1] for (f, _), v in sums[1].items() if f == seen[0]) + 1)
            parents, open_nodes = open_nodes, []
            for node in parents:
                if best := _best_split(sums.get(node, {}), seen):
                    tree.splits[node] = best[:2]
                    for child, (g, h) in ((2 * node, best[2]), (2 * node + 1, best[3])):
                        tree.leaves[child] = -rate * g / (h + 1)
                        open_nodes.append(child)
            if not open_nodes:
                break
        found.append(tree)
        scored = scored.withColumn("s", F.col("s") + tree.value())
        if (t + 1) % WRITE_AFTER == 0:
            scored = work.table(scored.coalesce(1), f"scores-{t + 1}")
            work.drop(f"scores-{t + 1 - WRITE_AFTER}")
    return start, found


def _score(start: float, trees: list[Tree]) -> Column:
    return reduce(lambda a, t: a + t.value(), trees, F.lit(start))


@dataclass
class UrlModel:
    """Cut points, trees, and the written statistics of suffixes and heads; None of them if nothing was labelled."""

    cuts: dict[str, list[float]]
    start: float
    trees: list[Tree]
    stats: dict[str, DataFrame]

    def scored(self, rows: DataFrame, url: str) -> DataFrame:
        """rows with host and path, and block_score by the statistics of all folds."""
        filled = _filled(lexical(rows, url), self.stats, None)
        return filled.withColumn("bins", _bins(self.cuts)).withColumn("block_score", 1 / (1 + F.exp(-_score(self.start, self.trees))))


def _filled(rows: DataFrame, stats: dict[str, DataFrame], fold: str | None) -> DataFrame:
    """rows with the rates of their suffix and head and the count of the suffix, without the counts of the row's fold if one is named."""
    for key, table in stats.items():
        one = table.select(key, "bad", "n", "by_fold")
        mine = F.try_element_at("by_fold", F.col(fold)) if fold else F.lit(None).cast("struct<bad:long,n:long>")
        bad = F.coalesce(F.col("bad") - F.coalesce(mine["bad"], F.lit(0)), F.lit(0))
        n = F.coalesce(F.col("n") - F.coalesce(mine["n"], F.lit(0)), F.lit(0))
        rows = rows.join(one, key, "left").withColumns({f"f_{key}_rate": (bad + 1) / (n + 2), f"f_{key}_count": F.log1p(n)}).drop("bad", "n", "by_fold")
    return rows


def learn(spark: SparkSession, known: DataFrame, train_rows: int = 20_000, trees: int = TREES) -> UrlModel | None:
    """A model of labelled URLs (url, host, path, y); None if there are none.

    Statistics count all of them; trees are fitted on at most about train_rows,
    a share taken by the hash of the URL.
    """
    work = Workspace(spark, "urls")
    slim = work.table(lexical(known.select("url", "host", "path", "y")).drop("host", "path"), "known")
    n = slim.count()
    if not n:
        return None
    stats = {}
    for key in ("suffix", "head"):
        # A third of all URLs may share a key: counts combine before the shuffle.
        folds = slim.groupBy(key, "fold").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
        each = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("bad", "n"))))
        stats[key] = work.table(folds.groupBy(key).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), each.alias("by_fold")), key)
    share = max(1, -(-n // train_rows))
    sample = slim.where(F.pmod(F.xxhash64("url"), F.lit(share)) == 0)
    train = work.table(_filled(sample, stats, "fold").select("y", *FEATURES), "train")
    steps = [i / BINS for i in range(1, BINS)]
    cuts = {f: sorted(set(q)) for f, q in zip(FEATURES, train.approxQuantile(list(FEATURES), steps, 0.001), strict=True)}
    rows = train.select("y", _bins(cuts).alias("bins")).groupBy("bins").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    start, found = boost(rows.coalesce(2), work, trees)
    return UrlModel(cuts, start, found, stats)


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", train_rows: int = 20_000, trees: int = TREES) -> DataFrame:
    """The pages with host, path, rule, verdict (allow or block) and block_score.

    With no URL that a rule decides the verdict is allow and the score 0. A null
    or empty URL or one without :// has empty host and path, so no rule;
    repeated rows and long URLs count like any other. All other columns stay as
    they are, whatever their names; columns named host, path, rule, verdict or
    block_score are replaced.
    """
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "block_score")]
    # The input's columns travel in one struct, so that none can meet a feature of its name.
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(url).alias("url"))
    ruled = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    known = ruled.where("best is not null").select("url", "host", "path", (F.col("best.verdict") == "block").cast("int").alias("y"))
    model = learn(spark, known, train_rows, trees)
    scored = ruled.withColumn("block_score", F.lit(0.0)) if model is None else model.scored(ruled, "url")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("row.*", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "block_score")
