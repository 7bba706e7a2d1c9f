"""Similarity search by cosine: thresholds, bands, floors, fallbacks and top-k."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query, register

PREFILTER = 0.16
# Score bands, in hundredths.
BANDS = (18, 22, 28, 34, 40)
#: No search returns more rows.
MOST = 200
QUERY_BLOCK, ROW_BLOCK = 256, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is zero or the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


# Caps, floors and factors by strictness.
def text_limit(threshold: float, limit: int = 0) -> int:
    """Rows of a text search: fewer the stricter it is, never above 200 or the user's limit."""
    cap = 30 if threshold >= 0.27 else 40 if threshold >= 0.23 else 50 if threshold >= 0.19 else 200
    return max(1, min(cap, limit or cap, 200))


def image_limit(threshold: float, limit: int = 0) -> int:
    cap = 12 if threshold >= 0.27 else 24 if threshold >= 0.23 else 40 if threshold >= 0.19 else 100
    return max(1, min(cap, limit or cap, 200))


def text_floor(threshold: float) -> float:
    return max(PREFILTER, threshold * 0.85) if threshold > 0 else 0.20


def queries_of(lib: Library) -> DataFrame:
    """The stated queries of the vector searches: every vector whose id is divisible by 20."""
    return lib.embeds.where("(file_id - 1) % 20 = 0")


def _blocks(queries: DataFrame, rows: DataFrame, run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """run on every block of queries with every block of rows: the rows' ids and a matrix of cosines, a query a line.

    A query's own row, null vectors and those of another length score below any
    floor. A group holds about QUERY_BLOCK + ROW_BLOCK vectors at any size.
    """
    q_blocks, r_blocks = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (rows, ROW_BLOCK)))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64("file_id"), F.lit(n)).cast("int").alias(own)
        return df.where("embedding is not null").select(F.col("file_id").alias("file_id"), F.col("embedding").alias("embedding"), block, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        scores = np.full((len(q), len(r)), -2.0)
        q_size, r_size = (df.embedding.map(len).to_numpy() if len(df) else np.zeros(0, int) for df in (q, r))
        for size in set(q_size.tolist()) & set(r_size.tolist()):
            i, j = np.flatnonzero(q_size == size), np.flatnonzero(r_size == size)
            x, y = (np.stack(df.embedding.to_numpy()[k]).astype(np.float64).reshape(len(k), size) for df, k in ((q, i), (r, j)))
            norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
            scores[np.ix_(i, j)] = np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=norms > 0)
        scores[q.file_id.to_numpy()[:, None] == r.file_id.to_numpy()[None, :]] = -2.0
        return run(q.file_id.to_numpy(), r.file_id.to_numpy(), scores)

    left, right = dealt(queries, "qb", q_blocks, "rb", r_blocks), dealt(rows, "rb", r_blocks, "qb", q_blocks)
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, schema)


def ranked(queries: DataFrame, rows: DataFrame, prefilter: float = PREFILTER, most: int = MOST) -> DataFrame:
    """(query_id, file_id, score, rank, top): for every query the best rows above the prefilter, at most `most`."""

    def best(q: np.ndarray, r: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        order = np.argsort(r, kind="stable")
        r, scores = r[order], scores[:, order]
        place = np.argsort(-scores, axis=1, kind="stable")[:, :most]
        line = np.repeat(np.arange(len(q)), place.shape[1])
        found = pd.DataFrame({"query_id": q[line], "file_id": r[place.ravel()], "score": scores[line, place.ravel()]})
        return found[found.score >= prefilter]

    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id")
    found = _blocks(queries, rows, best, "query_id long, file_id long, score double")
    return found.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= most).withColumn("top", F.max("score").over(Window.partitionBy("query_id")))


def search(found: DataFrame, threshold: float, limit: int = 0) -> DataFrame:
    """Rows above the floor; if none, above 0.85 of the best. Best first, at most k a query."""
    floor = text_floor(threshold)
    edge = F.when(F.col("top") >= floor, F.lit(floor)).otherwise(F.col("top") * 0.85)
    return found.where((F.col("score") >= edge) & (F.col("rank") <= text_limit(threshold, limit))).select("query_id", "file_id", "score", "rank")


def image_search(found: DataFrame, threshold: float) -> DataFrame:
    """Image mode: an absolute floor by strictness, else 0.92 of the best but not far below the floor, else all."""
    floor = 0.88 if threshold >= 0.27 else 0.82 if threshold >= 0.23 else 0.74 if threshold >= 0.19 else 0.62
    near = F.greatest(F.col("top") * 0.92, F.lit(floor * 0.9))
    edge = F.when(F.col("top") >= floor, F.lit(floor)).when(F.col("top") >= near, near).otherwise(F.lit(-1.0))
    return found.where((F.col("score") >= edge) & (F.col("rank") <= image_limit(threshold))).select("query_id", "file_id", "score", "rank")


_COS = "list_sum(list_transform(list_zip({0}, {1}), lambda p: cast(p[1] as double) * cast(p[2] as double)))"
_SCORES = f""", q as (select file_id query_id, embedding e from v_embeds where (file_id - 1) % 20 = 0), s as (select query_id, file_id, {_COS.format('embedding', 'e')} / (sqrt({_COS.format('embedding', 'embedding')}) * sqrt({_COS.format('e', 'e')})) score from v_embeds, q where file_id <> query_id),
k as (select *, row_number() over (partition by query_id order by score desc, file_id) as rank, max(score) over (partition by query_id) as top from s where score >= {PREFILTER}) """


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "file_id", F.round("score", 6).alias("score"))


register("V3_V4_scores", lambda lib: _shown(ranked(queries_of(lib), lib.embeds)), _SCORES + f"select query_id, file_id, round(score, 6) score from k where rank <= {MOST}")


@query("A23_A24_score_bands", _SCORES + "select query_id, " + ", ".join(f"count(*) filter (where score > {b / 100}) b{b}" for b in BANDS) + ", round(max(score), 6) top from s group by query_id")
def bands(lib: Library) -> DataFrame:
    """Rows above each band for every query, counted in the blocks and then summed."""
    names = [f"b{b}" for b in BANDS]

    def count(q: np.ndarray, r: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        counts = {name: (scores > b / 100).sum(axis=1) for name, b in zip(names, BANDS, strict=True)}
        return pd.DataFrame({"query_id": q, **counts, "top": scores.max(axis=1, initial=-2.0)})

    parts = _blocks(queries_of(lib), lib.embeds, count, f"query_id long, {', '.join(f'{n} long' for n in names)}, top double")
    return parts.groupBy("query_id").agg(*[F.sum(n).alias(n) for n in names], F.round(F.max("top"), 6).alias("top"))


for _threshold in (0.19, 0.27, 0.9):
    _floor = text_floor(_threshold)
    register(
        f"V5_V7_O4_text_search_{int(_threshold * 100)}",
        lambda lib, t=_threshold: _shown(search(ranked(queries_of(lib), lib.embeds), t)),
        _SCORES + f"select query_id, file_id, round(score, 6) score from k where score >= case when top >= {_floor} then {_floor} else top * 0.85 end and rank <= {text_limit(_threshold)}",
    )
register("V6_O5_X20_image_search", lambda lib: _shown(image_search(ranked(queries_of(lib), lib.embeds), 0.19)), _SCORES + "select query_id, file_id, round(score, 6) score from k where score >= case when top >= 0.74 then 0.74 when top >= greatest(top * 0.92, 0.74 * 0.9) then greatest(top * 0.92, 0.74 * 0.9) else -1 end and rank <= 40")


@query("V8_hydrate", _SCORES + "select query_id, rank, file_id, name from k join v_files on id = file_id where score >= 0.2 and rank <= 30")
def hydrate(lib: Library) -> DataFrame:
    """Rank the ids first, then fetch their rows."""
    best = ranked(queries_of(lib), lib.embeds).where("score >= 0.2 and rank <= 30").select("query_id", "file_id", F.col("rank").cast("long"))
    return lib.files.select(F.col("id").alias("file_id"), "name").join(best, "file_id").select("query_id", "rank", "file_id", "name")


@query("V1_V2_scoped_search", _SCORES.replace("from v_embeds, q where", "from v_embeds join v_shown b on b.id = file_id and b.file_type = 1, q where") + f"select query_id, file_id, round(score, 6) score from k where score >= case when top >= 0.2 then 0.2 else top * 0.85 end and rank <= {MOST}")
def scoped_search(lib: Library) -> DataFrame:
    """Queries by stored vectors, candidates that are images in shown folders; live companions stay candidates."""
    scope = lib.shown(lib.base).where("file_type = 1").select(F.col("id").alias("file_id"))
    return _shown(search(ranked(queries_of(lib), lib.embeds.join(scope, "file_id", "left_semi")), 0.0))


@query("A27_threshold_percentiles", _SCORES + "select " + ", ".join(f"round(quantile_cont(score, {p / 100}), 5) p{p}" for p in (20, 40, 60, 80)) + ", round(avg(score), 5) mean, round(max(score), 5) peak from k where rank <= 200")
def calibration(lib: Library) -> DataFrame:
    """Interpolated percentiles of the scores that the searches return, from which thresholds are set."""
    found = ranked(queries_of(lib), lib.embeds)
    return found.agg(*[F.round(F.percentile("score", p / 100), 5).alias(f"p{p}") for p in (20, 40, 60, 80)], F.round(F.avg("score"), 5).alias("mean"), F.round(F.max("score"), 5).alias("peak"))


register("X10_l2_normalise", lambda lib: lib.embeds.select("file_id", F.round(dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2")), f"select file_id, round({_COS.format('embedding', 'embedding')}, 4) norm2 from v_embeds")
