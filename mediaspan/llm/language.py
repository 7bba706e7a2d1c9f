"""Language of mixed texts: script ranges, per-word scores and Viterbi with a switching penalty.

A word is a run of letters. Its scripts narrow the candidates to the languages
that were seen to use one of them; a table of letter trigrams (with word ends)
scores it under each. Viterbi then labels the words of the whole text: every
change of language costs `penalty`. The answer is the language with the most
labelled letters' bytes, its share is the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.llm import textbytes as tb

BUCKETS = 1 << 16
#: Bytes of text that are scored at a time; about 60 bytes of memory for each.
SLICE = 1 << 20
#: Bytes of words: ASCII letters and all of non-ASCII.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
#: One bit a script, by first byte of UTF-8: Latin, Greek, Cyrillic, Hebrew, Arabic, Indic, kana, Han, Hangul, others.
_SCRIPT = np.zeros(256, dtype=np.uint16)
for _bit, _ranges in enumerate([[(65, 91), (97, 123), (0xC3, 0xCA)], [(0xCE, 0xD0)], [(0xD0, 0xD5)], [(0xD6, 0xD8)], [(0xD8, 0xDC)], [(0xE0, 0xE1)], [(0xE3, 0xE4)], [(0xE4, 0xEA)], [(0xEA, 0xEE)], [(0xE1, 0xE2), (0xF0, 0xF5)]]):
    for _a, _b in _ranges:
        _SCRIPT[_a:_b] = 1 << _bit
SCRIPTS = 10


def _codes(w: tb.Words, data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around each byte; what isn't of a word counts as its end."""
    b = np.zeros(len(data) + 2, dtype=np.uint32)
    b[1:-1] = np.where(_LETTERS[data], w.lowered, 0)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram and script counts of each language of a task's rows."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            total = counts.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, dtype=np.int64))
            for _, _, data, at in tb.slices(pa.array(rows["text"], pa.string()), SLICE):
                w = tb.words(data, at, _LETTERS)
                total[:BUCKETS] += np.bincount(_codes(w, data)[_LETTERS[data]], minlength=BUCKETS)
                seen = _SCRIPT[data]
                total[BUCKETS:] += [int((seen == 1 << s).sum()) for s in range(SCRIPTS)]
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


class Model:
    """Log-probabilities of trigrams and the scripts of each language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        table = np.zeros((len(self.langs), BUCKETS + SCRIPTS))
        for i, lang in enumerate(self.langs):
            mine = counts[counts["lang"] == lang]
            table[i, mine["bucket"].to_numpy()] = mine["n"].to_numpy()
        grams = table[:, :BUCKETS] + 0.5
        self.scores = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
        self.scores -= self.scores.mean(axis=0)
        scripts = table[:, BUCKETS:]
        used = scripts >= 0.001 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.scripts = (used * (1 << np.arange(SCRIPTS))).sum(axis=1).astype(np.uint16)


def learn(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = 20_000) -> Model | None:
    """A model of the rows with a language and a text; None if there is none.

    train_rows bounds the sample it is fitted on: above it, the rows whose id's
    hash falls in the right share. The model's size is bounded by languages times
    buckets, however large the table.
    """
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    share = max(1, -(-rows.count() // train_rows))
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("text", "lang")
    counts = rows.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return Model(counts) if len(counts) else None


def _viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of each row; all rows advance together, longest first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, begin = sizes[order], first[:-1][order]
    n, k = len(scores), scores.shape[1]
    moved, source = np.zeros((n, k), dtype=bool), np.zeros(n, dtype=np.int64)
    best = np.zeros((len(order), k))
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1 if len(sizes) else 1), side="right")
    for t, m in enumerate(active.tolist()):
        at = begin[:m] + t
        v = best[:m]
        if t:
            top = v.argmax(axis=1)
            level = v[np.arange(m), top] - penalty
            change = v < level[:, None]
            moved[at], source[at] = change, top
            np.maximum(v, level[:, None], out=v)
        v += scores[at]
    labels = np.zeros(n, dtype=np.int64)
    now = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        labels[at] = now[:m]
        now[:m] = np.where(moved[at, now[:m]], source[at], now[:m])
    return labels


def label_words(model: Model, data: np.ndarray, at: np.ndarray, penalty: float) -> tuple[tb.Words, np.ndarray]:
    """The words of the rows of a slice and the index of each one's language."""
    w = tb.words(data, at, _LETTERS)
    code = _codes(w, data)
    scores = np.empty((len(w.start), len(model.langs)))
    for i in range(len(model.langs)):
        sums = np.concatenate([[0.0], np.cumsum(model.scores[i][code], dtype=np.float64)])
        scores[:, i] = sums[w.end] - sums[w.start]
    if len(w.start):
        edges = np.stack([w.start, np.minimum(w.end, len(data) - 1)], axis=1).ravel()
        seen = np.bitwise_or.reduceat(_SCRIPT[data], edges)[::2]
        last = w.end == len(data)
        seen[last] |= _SCRIPT[data[w.end[last] - 1]]
        fits = (seen[:, None] & model.scripts[None, :]) != 0
        scores[~fits & fits.any(axis=1)[:, None]] = -1e3
    return w, _viterbi(scores, w.first, penalty)


def _predict(model_of, text_at: int, names: list[str], penalty: float, spans: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            texts = batch.column(text_at)
            for low, high, data, at in tb.slices(texts, SLICE):
                n = high - low
                langs, shares, found = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                if model is not None:
                    w, labels = label_words(model, data, at, penalty)
                    total = np.zeros((n, len(model.langs)))
                    np.add.at(total, (w.row, labels), w.end - w.start)
                    plain = np.concatenate([[0], np.cumsum(_LETTERS[data] & (data < 128))])[at]
                    for r in np.flatnonzero(np.diff(w.first)).tolist():
                        if plain[r + 1] > plain[r] or any(map(str.isalpha, texts[low + r].as_py())):
                            top = int(total[r].argmax())
                            langs[r], shares[r] = model.langs[top], total[r, top] / total[r].sum()
                            if spans:
                                a, b = int(w.first[r]), int(w.first[r + 1])
                                cut = [a, *(a + 1 + np.flatnonzero(np.diff(labels[a:b]))).tolist(), b]
                                found[r] = [{"first": int(w.start[x] - at[r]), "last": int(w.end[y - 1] - at[r]), "lang": model.langs[labels[x]]} for x, y in zip(cut, cut[1:], strict=False)]
                part = batch.slice(low, n)
                more = [pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())])))] if spans else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs), pa.array(shares), *more], [*names, "lang_pred", "score"] + ["lang_spans"] * spans)

    return run


def identify(spark: SparkSession, documents: DataFrame, model: Model | None, text: str = "text", penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """The documents with lang_pred, score and on demand lang_spans (first byte, last byte + 1, lang).

    A text that is null or has no letter is `und` with score 0 and no spans, as
    is every text when nothing was learned. Repeated rows and all other columns
    stay as they are. Nothing but the text is looked at.
    """
    names = documents.columns
    inner = [f"c{i}" for i in range(len(names))]
    types = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, documents.schema, strict=True))
    schema = f"{types}, lang_pred string, score double" + ", lang_spans array<struct<first:long,last:long,lang:string>>" * spans
    run = _predict(spark.sparkContext.broadcast(model), names.index(text), inner, penalty, spans)
    found = documents.toDF(*inner).mapInArrow(run, schema)
    return found.select(*[F.col(i).alias(n) for i, n in zip(inner, names, strict=True)], *found.columns[len(names) :])


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
