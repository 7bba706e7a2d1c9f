"""Token counts as rollups maintained by signed deltas, in batches that commit once.

A ledger is a folder. A batch writes signed entries (documents and tokens by
document, source, language and tokenizer version), their rollup, and last a
commit mark; without the mark neither counts. Applying a committed batch again
does nothing, one that broke off is written anew, and of two writers of one
batch the first to make the mark counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.llm.tokens import encoder

DIMS = ["source", "lang", "tokenizer"]
_ENTRY = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
_ROLLUP = "source string, lang string, tokenizer string, docs long, tokens long"


def count_tokens(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) of whole texts; a null text has 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(3)
            n = [len(encode(texts[i].as_py() or "")) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokens"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens")


class TokenLedger:
    """Additive totals by source, language and tokenizer version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def committed(self) -> dict[str, str]:
        """Committed batches, each with the attempt that its mark names; an empty mark is of a writer that broke off."""
        fs, p = self._fs(f"{self.root}/commits")
        marks = {s.getPath().getName(): self._attempt(s.getPath()) for s in fs.listStatus(p)} if fs.exists(p) else {}
        return dict(sorted((batch, attempt) for batch, attempt in marks.items() if attempt))

    def _attempt(self, mark) -> str:
        fs, _ = self._fs(self.root)
        stream = fs.open(mark)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, batch: str, attempt: str) -> bool:
        """Make the batch's mark, unless another writer was first."""
        fs, mark = self._fs(f"{self.root}/commits/{batch}")
        if fs.exists(mark) and not self._attempt(mark):
            fs.delete(mark, False)
        try:
            stream = fs.create(mark, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
                return False
            raise
        stream.write(bytearray(attempt.encode()))
        stream.close()
        return True

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{kind}/{batch}/{attempt}" for batch, attempt in self.committed().items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        return self._read("entries", _ENTRY)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens): sums of the batches' rollups, groups that are left empty out."""
        sums = self._read("rollups", _ROLLUP).groupBy(*DIMS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def live(self, ids: DataFrame) -> DataFrame:
        """What the ledger holds of the documents in ids (doc_id), if anything."""
        mine = self.entries().join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return mine.groupBy("doc_id", *DIMS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def apply(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Commit a batch; False if it already was, or another writer was first.

        inserts and revised have the columns of count_tokens, deletes has doc_id.
        A deleted or revised document's live counts are taken back with the
        opposite sign; one that isn't there takes back nothing. Rows without an
        id are ignored, repeated inserts count as often as they occur, repeated
        revisions of one batch too.
        """
        if batch in self.committed():
            return False
        empty = self.spark.createDataFrame([], _ENTRY)
        added = [x.where("doc_id is not null").select("doc_id", *DIMS, F.lit(1).cast("long").alias("docs"), "tokens") for x in (inserts, revised) if x is not None]
        gone = [x.select("doc_id").where("doc_id is not null") for x in (deletes, revised) if x is not None]
        rows = empty
        for part in added:
            rows = rows.unionByName(part)
        for part in gone[:1]:
            ids = part if len(gone) == 1 else part.union(gone[1])
            rows = rows.unionByName(self.live(ids).select("doc_id", *DIMS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/entries/{batch}/{attempt}")
        written = self.spark.read.schema(_ENTRY).parquet(f"{self.root}/entries/{batch}/{attempt}")
        written.groupBy(*DIMS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.root}/rollups/{batch}/{attempt}")
        return self._commit(batch, attempt)
