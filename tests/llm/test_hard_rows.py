"""Rows that have broken text operators: words that collide, texts that recurse, forms that run out, names that clash."""

import ipaddress
import re

from pyspark.sql import functions as F

from mediaspan.llm import counts, decontaminate, minhash, pii, substrings
from mediaspan.llm.queries import TOKENIZER

FOLDER = "/root/testdata/sf0.001"


def thue_morse(k):
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


A, B = thue_morse(11)


def test_colliding_words_are_no_hit(spark):
    docs = spark.createDataFrame([(1, f"x {A} y"), (2, f"x {B} y"), (3, A.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(7, A)], "item_id long, text string")
    got = {r.doc_id: [str(i) for i in r["items"]] for r in decontaminate.benchmark_hits(spark, docs, bench).collect()}
    assert got == {1: ["7"], 2: [], 3: ["7"]}


def test_colliding_words_are_no_copies(spark):
    docs = spark.createDataFrame([(1, A), (2, B), (3, A), (4, f"{A} {B}"), (5, f"{B} {A}")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.minhash_groups(spark, docs, shingle=2, percent=80).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_colliding_texts_are_no_repeats(spark):
    docs = spark.createDataFrame([(1, A), (2, B)], "doc_id long, text string")
    seen = set()
    for i, text in ((1, A), (2, B)):
        gone = set()
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                gone |= set(range(p, p + 100))
            seen.add(text[p : p + 100])
        found = substrings.drop_repeated_substrings(spark, docs).where(F.col("doc_id") == i).first()
        assert sum(s["last"] - s["first"] for s in found.removed) == len(gone)


CLASSES = {"dots": "x@" + "a." * 50000 + "com", "labels": "x@" + "a-" * 50000, "digits": "1" * 200000, "blanks": " " * 200000, "letters": "k" * 200000, "capitals": "Mr. " + "A" * 100000, "ats": "a@" * 50000, "octets": "1." * 50000, "groups": "0 12 " * 20000, "secret": "password: " + "q" * 5000, "plus": "+" * 100000, "iban": "DE12 " * 20000}


def test_long_texts_of_one_class_are_searched(spark):
    rows = spark.createDataFrame([(i, CLASSES[kind]) for i, kind in enumerate(CLASSES)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark, rows, "k").collect()}
    for i, kind in enumerate(CLASSES):
        assert got[i] and (kind not in ("dots", "secret") or got[i] != CLASSES[kind]), kind


def test_addresses_with_odd_domains_are_found(spark):
    rows = ["a.b@mail.example.com.", "x@y.com.1", "q@z-1.org, and", "u@v..com"]
    got = [r.text for r in pii.pseudonymise(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for old, new, user in zip(rows, got, ("a.b@", "x@y", "q@z", "u@v"), strict=True):
        assert user not in new, (old, new)


def test_a_private_range_in_full_use_is_mapped_one_to_one(spark):
    values = spark.range(65536).select(F.concat(F.lit("192.168."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("text"), F.col("id").alias("doc_id"))
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark, values, "k").collect()}
    assert len(set(got.values())) == 65536 and all(re.fullmatch(r"192\.168\.\d{1,3}\.\d{1,3}", t) for t in got.values())
    assert not any(got[i] == f"192.168.{i // 256}.{i % 256}" for i in got)
    assert got != {r.doc_id: r.text for r in pii.pseudonymise(spark, values, "other").collect()}


def test_addresses_keep_their_kind_and_stay_apart(spark):
    rows = ["8.8.8.8", "8.8.8.9", "8.8.9.8", "9.8.8.8", "127.0.0.1", "10.1.2.3", "172.31.0.1", "169.254.1.1", "1.2.3.300", "999.999.999.999", "1.2.3.04", "01.2.3.4", "1.2.3.4", "0.0.0.0", "255.255.255.255", "224.0.0.1"]
    got = [r.text for r in pii.pseudonymise(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert len(set(got)) == len(rows) and not any(a == b for a, b in zip(rows, got, strict=True))
    for old, new in zip(rows[:8], got[:8], strict=True):
        assert ipaddress.ip_address(old).is_private == ipaddress.ip_address(new).is_private


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ("score", "lang_pred", "rank", "ids", "at", "map", "bits", "parts", "body", "gone_id", "c0", "key", "spans", "items")
    wide = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, found = stage(spark, docs, FOLDER), stage(spark, wide, FOLDER)
        assert found.columns == wide.columns, name
        assert sorted(found.select("doc_id", "text").collect()) == sorted(plain.select("doc_id", "text").collect()), name
        assert found.where(" or ".join(f"{n} <> 'own {n}'" for n in names)).count() == 0, name
    assert corpus_pipeline.pack(spark, wide, FOLDER).count() == corpus_pipeline.pack(spark, docs, FOLDER).count()


def test_stages_without_counted_characters_and_with_odd_rows(spark):
    import corpus_pipeline

    rows = [(None, None, None), (1, "", "en"), (1, "", "en"), (2, "the same words again and again in this text", "en"), (3, "the same words again and again in this text", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.surrogates(spark, odd, FOLDER).columns == odd.columns
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, FOLDER).collect()} == {None, 1, 2}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), FOLDER).count() == 0, name


def test_of_two_writers_of_a_batch_the_first_counts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, "c", "s", "en")], "doc_id long, text string, source string, lang string")
    first, second = (counts.TokenLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    told = []

    class Late(counts.TokenLedger):
        def _commit(self, batch, attempt):
            told.append(second.apply("a", inserts=counts.count_tokens(docs.limit(1), TOKENIZER)))
            return super()._commit(batch, attempt)

    assert not Late(spark, first.root).apply("a", inserts=counts.count_tokens(docs, TOKENIZER)) and told == [True]
    assert first.totals().first().n_docs == 1
    (tmp_path / "ledger/commits/b").touch()  # a writer that broke off at its mark
    assert "b" not in first.committed() and first.apply("b", inserts=counts.count_tokens(docs, TOKENIZER))
    assert first.totals().first().n_docs == 3 and not first.apply("b")
