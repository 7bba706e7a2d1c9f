"""The registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.llm import bpe, counts, decontaminate, embeddings, language, lexical, lines, minhash, packing, pii, substrings, tries, urls
from mediaspan.llm.keyed import by_marks, key_marks
from mediaspan.plans.workspace import Workspace

#: The byte-level vocabulary, read as ranks: the ids are those of byte_bpe_50k.json.
TOKENIZER = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark, _table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    items = F.array_sort(F.array_distinct("items"))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: The secret of op3's surrogates; a deployment passes its own.
SURROGATE_KEY = "mediaspan-demo-key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(spark, docs, SURROGATE_KEY)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_spans(lines.drop_repeated_units(spark, _table(spark, sf_dir, "documents")))


def op4_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines only, and every later one goes, however short."""
    return _with_spans(lines.drop_repeated_units(spark, _table(spark, sf_dir, "documents"), ends=lines.LINES, min_run_words=0))


def _with_spans(found: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
    return found.select("doc_id", "text", "n_units", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed_spans"))


_OP4_SQL = """
with parted as (
    select doc_id, text, string_split(replace(replace(replace(text, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10)) as parts from documents
), units as (
    select doc_id, text, unnest(parts) as unit, generate_subscripts(parts, 1) as pos from parted
), normed as (
    select *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as norm,
        cast(coalesce(sum(length(unit) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as start
    from units
), ranked as (
    select doc_id, pos, greatest(length(norm) - length(replace(norm, ' ', '')) + 1, length(norm) - length(regexp_replace(norm, '[\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]', '', 'g')), length(norm) // 20) as words,
        row_number() over (partition by norm order by doc_id, pos) > 1 as late, row_number() over (partition by doc_id order by pos) as ord
    from normed where length(norm) > 0
), runs as (
    select doc_id, pos, sum(words) over (partition by doc_id, run) as run_words
    from (select *, ord - row_number() over (partition by doc_id order by pos) as run from ranked where late)
), placed as (
    select n.*, coalesce(r.run_words >= 20, false) as gone from normed n left join runs r using (doc_id, pos)
), docs as (
    select doc_id, substr(coalesce(string_agg(case when pos = 1 then ' ' else substr(text, start, 1) end || unit, '' order by pos) filter (where not gone), ''), 2) as text, count(*) as n_units, count(*) filter (where gone) as n_removed,
        coalesce(string_agg(start || '-' || (start + length(unit)), ',' order by pos) filter (where gone), '') as removed_spans
    from placed group by doc_id
)
select d.doc_id, docs.text, cast(coalesce(docs.n_units, 0) as bigint) as n_units, cast(coalesce(docs.n_removed, 0) as bigint) as n_removed, coalesce(docs.removed_spans, '') as removed_spans
from documents d left join docs using (doc_id)
"""


_OP4_ALL_SQL = """
with units as (
    select doc_id, pos, unit, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as norm
    from (select doc_id, unnest(string_split(text, chr(10))) as unit, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
), placed as (
    select *, cast(coalesce(sum(length(unit) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as start,
        length(norm) > 0 and row_number() over (partition by norm order by doc_id, pos) > 1 as gone
    from units
), docs as (
    select doc_id, coalesce(string_agg(unit, chr(10) order by pos) filter (where not gone), '') as text, count(*) as n_units, count(*) filter (where gone) as n_removed,
        coalesce(string_agg(start || '-' || (start + length(unit)), ',' order by pos) filter (where gone), '') as removed_spans
    from placed group by doc_id
)
select d.doc_id, docs.text, cast(coalesce(docs.n_units, 0) as bigint) as n_units, cast(coalesce(docs.n_removed, 0) as bigint) as n_removed, coalesce(docs.removed_spans, '') as removed_spans
from documents d left join docs using (doc_id)
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP2_SQL = f"""
with d as (
    select doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), i as (
    select cast(item_id as varchar) as item, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), windows as (
    select distinct item, 10 as size, array_to_string(w[p : p + 9], ' ') as k from i, unnest(range(1, len(w) - 8)) t(p) where len(w) >= 10
    union all select distinct item, len(w), array_to_string(w, ' ') from i where len(w) between 1 and 9
), sizes as (select distinct size from windows), found as (
    select o.doc_id, o.p, o.size, windows.item
    from (select doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') as k from d, sizes, unnest(range(1, len(w) - size + 2)) t(p)) o join windows on windows.k = o.k and windows.size = o.size
), hit as (
    select doc_id, count(distinct q) as n_hit from (select distinct doc_id, p, size from found), unnest(range(p, p + size)) t(q) group by doc_id
), items as (
    select doc_id, count(distinct item) as n_items, sha256(array_to_string(list_sort(list(distinct item)), ',')) as sha from found group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""
#: Components of a view `linked` (a, b), which holds each link once.
_REACH = "both_ways as (select a, b from linked union all select b, a from linked), reach(x, y) as (select a, a from both_ways union select r.x, e.b from reach r join both_ways e on r.y = e.a), least_of as (select x, min(y) as least from reach group by x)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: cast(p[1] as double) * cast(p[2] as double)))"
_OP9_SQL = f"""
with recursive v as (
    select vec_id, label, embedding as e, sqrt({_DOT.format('embedding', 'embedding')}) as norm from embeddings
    where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), linked as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e)
    where a.norm > 0 and b.norm > 0 and {_DOT.format('a.e', 'b.e')} / (a.norm * b.norm) >= 0.98
), {_REACH}, n as (select a, count(*) as n_links from both_ways group by a)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(least, vec_id) as component_id, coalesce(least, vec_id) = vec_id as kept from embeddings left join n on a = vec_id left join least_of on x = vec_id
"""
_OP10_SQL = f"""
with recursive d as (
    select doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
    select distinct doc_id, array_to_string(w[p : p + 1], ' ') as k from d, unnest(range(1, len(w))) t(p) where len(w) >= 2
    union all select doc_id, w[1] from d where len(w) = 1
), n as (select doc_id, count(*) as n from s group by doc_id), c as (select s.*, n.n from s join n using (doc_id)), linked as (
    select a.doc_id as a, b.doc_id as b from c a join c b on a.k = b.k and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), {_REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least, d.doc_id) as component_id, coalesce(least, d.doc_id) = d.doc_id as kept from d left join n using (doc_id) left join least_of on x = d.doc_id
"""


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeated_substrings(spark, _table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.learn(spark, docs.where("not held_out"))
    return language.identify(spark, docs.select("doc_id", "held_out", "text"), model).drop("text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those of low quality are then deleted, toxic ones revised to a text without digits; the last batch is sent twice."""
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    work = Workspace(spark, "ledger")
    ledger = counts.TokenLedger(spark, work.root)
    ledger.apply("0-load", inserts=counts.count_tokens(docs, TOKENIZER))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    maybe, _ = by_marks(docs, F.col("doc_id"), key_marks(toxic, "doc_id", work, "toxic"))
    changed = maybe.withColumn("text", F.regexp_replace("text", "[0-9]", ""))
    changes = {"deletes": labels.where("quality = 0"), "revised": counts.count_tokens(changed, TOKENIZER).join(toxic, "doc_id", "left_semi")}
    for _ in range(2):
        ledger.apply("1-review", **changes)
    return ledger.totals()


#: Rules of op8: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, _table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark, _table(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(spark, _table(spark, sf_dir, "documents"), shingle=2, percent=80)


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """Sequences whose first turns, by a hash of the id none to three, are those of the conversation at the next lower multiple of 20."""
    own = F.col("conv_id")
    heads = convs.where(own % 20 == 0).select(own.alias("giver"), F.slice("ids", 1, 3).alias("first_ids"), F.slice("words", 1, 3).alias("first_words"))
    shared = (F.crc32(own.cast("string").cast("binary")) % 4).cast("int")
    met = convs.withColumn("giver", own - own % 20).join(heads, "giver", "left").withColumn("h", shared)
    rebuilt = [F.concat(F.coalesce(F.slice(f"first_{c}", F.lit(1), F.col("h")), F.slice(c, 1, 0)), F.slice(c, F.col("h") + 1, F.size(c))).alias(c) for c in ("ids", "words")]
    return met.select("conv_id", *rebuilt)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = with_shared_heads(tries.sequences(tries.turns(_table(spark, sf_dir, "conversations"))))
    return tries.prefix_trie(spark, convs).drop("turn_id")


_OP11_SQL = """
with t as (
    select conv_id, list([coalesce(role, ''), coalesce(text, '')] order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as s
    from conversations where conv_id is not null group by conv_id
), h as (
    select *, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
        lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 4 as h from t
), r as (
    select c.conv_id, list_concat(coalesce(d.s[1 : c.h], []), c.s[c.h + 1 :]) as s from h c left join t d on d.conv_id = c.conv_id - c.conv_id % 20
), p as (
    select conv_id, d, len(s) as size, sha256(to_json(s[1 : d])) as k, sha256(to_json(s[1 : d - 1])) as up, case when d > 0 then len(regexp_extract_all(s[d][2], '[^\x20\x09-\x0D]+')) else 0 end as words
    from r, unnest(range(0, len(s) + 1)) x(d)
), n as (
    select k, d, min(conv_id) as rep, count(*) as n, min(up) as up, min(words) as words, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where size = d), '') as ends from p group by k, d
), kids as (select up, d - 1 as d, count(*) as kids from n where d > 0 group by up, d
), m as (
    select n.*, coalesce(kids, 0) as kids, parent.rep as parent from n left join kids on kids.up = n.k and kids.d = n.d left join n parent on parent.k = n.up and parent.d = n.d - 1 and n.d > 0
), given as (
    select p.k, p.d, sum(case when m.rep = p.conv_id then (m.n - 1) * m.words else 0 end) over w as saved, sum(case when m.rep = p.conv_id and m.kids = 0 then 1 else 0 end) over w as leaves
    from p join m on m.k = p.k and m.d = p.d window w as (partition by p.conv_id order by p.d desc)
), total as (select k, d, sum(saved) as saved, sum(leaves) as leaves from given group by k, d)
select rep as conv_id, m.d as depth, parent as parent_conv_id, n as n_convs, kids as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(ends) as ends_sha256
from m join total on total.k = m.k and total.d = m.d
"""


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_OP12_SQL = f"""
with d as (
    select row_number() over () as r, doc_id, {_TERMS} as w from documents
), total as (select count(*) as docs, cast(sum(len(w)) as bigint) as terms from d where len(w) > 0
), i as (select distinct item_id, unnest({_TERMS}) as term from benchmark
), tf as (
    select r, doc_id, len(w) as n, term, count(*) as tf from (select r, doc_id, w, unnest(w) as term from d) where term in (select term from i) group by r, doc_id, len(w), term
), df as (select term, count(*) as df from tf group by term
), impact as (
    select r, doc_id, term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) as impact
    from tf join df using (term), total
), scored as (
    select item_id, r, doc_id, cast(sum(impact) as bigint) as score from impact join i using (term) group by item_id, r, doc_id
), ranked as (
    select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0
)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10
"""


#: The same vocabulary as its library reads it, with the string of its special token.
LIBRARY_TOKENIZER = "byte_bpe_50k.json"


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), LIBRARY_TOKENIZER), LIBRARY_TOKENIZER)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2_SQL, "op4_lines": _OP4_SQL, "op4_all_lines": _OP4_ALL_SQL, "op9_embeddings": _OP9_SQL, "op10_minhash": _OP10_SQL, "op11_trie": _OP11_SQL, "op12_lexical": _OP12_SQL}
