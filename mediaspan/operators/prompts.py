"""The prompt that a picture was generated by, from the text chunks of its file.

Five formats in order of preference: a block of parameters, a comment, the
metadata of one tool, a plain prompt, and a graph of nodes. The first four are
expressions over a map of chunks. A graph of nodes is JSON of any depth: its
objects and arrays are opened level by level, all files at once, until none is
left, so no function recurses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.plans.catalog import LOWER, UPPER, Library
from mediaspan.plans.registry import query
from mediaspan.plans.workspace import Workspace

# Keys of chunks and of fields in the order they are tried, marks of the formats, lengths.
COMMENT_KEYS = ("Comment", "comment", "Description", "description")
METADATA_KEYS = ("invokeai_metadata", "sd-metadata", "invokeai_graph")
PROMPT_KEYS = ("prompt", "Prompt", "positive_prompt", "Positive Prompt")
GRAPH_KEYS = ("workflow", "Workflow", "prompt", "Prompt")
FIELDS = ("prompt", "positive_prompt", "positivePrompt", "Positive Prompt", "caption", "text")
NODE_FIELDS = ("text", "prompt", "positive", "positive_prompt")
NEGATIVE, STEPS = "negative prompt:", "\nsteps:"
MARKS = (NEGATIVE, STEPS, "\nsampler:", "cfg scale:")
LEAST, LEAST_PLAIN, MOST, DEEPEST = 8, 24, 4000, 128


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _filled(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def _string_at(v: Column, path: str) -> Column:
    """The string at a path of a variant; null if there is none or something else."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))


def looks_like_prompt(text: Column) -> Column:
    """Of eight bytes and more, with a comma, a colon, a word of praise or four words."""
    t = stripped(text)
    told = t.contains(",") | t.contains(":") | t.contains("masterpiece") | t.contains("best quality") | (F.regexp_count(t, F.lit(r"(?U)\S+")) >= 4)
    return (F.octet_length(t) >= LEAST) & told


def any_case(chunks: Column, key: str) -> Column:
    """The chunk of a key, else of the first key that differs in case only."""
    near = F.map_filter(chunks, lambda k, _: F.translate(k, UPPER, LOWER) == key.translate(str.maketrans(UPPER, LOWER)))
    return F.coalesce(F.try_element_at(chunks, F.lit(key)), F.try_element_at(near, F.array_min(F.map_keys(near))))


def of_parameters(raw: Column) -> Column:
    """What stands before the negative prompt, or else before the steps."""
    text = stripped(raw)
    low = F.translate(text, UPPER, LOWER)
    before = lambda mark: stripped(F.substring(text, F.lit(1), F.instr(low, mark) - 1))
    positive = F.when(low.contains(NEGATIVE), before(NEGATIVE)).when(low.contains(STEPS), before(STEPS)).otherwise(text)
    marked = reduce(Column.__or__, (low.contains(m) for m in MARKS)) | low.startswith("steps:")
    graph = positive.startswith("{") & positive.contains('"class_type"')
    return F.when((positive != "") & ~graph & (marked | looks_like_prompt(positive)), positive)


def of_fields(raw: Column) -> Column:
    """The first field of a JSON object that is a string and not blank, or the prompt of its image."""
    v = F.try_parse_json(stripped(raw))
    return F.coalesce(*[_filled(_string_at(v, f"$['{f}']")) for f in FIELDS], _filled(_string_at(v, "$.image.prompt")))


def of_comment(raw: Column) -> Column:
    plain = F.when(looks_like_prompt(raw), stripped(raw))
    return F.coalesce(F.when(stripped(raw).startswith("{"), of_fields(raw)), plain)


def of_plain_prompt(raw: Column) -> Column:
    text = _filled(raw)
    return F.coalesce(of_fields(raw), F.when(~text.startswith("{"), text))


def of_chunks(chunks: Column) -> Column:
    """The prompt by all formats but the graph of nodes."""
    chunk = lambda k: F.try_element_at(chunks, F.lit(k))
    return F.coalesce(
        of_parameters(any_case(chunks, "parameters")),
        *[of_comment(chunk(k)) for k in COMMENT_KEYS],
        *[of_fields(any_case(chunks, k)) for k in METADATA_KEYS],
        *[of_plain_prompt(chunk(k)) for k in PROMPT_KEYS],
    )


def cut_off(text: Column) -> Column:
    return F.when(F.length(text) > MOST, F.concat(F.substring(text, 1, MOST - 1), F.lit("…"))).otherwise(text)


def of_graphs(graphs: DataFrame, work: Workspace) -> DataFrame:
    """(file_id, n, prompt) of graphs (file_id, n, json): the two longest texts of text nodes.

    A text counts if it is the input of a node that encodes text, or of 24
    characters and more; texts under eight are labels. Of equal length the one
    that comes first in the order of keys stands first. What is no JSON, or is
    nested more than DEEPEST deep, has no prompt.
    """
    opened = F.try_parse_json(stripped(F.col("json")))
    kind = graphs.where(F.substring(stripped(F.col("json")), 1, 1).isin("{", "["))
    level = work.table(kind.select("file_id", "n", F.array().cast("array<string>").alias("path"), opened.alias("v")).where("v is not null"), "level-0")
    found, depth = [], 0
    while level.limit(1).count():
        v = F.col("v")
        node = F.coalesce(_string_at(v, "$.class_type"), F.lit(""))
        encodes = node.contains("CLIPText") | node.contains("TextEncode")
        given = _filled(_string_at(v, "$.inputs.text"))
        own = [F.when(encodes | (F.length(given) >= LEAST_PLAIN), given)]
        own += [F.when(F.length(t) >= LEAST_PLAIN, t) for t in (stripped(_string_at(v, f"$.{k}")) for k in NODE_FIELDS)]
        texts = F.filter(F.array(*[F.struct(F.concat("path", F.array(F.lit(f"0{i}"))).alias("path"), t.alias("text")) for i, t in enumerate(own)]), lambda x: F.length(x["text"]) >= LEAST)
        found.append(work.table(level.select("file_id", "n", F.explode(texts).alias("t")).select("file_id", "n", "t.*"), f"texts-{depth}"))
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        items = F.try_variant_get(v, "$", "array<variant>")
        named = F.transform(F.map_entries(fields), lambda e: F.struct(F.concat(F.lit("1"), e["key"]).alias("k"), e["value"].alias("v")))
        placed = F.transform(items, lambda x, i: F.struct(F.concat(F.lit("1"), F.lpad(i.cast("string"), 10, "0")).alias("k"), x.alias("v")))
        inner = level.select("file_id", "n", "path", F.explode(F.coalesce(named, placed)).alias("e")).select("file_id", "n", F.concat("path", F.array("e.k")).alias("path"), F.col("e.v").alias("v"))
        depth += 1
        level = work.table(inner.where(F.schema_of_variant("v").rlike("^(?:OBJECT|ARRAY)")), f"level-{depth}")
        if depth == DEEPEST:
            too_deep = level.select("file_id", "n").distinct()
            found = [f.join(too_deep, ["file_id", "n"], "left_anti") for f in found]
            break
    if not found:
        return graphs.select("file_id", "n", F.col("json").alias("prompt")).limit(0)
    every = reduce(DataFrame.unionByName, found)
    order = F.array_sort(F.collect_list(F.struct((-F.length("text")).alias("less"), "path", "text")))
    best = F.slice(F.array_distinct(F.transform(order, lambda x: x["text"])), 1, 2)
    return every.groupBy("file_id", "n").agg(F.array_join(best, "\n---\n").alias("prompt"))


def prompts(chunks: DataFrame, work: Workspace) -> DataFrame:
    """(file_id, prompt) of every file in chunks (file_id, chunks: map of strings), null where there is none.

    Files are taken to be unique. Null maps and values are as absent.
    """
    m = F.map_filter("chunks", lambda _, v: v.isNotNull())
    told = work.table(chunks.select("file_id", m.alias("chunks"), of_chunks(m).alias("prompt")), "told")
    kept = F.array(*[F.struct(F.lit(i).alias("n"), F.try_element_at("chunks", F.lit(k)).alias("json")) for i, k in enumerate(GRAPH_KEYS)])
    graphs = told.where("prompt is null and chunks is not null").select("file_id", F.explode(kept).alias("g")).select("file_id", "g.*").where("json is not null")
    drawn = of_graphs(graphs, work).groupBy("file_id").agg(F.min_by("prompt", "n").alias("drawn"))
    return told.join(drawn, "file_id", "left").select("file_id", cut_off(F.coalesce("prompt", "drawn")).alias("prompt"))


def made_chunks(lib: Library) -> DataFrame:
    """Every document as the text of one format, by its id."""
    m = F.col("doc_id") % 8
    text = F.concat(F.lit("scene of "), F.coalesce("text", F.lit("")))
    one = lambda key, value: F.create_map(F.lit(key), value)
    node = lambda kind, t, link: F.struct(F.lit(kind).alias("class_type"), F.struct(t.alias("text"), F.array(F.lit(link), F.lit("0")).alias("clip")).alias("inputs"))
    graph = F.to_json(F.struct(node("CLIPTextEncode", text, "4").alias("3"), node("CLIPTextEncodeSDXL", F.lit("blurry, low quality"), "4").alias("6"), F.struct(F.lit("short").alias("text"), F.lit(7).alias("prompt")).alias("9")))
    deep = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(node("Note", text, "1")).alias("list")).alias("inner"))).alias("nodes")))
    made = (
        F.when(m == 0, one("parameters", F.concat(F.lit(" \n"), text, F.lit("\nNegative prompt: bad hands\nSteps: 20"))))
        .when(m == 1, one("Comment", F.to_json(F.struct(F.lit(28).alias("steps"), F.lit("  ").alias("prompt"), text.alias("caption")))))
        .when(m == 2, one("SD-Metadata", F.to_json(F.struct(F.struct(text.alias("prompt")).alias("image"), F.lit(5).alias("prompt")))))
        .when(m == 3, one("Positive Prompt", F.concat(text, F.lit(" \n"))))
        .when(m == 4, one("workflow", graph))
        .when(m == 5, one("PARAMETERS", F.concat(text, F.lit("\nSteps: 9, Sampler: x"))))
        .when(m == 6, F.create_map(F.lit("Software"), text, F.lit("Description"), F.lit("DSC_0001")))
        .otherwise(F.create_map(F.lit("prompt"), deep, F.lit("Comment"), F.lit(" ")))
    )
    return lib.table("documents").select(F.col("doc_id").alias("file_id"), made.alias("chunks"))


_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(
    "X29_prompts",
    f""", t as (select doc_id, {_TRIM.format("'scene of ' || coalesce(text, '')")} s from documents),
    p as (select doc_id, case when doc_id % 8 = 6 then null when doc_id % 8 = 7 and length(s) < 24 then null
        when doc_id % 8 = 4 then case when length(s) < 8 then 'blurry, low quality' when length(s) >= 19 then s || chr(10) || '---' || chr(10) || 'blurry, low quality' else 'blurry, low quality' || chr(10) || '---' || chr(10) || s end
        else s end p from t)
    select doc_id file_id, case when length(p) > 4000 then substr(p, 1, 3999) || '…' else p end prompt from p""",
)
def found_prompts(lib: Library) -> DataFrame:
    """Prompts read back from texts of every format."""
    return prompts(made_chunks(lib), Workspace(lib.spark, "prompts"))
