"""Queries of dynamic sets (rule lists)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaspan.operators.library import count_and_size, ordering
from mediaspan.plans import rules
from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import register

NOW = 915148800  # 1999-01-01, so that results do not depend on the day
_DAY = "cast(make_timestamp({0} * 1000000) as date)"


def _rule(field: str, operator: str, value=None) -> dict:
    return {"field": field, "operator": operator, "value": value}


_TAG = "id {1} (select file_id from v_file_tags where tag_id = {0})"
# (query, rules, match, the same condition over v_visible)
RULES = [
    ("R1_name_contains", [_rule("name", "contains", "IMG_1")], "all", "lower(name) like '%img_1%'"),
    ("R1_name_not_contains", [_rule("name", "not_contains", "1")], "all", "lower(name) not like '%1%'"),
    ("R1_name_is", [_rule("name", "is", "img_0.JPG")], "all", "lower(name) = 'img_0.jpg'"),
    ("R2_favorite", [_rule("favorite", "is", True)], "all", "coalesce(is_favorite, false)"),
    ("R2_not_favorite", [_rule("favorite", "is", False)], "all", "not coalesce(is_favorite, false)"),
    ("R3_rating_gte", [_rule("rating", "gte", 3)], "all", "rating >= 3"),
    ("R3_rating_empty", [_rule("rating", "empty")], "all", "coalesce(rating, 0) = 0"),
    ("R4_file_type_not", [_rule("file_type", "is_not", 2)], "all", "file_type <> 2"),
    ("R5_extension", [_rule("extension", "is", ".PNG")], "all", "lower(name) like '%.png'"),
    ("R6_size_gt", [_rule("size", "gt", "20")], "all", "size > 20000000"),
    ("R7_orientation", [_rule("orientation", "is", "portrait")], "all", "width < height"),
    ("R8_tag_has", [_rule("tag", "has", 12)], "all", _TAG.format(12, "in")),
    ("R8_tag_not_has", [_rule("tag", "not_has", 12)], "all", _TAG.format(12, "not in")),
    ("R8_tag_empty", [_rule("tag", "empty")], "all", "id not in (select file_id from v_file_tags)"),
    ("R8_two_tags", [_rule("tag", "has", 12), _rule("tag", "has", 23)], "all", _TAG.format(12, "in") + " and " + _TAG.format(23, "in")),
    ("R9_person_has", [_rule("person", "has", 3)], "all", "id in (select file_id from v_faces where person_id = 3)"),
    ("R9_person_empty", [_rule("person", "empty")], "all", "id not in (select file_id from v_faces where person_id is not null)"),
    ("R10_taken_between", [_rule("date_taken", "between", {"start": 788918400, "end": 820454400})], "all", f"{_DAY.format('taken_date')} >= date '1995-01-01' and {_DAY.format('taken_date')} < date '1996-01-01'"),
    ("R10_created_before", [_rule("date_created", "before", 820454400)], "all", f"{_DAY.format('created_at')} < date '1996-01-01'"),
    ("R10_modified_in_last", [_rule("date_modified", "in_last", {"amount": 12, "unit": "month"})], "all", f"modified_at >= {NOW - 12 * 30 * 86400}"),
    ("R10_taken_older", [_rule("date_taken", "older_than", {"amount": 2, "unit": "year"})], "all", f"taken_date < {NOW - 2 * 365 * 86400}"),
    ("R10_taken_empty", [_rule("date_taken", "empty")], "all", "coalesce(taken_date, 0) = 0"),
    ("R11_no_gps", [_rule("has_gps", "is", False)], "all", "gps_latitude is null or gps_longitude is null"),
    ("R12_camera", [_rule("camera", "is", "canon||M3")], "all", "upper(e_make) = 'CANON' and e_model = 'M3'"),
    ("R12_camera_not", [_rule("camera", "is_not", "canon")], "all", "not (upper(e_make) = 'CANON')"),
    ("R13_lens", [_rule("lens", "is", "sigma||L2")], "all", "upper(e_lens_make) = 'SIGMA' and e_lens_model = 'L2'"),
    ("R14_any", [_rule("tag", "has", 12), _rule("rating", "is", 4)], "any", _TAG.format(12, "in") + " or rating = 4"),
    ("R14_all", [_rule("file_type", "is", 1), _rule("rating", "gte", 2), _rule("has_gps", "is", True), _rule("person", "has", 3)], "all", "file_type = 1 and rating >= 2 and gps_latitude is not null and id in (select file_id from v_faces where person_id = 3)"),
]
for _name, _rules, _match, _sql in RULES:
    register(_name, lambda lib, r=_rules, m=_match: rules.apply(lib, r, m, NOW).select("id", "size"), f"select id, size from v_visible where {_sql}")

_ANY = [_rule("tag", "has", 12), _rule("rating", "is", 4)]
register("R16_count_sum", lambda lib: count_and_size(rules.apply(lib, _ANY, "any", NOW)), "select count(*) n, cast(coalesce(sum(size), 0) as bigint) total_size from v_visible where " + _TAG.format(12, "in") + " or rating = 4")
register("R17_page", lambda lib: rules.apply(lib, _ANY, "any", NOW).orderBy(*ordering(4, True)).limit(25).select("id"), "select id from v_visible where (" + _TAG.format(12, "in") + " or rating = 4) order by size desc nulls last, id desc limit 25")


def compatible(lib: Library, tag_ids: list[int]):
    """The joined form: every tag rule of `all` tests one row of one join, so two tags never meet; under `any` files without tags drop out."""
    rows = lib.base.join(lib.file_tags, F.col("id") == F.col("file_id"))
    for tag in tag_ids:
        rows = rows.where(F.col("tag_id") == tag)
    return rows.select("id").distinct()


register("R8_compat_two_tags", lambda lib: compatible(lib, [12, 23]), "select distinct id from v_files join v_file_tags on id = file_id where tag_id = 12 and tag_id = 23")
register("R14_compat_any", lambda lib: lib.base.join(lib.file_tags, F.col("id") == F.col("file_id")).where("tag_id = 12 or rating = 4").select("id").distinct(), "select distinct id from v_files join v_file_tags on id = file_id where tag_id = 12 or rating = 4")
