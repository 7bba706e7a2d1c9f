"""Dynamic sets: a list of rules compiled into one predicate over the library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.plans.catalog import Library, fold
from mediaspan.plans.predicates import day, like_folded, type_mask

_UNIT_SECONDS = {"day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}
_COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "is": lambda a, b: a == b, "neq": lambda a, b: a != b, "is_not": lambda a, b: a != b}
_DATES = {"date_taken": "taken_date", "date_created": "created_at", "date_modified": "modified_at"}


def as_int(value) -> int:
    """Numbers, numeric text and booleans as an integer; anything else 0."""
    try:
        return int(float(value))
    except (TypeError, ValueError):
        return 0


def as_bool(value, default: bool = True) -> bool:
    if value is None:
        return default
    return value.lower() in ("true", "1", "yes") if isinstance(value, str) else bool(value)


def condition(rule: dict, now: int) -> Column:
    """One rule over base columns; tag and person rules use the flags that apply() adds."""
    field, op, value = rule["field"], rule["operator"], rule.get("value")
    positive = op in ("is", "eq")
    if field == "name":
        text = str(value)
        if op in ("contains", "not_contains"):
            found = like_folded(F.col("name"), f"%{text}%")
            return found if op == "contains" else ~found
        if positive:
            return fold(F.col("name")) == fold(F.lit(text))
    elif field == "favorite":
        found = F.coalesce("is_favorite", F.lit(False))
        return found if as_bool(value) == positive else ~found
    elif field == "rating" or field == "size":
        c = F.col(field)
        if op in ("empty", "not_empty"):
            return (F.coalesce(c, F.lit(0)) == 0) == F.lit(op == "empty")
        number = as_int(value) if field == "rating" else max(0, round(float(value) * 1_000_000))
        if op in _COMPARE:
            return _COMPARE[op](c, F.lit(number))
    elif field == "file_type":
        found = type_mask(as_int(value))
        found = F.lit(True) if found is None else found
        return ~found if op in ("is_not", "neq") else found
    elif field == "extension":
        found = fold(F.col("name")).endswith("." + str(value).lstrip(".").lower())
        return ~found if op == "is_not" else found
    elif field == "orientation":
        return {"landscape": F.col("width") > F.col("height"), "portrait": F.col("width") < F.col("height"), "square": F.col("width") == F.col("height")}.get(str(value), F.lit(True))
    elif field in ("tag", "person"):
        flag = F.col(flag_name(rule))
        return ~flag if op in ("not_has", "empty") else flag
    elif field in _DATES:
        c, d = F.col(_DATES[field]), day(_DATES[field])
        on = lambda x: F.to_date(F.timestamp_seconds(F.lit(as_int(x))))
        if op in ("empty", "not_empty"):
            return (F.coalesce(c, F.lit(0)) == 0) == F.lit(op == "empty")
        if op == "before":
            return d < on(value)
        if op == "after":
            return d >= on(value)
        if op == "between":
            start, end = (value["start"], value["end"]) if isinstance(value, dict) else value
            return (d >= on(start)) & (d < on(end))
        if op in ("in_last", "older_than"):
            value = value or {}
            amount = max(1, as_int(value.get("amount", 7 if op == "in_last" else 365)))
            edge = now - amount * _UNIT_SECONDS.get(value.get("unit", "day"), 86400)
            return c >= edge if op == "in_last" else c < edge
    elif field == "has_gps":
        found = F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull()
        return found if as_bool(value) == positive else ~found
    elif field in ("camera", "lens"):
        make, _, model = str(value).partition("||")
        if not make:
            return F.lit(True)
        prefix = "e_" if field == "camera" else "e_lens_"
        found = F.upper(prefix + "make") == make.upper()
        found = found & (F.col(prefix + "model") == model) if model else found
        return ~found if op == "is_not" else found
    raise ValueError(f"rule {field} {op} is not known")


def flag_name(rule: dict) -> str:
    wanted = rule.get("value") if rule["operator"] in ("has", "not_has") else "any"
    return f"_{rule['field']}_{wanted}"


def apply(lib: Library, rules: list[dict], match: str = "all", now: int = 0) -> DataFrame:
    """Visible files that meet all rules, or any of them.

    Every tag or person rule is its own EXISTS: its distinct file ids are
    left-joined as a flag, so rules combine freely under either joiner.
    """
    if not rules:
        raise ValueError("a dynamic set needs a rule")
    df = lib.visible(lib.base)
    for rule in {flag_name(r): r for r in rules if r["field"] in ("tag", "person")}.values():
        pairs, key = (lib.file_tags, "tag_id") if rule["field"] == "tag" else (lib.faces, "person_id")
        wanted = F.col(key) == as_int(rule.get("value")) if rule["operator"] in ("has", "not_has") else F.col(key).isNotNull()
        ids = pairs.where(wanted).select(F.col("file_id").alias("id"), F.lit(True).alias(flag_name(rule))).distinct()
        df = df.join(ids, "id", "left").fillna(False, [flag_name(rule)])
    parts = [condition(r, now) for r in rules]
    return df.where(reduce((lambda a, b: a | b) if match == "any" else (lambda a, b: a & b), parts))
