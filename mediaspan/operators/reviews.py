"""Reviewed state of duplicate groups: choices are kept apart from the groups and merged with them at every rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.operators.dedup import _GROUPS, exact_groups, keepers
from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query, register

# The orders of group lists.
ORDERS = {"size_desc": ("total_size", False), "size_asc": ("total_size", True), "count_desc": ("n", False), "count_asc": ("n", True)}


def latest_choices(choices: DataFrame) -> DataFrame:
    """The last choice (hash, file_size, file_id, at) of each group; an id of 0 or less clears it. Of one time the greatest id counts."""
    last = F.max(F.struct("at", "file_id"))["file_id"].alias("chosen")
    return choices.where("hash is not null").groupBy("hash", "file_size").agg(last)


def reviewed_items(members: DataFrame, choices: DataFrame) -> DataFrame:
    """members (hash, file_size, file_id, score, is_keep) with is_keep as chosen, and whether the group is reviewed.

    A choice of a file that is not in the group any more is void: the group
    falls back to its first and is not reviewed. A cleared group keeps none
    and is reviewed. Choices of groups that are no more do nothing. The joins
    are plain equi-joins of small rows; no group is gathered.
    """
    known = latest_choices(choices)
    held = members.join(known, ["hash", "file_size"]).where("file_id = chosen").select("hash", "file_size", F.col("chosen").alias("held")).distinct()
    state = known.join(held, ["hash", "file_size"], "left").where("held is not null or chosen <= 0").select("hash", "file_size", F.coalesce("held", F.lit(0)).alias("kept"))
    met = members.join(state, ["hash", "file_size"], "left")
    return met.select("hash", "file_size", "file_id", "score", F.when(F.col("kept").isNull(), F.col("is_keep")).otherwise(F.col("file_id") == F.col("kept")).alias("is_keep"), F.col("kept").isNotNull().alias("reviewed"))


def listed(items: DataFrame, show: str = "all", order: str = "size_desc") -> DataFrame:
    """(hash, n, total_size, reviewed) of groups of two and more, by review and in one of four orders; equal ones by hash."""
    if show not in ("all", "reviewed", "unreviewed"):
        raise ValueError(f"unknown filter {show}")
    by, rising = ORDERS.get(order, ORDERS["size_desc"])
    groups = items.groupBy("hash", "file_size").agg(F.count("*").alias("n"), F.first("reviewed").alias("reviewed")).where("n > 1")
    shown = groups if show == "all" else groups.where(F.col("reviewed") == (show == "reviewed"))
    sized = shown.select("hash", "n", (F.col("n") * F.col("file_size")).alias("total_size"), "reviewed")
    return sized.orderBy(F.col(by).asc() if rising else F.col(by).desc(), "hash")


def made_choices(lib: Library) -> DataFrame:
    """Choices of four kinds by the last digit of a group's hash: the greatest member after another, cleared, or a file that is gone; the others have none."""
    groups = exact_groups(lib).select("hash", "file_size")
    last = lib.hashes.join(groups, ["hash", "file_size"]).groupBy("hash", "file_size").agg(F.max("file_id").alias("last"), F.min("file_id").alias("first"))
    digit = F.substring("hash", -1, 1)
    one = lambda where, at, file_id: last.where(where).select("hash", "file_size", file_id.cast("long").alias("file_id"), F.lit(at).alias("at"))
    return one(digit.isin("0", "1", "2", "3"), 1, F.col("first")).unionByName(one(digit.isin("0", "1", "2", "3"), 2, F.col("last"))).unionByName(one(digit.isin("4", "5"), 3, F.lit(0))).unionByName(one(digit.isin("6", "7"), 4, F.lit(10**15)))


def items(lib: Library) -> DataFrame:
    members = keepers(lib).join(exact_groups(lib).select("hash", "file_size"), "hash")
    return reviewed_items(members, made_choices(lib))


_ITEMS = f""", g as ({_GROUPS}), m as (
    select h.hash, h.file_size, h.file_id, count(*) over (partition by h.hash) - row_number() over w + 1 score, row_number() over w = 1 first, max(h.file_id) over (partition by h.hash, h.file_size) last, right(h.hash, 1) digit
    from v_hashes h join g using (hash, file_size) left join v_files a on a.id = h.file_id window w as (partition by h.hash order by coalesce(taken_date, 0) > 0 desc, created_at nulls first, h.file_id)),
r as (select hash, file_size, file_id, score, case when digit in ('0', '1', '2', '3') then file_id = last when digit in ('4', '5') then false else first end is_keep, digit in ('0', '1', '2', '3', '4', '5') reviewed from m) """
register("D8_set_keep", lambda lib: items(lib).select("hash", "file_id", "score", "is_keep", "reviewed"), _ITEMS + "select hash, file_id, score, is_keep, reviewed from r")


@query("D9_unkept_candidates", _ITEMS + "select distinct file_id from r where reviewed and not is_keep")
def candidates(lib: Library) -> DataFrame:
    """Files of reviewed groups that are not kept; a cleared group has all of them."""
    return items(lib).where("reviewed and not is_keep").select("file_id").distinct()


for _show, _where in (("all", "true"), ("reviewed", "reviewed"), ("unreviewed", "not reviewed")):
    for _order, (_by, _rising) in ORDERS.items():
        if _show == "all" or _order in ("size_desc", "count_asc"):
            register(
                f"D7_{_show}_{_order}",
                lambda lib, show=_show, order=_order: listed(items(lib), show, order),
                _ITEMS + f"select hash, count(*) n, count(*) * min(file_size) total_size, bool_or(reviewed) reviewed from r where {_where} group by hash order by {_by} {'asc' if _rising else 'desc'}, hash",
            )
