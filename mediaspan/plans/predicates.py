"""Predicates of the standard query, as columns chosen while the plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.plans.catalog import Library, fold

DATE_COLUMNS = ("taken_date", "created_at", "modified_at")


@dataclass(frozen=True)
class Params:
    """Parameters of the standard query; the defaults filter nothing."""

    name: str = ""
    type_mask: int = 0
    subtree: str = ""
    folder: str = ""
    start: int = 0
    end: int = 0
    calendar_sort: int = 0
    today: str = ""
    make: str = ""
    model: str = ""
    lens_make: str = ""
    lens_model: str = ""
    admin1: str = ""
    place: str = ""
    box: tuple[float, float, float, float] | None = None
    favorite: bool = False
    rating: int = -1
    tag_id: int = 0
    person_id: int = 0


def like_folded(c: Column, pattern: str) -> Column:
    """LIKE that folds ASCII case; % and _ of the input keep their meaning."""
    return fold(c).like(pattern.translate({i: i + 32 for i in range(65, 91)}))


def type_mask(mask: int) -> Column | None:
    """1 image, 2 video, 4 raw, 8 live; none if every type is asked for."""
    if mask <= 0 or mask & 7 == 7:
        return None
    wanted = [F.col("file_type") == t for bit, t in ((1, 1), (2, 2), (4, 3)) if mask & bit]
    if mask & 8:
        wanted.append(F.col("live_photo_type").isin(1, 3, 4))
    return reduce(lambda a, b: a | b, wanted) if wanted else None


def day(c: str) -> Column:
    return F.to_date(F.timestamp_seconds(F.col(c)))


def conjuncts(p: Params) -> list[Column]:
    """The active column predicates."""
    out: list[Column] = []
    dated = DATE_COLUMNS[p.calendar_sort // 2] if 0 <= p.calendar_sort // 2 < 3 else DATE_COLUMNS[0]
    if p.name:
        out.append(like_folded(F.col("name"), f"%{p.name}%"))
    if (kinds := type_mask(p.type_mask)) is not None:
        out.append(kinds)
    if p.subtree:
        out.append((F.col("folder_path") == p.subtree) | like_folded(F.col("folder_path"), f"{p.subtree}/%"))
    if p.folder:
        out.append(F.col("folder_path") == p.folder)
    if p.start > 0 and p.end > 0:
        first, last = (F.to_date(F.timestamp_seconds(F.lit(x))) for x in (p.start, p.end))
        out.append((day(dated) >= first) & (day(dated) < last))
    elif p.start == -1 and p.end == -1:
        out.append(F.date_format(F.timestamp_seconds(F.col(dated)), "MM-dd") == p.today)
    for make, model, columns in ((p.make, p.model, ("e_make", "e_model")), (p.lens_make, p.lens_model, ("e_lens_make", "e_lens_model"))):
        if make:
            out.append(F.upper(columns[0]) == make.upper())
            if model:
                out.append(F.col(columns[1]) == model)
    if p.admin1:
        out.append(F.col("geo_admin1") == p.admin1)
        if p.place:
            out.append(F.col("geo_name") == p.place)
    if p.box is not None:
        south, north, west, east = p.box
        lon = F.col("gps_longitude")
        out.append(F.col("gps_latitude").between(south, north) & (lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)))
    if p.favorite:
        out.append(F.col("is_favorite"))
    if p.rating == 0:
        out.append(F.coalesce("rating", F.lit(0)) == 0)
    elif p.rating > 0:
        out.append(F.col("rating") == p.rating)
    return out


def search(lib: Library, p: Params) -> DataFrame:
    """The visible files that meet every active parameter, once each."""
    df = lib.visible(lib.base)
    for c in conjuncts(p):
        df = df.where(c)
    if p.tag_id:
        df = df.join(lib.file_tags.where(F.col("tag_id") == p.tag_id).select(F.col("file_id").alias("id")), "id", "left_semi")
    if p.person_id:
        df = df.join(lib.faces.where(F.col("person_id") == p.person_id).select(F.col("file_id").alias("id")), "id", "left_semi")
    return df
