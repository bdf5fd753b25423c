"""Scalar expressions and predicates: keys, sizes, boxes, file and media tests, JSON wrappers."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types of camera photos, and file extensions that are read.
PHOTO_TYPES = ("image/jpeg", "image/heic", "image/heif")
PHOTO_EXTENSIONS = ("jpg", "jpeg", "heic", "heif", "webp")
UNITS = ("B", "KB", "MB", "GB", "TB")
TERMINAL = ("phase1_done", "phase2_done", "deferred_multi_face", "reclustered")


def human_size(n: Column) -> Column:
    """Bytes with one decimal in steps of 1024, up to PB."""
    scaled, unit = n / F.lit(1024.0**5), F.lit("PB")
    for i in reversed(range(len(UNITS))):
        small = n < F.lit(1024.0 ** (i + 1))
        scaled, unit = F.when(small, n / F.lit(1024.0**i)).otherwise(scaled), F.when(small, UNITS[i]).otherwise(unit)
    return F.concat(one_decimal(scaled), F.lit(" "), unit)


#: The least double that rounds up from each tenth of a fraction: the middle itself goes to the even tenth.
_UP = [m if (at := Fraction(m) - Fraction(2 * j + 1, 20)) > 0 or at == 0 and j % 2 else math.nextafter(m, 1) for j, m in enumerate((2 * j + 1) / 20 for j in range(10))]


def one_decimal(x: Column) -> Column:
    """A double as C prints it with %.1f: its exact value is rounded, ties to even (Java rounds the shortest decimal up)."""

    def text(x: Column) -> Column:
        size = F.abs(x)
        part = size - F.floor(size)
        tenth = F.least(F.floor(part * 10), F.lit(9).cast("long")).cast("int")
        tenths = F.floor(size) * 10 + tenth + (part >= F.get(F.array(*map(F.lit, _UP)), tenth)).cast("int")
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        # from 2^52 on there is no fraction
        return F.when(size < F.lit(2.0**52), F.format_string("%s%d.%d", sign, F.floor(tenths / 10), tenths % 10)).when(x.isNotNull(), F.format_string("%.1f", x))

    return F.transform(F.array(x.cast("double")), text)[0]


def item_key(group: Column, index: Column) -> Column:
    return F.concat_ws(":", group.cast("string"), index.cast("string"))


def key_group(key: Column) -> Column:
    """What stands before the last colon."""
    return F.regexp_extract(key, r"(?s)^(.*):", 1)


def key_index(key: Column) -> Column:
    return F.substring_index(key, ":", -1).cast("int")


def person_id(number: Column) -> Column:
    return F.format_string("person_%03d", number)


def rank_name(number: Column) -> Column:
    return F.format_string("pessoa_%02d", number)


def stable_id(uids: Column) -> Column:
    """First 12 hex digits of the hash of the sorted distinct keys. Equal key sets give equal ids."""
    return F.substring(F.sha2(F.array_join(F.sort_array(F.array_distinct(uids)), "|").cast("binary"), 256), 1, 12)


def passes_gate(px: Column, score: Column, min_px: float, min_score: float) -> Column:
    """Quality gate; a missing measurement counts as 0."""
    return (F.coalesce(px, F.lit(0.0)) >= min_px) & (F.coalesce(score, F.lit(0.0)) >= min_score)


def is_screenshot(name: Column) -> Column:
    return name.rlike(r"(?i)^screenshot_")


def is_camera_photo(media_type: Column, name: Column) -> Column:
    return F.coalesce(media_type.isin(*PHOTO_TYPES), F.lit(False)) & ~F.startswith(F.lower(name), F.lit("screenshot"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def has_extension(name: Column, wanted: list[str]) -> Column:
    """wanted: with or without a point, any case."""
    return extension(name).isin(*(w.lower().lstrip(".") for w in wanted))


def is_wide_frame(width: Column, height: Column) -> Column:
    """16:9 within 0.02; unreadable sizes are not."""
    return F.coalesce(F.abs(width / F.when(height != 0, height) - F.lit(16 / 9)) <= 0.02, F.lit(False))


def face_px(box: Column) -> Column:
    """The shorter side of (x1, y1, x2, y2)."""
    return F.least(box[2] - box[0], box[3] - box[1])


def padded_box(box: Column, width: Column, height: Column, share: float = 0.3) -> Column:
    """The box widened by a share of its height, whole numbers, inside the image."""
    pad = (box[3] - box[1]) * share
    return F.array(
        F.greatest(F.lit(0), (box[0] - pad).cast("int")), F.greatest(F.lit(0), (box[1] - pad).cast("int")),
        F.least(width.cast("int"), (box[2] + pad).cast("int")), F.least(height.cast("int"), (box[3] + pad).cast("int")),
    )


def unwrapped(json: Column) -> Column:
    """A name that is plain text or wrapped as {ok, value}: the value if ok, else null; plain text passes."""
    wrapped = F.startswith(F.trim(json), F.lit("{"))
    return F.when(wrapped, F.when(F.get_json_object(json, "$.ok") == "true", F.get_json_object(json, "$.value"))).otherwise(json)


def unwrapped_value(json: Column) -> Column:
    """As unwrapped, whatever ok says."""
    return F.when(F.startswith(F.trim(json), F.lit("{")), F.get_json_object(json, "$.value")).otherwise(json)


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def looked_up(map_: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(map_, key), default)


def verdict(rms: Column, conflicts: Column, threshold: float) -> Column:
    """How a block profile takes an identity, for display."""
    return (F.when((rms <= threshold) & (conflicts == 0), "blocked").when(rms <= threshold, "near, shares photos")
            .when(rms <= threshold + 0.15, "near").otherwise("far"))
