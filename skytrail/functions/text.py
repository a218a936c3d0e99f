"""Names, lists, labels and instruction texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task ids in their usual order, and the names that splits may have.
TASKS = ["0", "obstacle", "hl", "orbit", "road", "building", "orbit_multi", "farm"]
REGIONS_ZH = {
    "top-left": "左上角", "top": "上方", "top-right": "右上角",
    "left": "左侧", "center": "中央", "right": "右侧",
    "bottom-left": "左下角", "bottom": "下方", "bottom-right": "右下角",
}
# Keywords of road and region names in order of priority, and what they stand for.
ROADS = [
    (("small_road", "small-road", "small road"), "小马路"),
    (("lane", "dirt_road", "dirt-road", "dirt road"), "小路"),
    (("canal", "ditch"), "水沟"),
    (("road",), "马路"),
    (("小马路",), "小马路"),
    (("马路",), "马路"),
    (("小路",), "小路"),
    (("水沟",), "水沟"),
]
FIELDS = [
    (("construction", "worksite", "site"), "construction site"),
    (("wetland",), "wetland"),
    (("field",), "field"),
    (("forest",), "forest"),
    (("施工",), "construction site"),
    (("湿地",), "wetland"),
    (("田",), "field"),
]


def task_name(c: Column | str) -> Column:
    """Without the prefix task_, once."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, "^task_", "")


def split_name(c: Column | str) -> Column:
    """unseen, seen, or null."""
    low = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.when(low.contains("unseen"), "unseen").when(low.contains("seen"), "seen")


def rollout_path(path: Column | str) -> tuple[Column, Column, Column]:
    """(task, split, env) of a rollout file's path; the level of a model's name is skipped, and
    without a task level the scene is the folder above the file's folder."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.coalesce(F.array_position(F.transform(parts, lambda p: p.startswith("task_")), F.lit(True)), F.lit(0))
    get = lambda i: F.get(parts, (i - 1).cast("int"))
    task = F.when(at > 0, task_name(get(at)))
    split = F.when(at > 0, get(at + 1))
    model = F.lower(get(at + 2)).isin("openvla", "fastvla", "fastvlm") & get(at + 3).isNotNull()
    env = F.when(split.isNotNull(), F.when(model, get(at + 3)).otherwise(get(at + 2)))
    above = F.when(F.size(parts) >= 3, F.get(parts, F.size(parts) - 3))
    return task, split_name(split), F.coalesce(env, above)


def episode_id(path: Column | str) -> Column:
    return F.regexp_extract(path, r"episode_(\d+)", 1).cast("long")


def episode_stem(i: Column | str) -> Column:
    """Six digits, or more where they are needed."""
    return F.format_string("episode_%06d", F.col(i) if isinstance(i, str) else i)


def chunk_dir(i: Column | str, size: int = 1000) -> Column:
    i = F.col(i) if isinstance(i, str) else i
    return F.format_string("chunk-%03d", F.floor(i / size))


def moved_path(path: Column | str, i: Column | str, size: int = 1000) -> Column:
    """A path with the tokens of its chunk and episode replaced by those of another episode."""
    out = F.regexp_replace(path, F.lit(r"episode_\d+"), episode_stem(i))
    return F.regexp_replace(out, F.lit(r"chunk-\d+"), chunk_dir(i, size))


def numbers(text: str | None, default: list[float]) -> list[float]:
    """Positive numbers of a list with commas (also full-width), semicolons or blanks; the first of equals."""
    out = []
    for piece in re.split(r"[,;，\s]+", text or ""):
        try:
            value = float(piece)
        except ValueError:
            continue
        if value > 0 and value not in out:
            out.append(value)
    return out or list(default)


def tasks(text: str | None, default: list[str] = TASKS) -> list[str]:
    names = [re.sub("^task_", "", x) for x in re.split(r"[,;，\s]+", text or "")]
    return list(dict.fromkeys(x for x in names if x)) or list(default)


def number_array(c: Column | str) -> Column:
    """numbers() for a column: distinct positive values in the order of the text."""
    pieces = F.split(F.regexp_replace(c, r"[;，\s]+", ","), ",")
    return F.array_distinct(F.filter(F.transform(pieces, lambda x: x.try_cast("double")), lambda v: v.isNotNull() & (v > 0)))


def natural_key(c: Column | str) -> Column:
    """Sorts texts with digit runs as numbers, letters lowered.  A run goes by the number of its digits
    without leading zeros, in nine places, then by the digits, so that runs may have any length."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    pad = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(F.length(digits(p)).cast("string"), 9, "0"), digits(p))).otherwise(p))
    return F.array_join(pad, "")


def region_label(u: Column, v: Column, width: Column, height: Column) -> Column:
    """Which of nine parts of an image a point lies in."""
    x = F.when(u < width / 3.0, "left").when(u < 2.0 * width / 3.0, "center").otherwise("right")
    y = F.when(v < height / 3.0, "top").when(v < 2.0 * height / 3.0, "center").otherwise("bottom")
    return F.when((x == "center") & (y == "center"), "center").when(x == "center", y).when(y == "center", x).otherwise(F.concat_ws("-", y, x))


def orbit_text(region: Column, lang: str = "en") -> Column:
    if lang == "en":
        return F.concat(F.lit("Orbit the building in the "), F.when(region == "center", "center").otherwise(region), F.lit(" of the view once."))
    names = F.create_map(*[F.lit(x) for kv in REGIONS_ZH.items() for x in kv])
    return F.concat(F.lit("巡视画面"), F.coalesce(F.element_at(names, region), F.lit("某处")), F.lit("的建筑"))


def subject(name: Column | str, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """What the first keyword found in the lowered name stands for."""
    low = F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    out = F
    for words, value in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def real_height(z: Column | str, base: float = 80.0) -> Column:
    """Whole metres over ground, halves to even."""
    return F.bround((F.col(z) if isinstance(z, str) else z) + base, 0).cast("int")


def landing_text(label: Column, z: Column) -> Column:
    return F.format_string("Fly above the %s and descend to a height of %d meters.", label, real_height(z))
