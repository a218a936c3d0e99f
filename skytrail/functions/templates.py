"""Instruction and stage texts by task and language, and readers of small text values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skytrail.functions.text import REGIONS_ZH, real_height

# The texts of each task.  {label}, {clean} (the label without words of place), {height},
# {radius}, {subject} and {place} are filled in.
TEXTS = {
    ("landing", "en"): "Fly to {height} meters above the {label}.",
    ("orbit", "en"): "Orbit the {label} once at {height} meters",
    ("orbit_radius", "en"): "Orbit the {label} once at {height} meters with a {radius}-meter radius.",
    ("spiral", "en"): "Spiral down around the {label}",
    ("road", "en"): "Inspect the {subject} in the view",
    ("road", "zh"): "巡视画面中的{subject}",
    ("farm", "en"): "Perform a mapping mission over the {subject} in the {place} of the view.",
    ("farm", "zh"): "对画面{place}的{subject}执行测绘任务",
    ("building", "en"): "Orbit the building in the {place} of the view once.",
    ("building", "zh"): "巡视画面{place}的建筑",
}
STAGES = {
    ("landing", "en"): ["Turn to face the {label}.", "Fly to above the {clean}.", "Descend to {height} meters above the {clean}."],
    ("orbit", "en"): ["Turn to face the {label}.", "Fly while descending to {height} meters above the {clean}.", "Turn to enter the orbit around the {clean}.", "Orbit the {clean} once.", "Turn to face the starting point.", "Fly while ascending back to the starting point."],
    ("orbit_radius", "en"): ["Turn to face the {label}.", "Fly while descending to {height} meters above the {clean}.", "Turn to enter a {radius}-meter-radius orbit around the {clean}.", "Orbit the {clean} once with a {radius}-meter radius.", "Turn to face the starting point.", "Fly while ascending back to the starting point."],
    ("road", "en"): ["Move above the {subject}", "Descend to cruise altitude", "Adjust heading", "Inspect along the {subject}", "Ascend back to the original altitude"],
    ("road", "zh"): ["平移到{subject}上方", "下降到巡航高度", "调整转向", "沿{subject}巡检", "上升回原始高度"],
    ("obstacle", "en"): ["Turn to face the target.", "Fly to the target while avoiding obstacles."],
}
ROAD_WORDS = {"马路": "road", "小马路": "small road", "小路": "dirt road", "水沟": "canal"}


def filled(template: str, **values: Column) -> Column:
    """A template as a column; numbers are written as they are."""
    out = F.lit(template)
    for name, value in values.items():
        if "{" + name + "}" in template:
            out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def place(region: Column, lang: str = "en") -> Column:
    if lang == "en":
        return region
    names = F.create_map(*[F.lit(x) for kv in REGIONS_ZH.items() for x in kv])
    return F.coalesce(F.element_at(names, region), F.lit("某处"))


def road_subject(subject_zh: Column, lang: str = "en") -> Column:
    words = F.create_map(*[F.lit(x) for kv in ROAD_WORDS.items() for x in kv])
    return F.coalesce(F.element_at(words, subject_zh), F.lit("road")) if lang == "en" else subject_zh


def instruction(task: str, lang: str = "en", z: Column | None = None, **values: Column) -> Column:
    """The instruction of a task; z (metres over the base) becomes its height."""
    return filled(TEXTS[task, lang], **values, **({"height": real_height(z)} if z is not None else {}))


def stage_texts(task: str, lang: str = "en", z: Column | None = None, **values: Column) -> Column:
    """The texts of a task's stages, as an array by subtask_id."""
    more = {"height": real_height(z)} if z is not None else {}
    return F.array(*[filled(t, **values, **more) for t in STAGES[task, lang]])


def duration(seconds: Column) -> Column:
    """1h02m03s or 02m03s, fractions cut off; N/A for what is null, not finite or negative."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    known = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < math.inf)
    return F.when(~F.coalesce(known, F.lit(False)), "N/A").when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).otherwise(F.format_string("%02dm%02ds", m, r))


def vector(text: Column, n: int) -> Column:
    """n numbers with commas, blanks ignored; null if there are more or fewer, or one is no number."""
    parts = F.transform(F.split(F.replace(text, F.lit(" "), F.lit("")), ","), lambda p: p.try_cast("double"))
    return F.when((F.size(parts) == n) & ~F.exists(parts, lambda v: v.isNull()), parts)


def sheet(value: str) -> int | str:
    """A sheet's number, or else its name."""
    return int(value) if value.strip().lstrip("+-").isdigit() else value
