"""Quality rules: a learned decision list.  Sequential covering grows and prunes conjunctions of
thresholds from labelled counts, and emits them as ordered Spark conditions.

Only DataFrame functions run on the executors; the driver sees counts by feature, bin and label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.llm.common import stash, table

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_bangs", "n_upper", "n_distinct"]
#: Features that rules may test, as expressions over the counts.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(1, n_words)",
    "symbols": "n_symbols / greatest(1, word_chars)",
    "bangs": "n_bangs / greatest(1, n_words)",
    "upper": "n_upper / greatest(1, word_chars)",
    "dup_lines": "n_dup_lines / greatest(1, n_words)",
    "repeats": "n_repeat_words / greatest(1, n_words)",
    "distinct": "n_distinct / greatest(1, n_words)",
}
BINS = 24  # thresholds a feature from each label's quantiles
MAX_CONDITIONS = 3
MIN_COVER = 5
MIN_PURITY = 0.95
CLOSE = 0.97


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns BASE and EXTRA (all long), which take the place of docs' own ones of these
    names.  Null text has no words.

    Windows of five words are compared by 64-bit hashes within their own text alone.  Only texts
    that do repeat a window sort their windows; the work is n log n in the words of a text.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    others = [c for c in docs.columns if c not in (*BASE, *EXTRA)]
    # The row travels as one struct, so that its columns may have any names.
    df = docs.select(F.struct(*others).alias("_row"), t.alias("_t")).withColumn("_w", F.array_remove(F.split("_t", WHITE), ""))
    df = df.withColumn("_n", F.size("_w"))
    at = F.when(F.col("_n") >= WINDOW, F.sequence(F.lit(0), F.col("_n") - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_at", at).withColumn("_h", F.transform("_at", lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)])))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    gone = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    df = df.withColumn("_l", lines).select(
        "_row",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        gone("#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        gone("!").alias("n_bangs"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_h"),
    )
    df = df.withColumn("_s", F.when(F.col("_h").isNotNull(), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, i: F.coalesce(F.get("_s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.when(F.col("_s").isNull(), 0).otherwise(covered).cast("long"))
    return df.select(*[F.col("_row")[c].alias(c) for c in others], *BASE, *EXTRA)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions; bad and all: labelled rows that it covered when learned."""

    conditions: tuple[Condition, ...]
    bad: int
    all: int

    def column(self) -> Column:
        return reduce(Column.__and__, (c.column() for c in self.conditions))


def purity(bad: float, n: float) -> float:
    """Laplace-smoothed share of bad rows."""
    return (bad + 1) / (n + 2)


def _cells(rows: DataFrame) -> dict[tuple[int, int], list[int]]:
    """(feature, bin) -> rows [grow good, grow bad, prune good, prune bad]; bounded by features and bins."""
    out: dict[tuple[int, int], list[int]] = {}
    got = rows.select(F.posexplode("bins"), "bad", "prune").groupBy("pos", "col", "bad", "prune").count().collect()
    for f, b, bad, prune, n in got:
        out.setdefault((f, b), [0] * 4)[2 * prune + bad] += n
    return out


def _bin(value: Column, limits: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(v) for v in limits]), lambda t: t < value))


def learn(labelled: DataFrame) -> list[Rule]:
    """labelled: the columns of counts() and bad (0 or 1).  A third of the rows, by hash, prunes.

    Rules are added until the next one is not pure; each takes rows away, so this ends.
    """
    names = list(FEATURES)
    values = F.array(*[F.expr(FEATURES[n]).cast("double") for n in names])
    rows = stash(labelled.filter(~base_failed()).select(values.alias("x"), F.col("bad").cast("int").alias("bad"), (F.pmod(F.xxhash64(*BASE, *EXTRA), F.lit(3)) == 0).cast("int").alias("prune")), "labelled")
    steps = [i / BINS for i in range(1, BINS)]
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(F.col("x")[i], steps, 1000).alias(n) for i, n in enumerate(names)]).collect()
    if {r["bad"] for r in cuts} != {0, 1}:
        return []
    limits = [sorted({float(v) for r in cuts for v in r[n]}) for n in names]
    # A bin is the number of thresholds under the value.
    rows = stash(rows.select(F.array(*[_bin(F.col("x")[i], vs) for i, vs in enumerate(limits)]).alias("bins"), "bad", "prune"), "bins")

    def covers(conditions: list[tuple[int, bool, int]]) -> Column:
        return reduce(Column.__and__, [(F.col("bins")[f] > t) if above else (F.col("bins")[f] <= t) for f, above, t in conditions], F.lit(True))

    rules: list[Rule] = []
    left = rows
    while True:
        chosen: list[tuple[int, bool, int]] = []
        scores = []  # of each prefix: (worth on the pruning rows, bad, all)
        while len(chosen) < MAX_CONDITIONS:
            cells = _cells(left.filter(covers(chosen)))
            total = [sum(c[i] for (f, _), c in cells.items() if f == 0) for i in range(4)]
            if not total[1] or not total[0] + total[2]:
                break
            before, found = math.log2(purity(total[1], total[0] + total[1])), []
            for f, vs in enumerate(limits):
                low = [0] * 4
                for t in range(len(vs)):
                    low = [a + b for a, b in zip(low, cells.get((f, t), [0] * 4), strict=True)]
                    for above in (False, True):
                        n = [a - b for a, b in zip(total, low, strict=True)] if above else low
                        if n[1] + n[3] < MIN_COVER:
                            continue
                        gain = n[1] * (math.log2(purity(n[1], n[0] + n[1])) - before)
                        if gain > 1e-9:
                            found.append((gain, (f, above, t), n))
            if not found:
                break
            # Of the thresholds that are nearly as good as the best, that which rejects the least.
            gain, (f, above, _), _ = max(found, key=lambda x: x[0])
            close = [x for x in found if x[1][:2] == (f, above) and x[0] >= CLOSE * gain]
            _, condition, n = max(close, key=lambda x: x[1][2] if above else -x[1][2])
            chosen.append(condition)
            scores.append((purity(n[3], n[2] + n[3]), n[1] + n[3], sum(n)))
        if not scores:
            break
        # Prune: the shortest conjunction whose purity on rows that it wasn't grown on is highest.
        keep = max(range(len(scores)), key=lambda i: (round(scores[i][0], 3), -i))
        _, bad, n = scores[keep]
        if purity(bad, n) < MIN_PURITY or scores[keep][0] < MIN_PURITY and bad < n:
            break
        chosen = chosen[: keep + 1]
        rules.append(Rule(tuple(Condition(names[f], above, limits[f][t]) for f, above, t in chosen), bad, n))
        left = left.filter(~covers(chosen))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1; null if it meets none."""
    if not rules:
        return F.lit(None).cast("int")
    out = F
    for i, r in enumerate(rules, 1):
        out = out.when(r.column(), F.lit(i))
    return out


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """docs with the counts, base_failed, rule (the first rule met, or null) and kept; and the rules.

    labels: doc_id and quality, 0 for bad.  Labels that are null, of other values, or of documents
    that aren't there do not count; without labels of both kinds there is no rule.  Equal texts are
    judged alike.  docs is what counts() returns, with doc_id; its text need not be there.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((1 - F.max("quality")).alias("bad"))
    found = stash(docs, "counts")
    rules = learn(found.select(F.col("doc_id").cast("long").alias("_id"), *BASE, *EXTRA).join(known, "_id"))
    out = found.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of docs."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("text"))
    return judge(counts(row).drop("text"), labels)[0].filter("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = judge(counts(docs).drop("text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "rule")
