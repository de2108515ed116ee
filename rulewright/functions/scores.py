"""Numeric, array and geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(score: Column, labels: tuple[str, str, str] = ("severe", "moderate", "mild")) -> Column:
    """Up to 30, up to 80, above. The bounds."""
    return F.when(score <= 30, F.lit(labels[0])).when(score <= 80, F.lit(labels[1])).when(score.isNotNull(), F.lit(labels[2]))


def evidence_grade(kind: Column) -> Column:
    # The study types of each grade.
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(low.rlike("meta-analysis|systematic review"), F.lit("A")).when(low.rlike("randomized|clinical trial"), F.lit("B")).otherwise(F.lit("C"))


def age_bounds(text: Column, open_low: int = 0, open_high: int = 999) -> Column:
    """``n세 이하``, ``a-b세`` and ``n세 이상`` as (lo, hi); other texts get the open bounds."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", "")

    def number(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int")

    most, low, high, least = number(r"^(\d+)\s*세\s*이하"), number(r"^(\d+)\s*-\s*(\d+)\s*세"), number(r"^(\d+)\s*-\s*(\d+)\s*세", 2), number(r"^(\d+)\s*세\s*이상")
    lo = F.when(most.isNotNull(), F.lit(0)).otherwise(F.coalesce(low, least, F.lit(open_low)))
    hi = F.coalesce(most, high, F.when(least.isNotNull(), F.lit(999)), F.lit(open_high))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def first_integer(c: Column) -> Column:
    """First run of digits of a mixed text such as ``30s``; null if there is none or it is no integer of 32 bits."""
    return F.regexp_extract(c.cast("string"), "[0-9]+", 0).try_cast("int")


def decade_class(age: Column) -> Column:
    return (F.floor(age / 10) - 1).cast("int")


def normalise(c: Column, groups: dict[str, list[str]], default: str | None = None) -> Column:
    """Map spellings to one value; a later group overrides an earlier one."""
    pairs = {word: value for value, words in groups.items() for word in words}
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit(default)) if default is not None else F.try_element_at(table, c)


def normalise_strict(c: Column, groups: dict[str, list[str]]) -> Column:
    """As ``normalise``, but an unknown spelling is an error."""
    return F.coalesce(normalise(c, groups), F.raise_error(F.concat(F.lit("unknown value: "), F.coalesce(c, F.lit("null")))).cast("string"))


def row_mean(*cols: Column) -> Column:
    """Mean of the values that are not null; null if there is none."""
    held = F.filter(F.array(*(c.cast("double") for c in cols)), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held))


def half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def mean_unless_top(top: int, *cols: Column) -> Column:
    """The top class if any value has it, else the rounded mean."""
    return F.when(F.greatest(*cols) == top, F.lit(top)).otherwise(half_even(row_mean(*cols)))


def two_sided(left: Column, right: Column, missing: int = 6) -> Column:
    return F.when(left.isNull() | right.isNull(), F.lit(missing)).otherwise(half_even((left + right) / 2))


def left_or_mean(left: Column, right: Column) -> Column:
    """Mean of two sides, or the one that is there."""
    return F.coalesce((left + right) / 2, left, right)


def real_or(left: Column, right: Column, missing: int = -1) -> Column:
    """Left unless it is the missing mark, then right."""
    return F.coalesce(F.nullif(left, F.lit(missing)), right)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if a vector is null, empty or zero; pass norms that are known."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    return F.coalesce(F.try_divide(dot(a, b), na * nb), F.lit(0.0))


def ensemble(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda x, y: (x + y) / 2)


def argmax(a: Column) -> Column:
    """Position of the first maximum, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    """Shares of the exponentials, taken from the maximum; maximum and sum are made once for the array."""
    lifted = F.transform(F.array(F.struct(logits.alias("x"), F.array_max(logits).alias("top"))), lambda s: F.transform(s["x"], lambda x: F.exp(x - s["top"])))
    summed = F.transform(lifted, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda t, y: t + y).alias("sum")))
    return F.transform(summed, lambda s: F.transform(s["e"], lambda x: x / s["sum"]))[0]


def one_hot(label: Column, depth: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i == label).cast("int"))


def pick_head(category: Column, heads: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in heads.items():
        out = F.when(category == name, value).otherwise(out)
    return out


def slope(dy: Column, dx: Column) -> Column:
    return F.atan2(dy, dx)


def rotate(x: Column, y: Column, angle: Column) -> Column:
    return F.struct((x * F.cos(angle) - y * F.sin(angle)).alias("x"), (x * F.sin(angle) + y * F.cos(angle)).alias("y"))


def euler(m: Column) -> Column:
    """Pitch, yaw and roll of a 3x3 rotation matrix given as nine values by row."""
    flat = F.hypot(m[0], m[3])
    return F.struct(F.atan2(m[7], m[8]).alias("pitch"), F.atan2(-m[6], flat).alias("yaw"), F.atan2(m[3], m[0]).alias("roll"))


def clip(c: Column, lo: Column | float, hi: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.least(F.greatest(c, low), high)


def robust_score(value: Column, lo: Column, hi: Column, inverted: Column | bool = False, top: float = 10.0) -> Column:
    """Min-max score of a clipped value; inverted scores count down. The scale of 10 and the least width."""
    share = clip((value - lo) / F.greatest(hi - lo, F.lit(1e-12)), 0.0, 1.0)
    flag = inverted if isinstance(inverted, Column) else F.lit(inverted)
    return F.when(flag, 1 - share).otherwise(share) * top


def overlap(a: Column, b: Column) -> Column:
    """Common rectangle of two boxes, null if empty."""
    x0, x1 = F.greatest(a["xmin"], b["xmin"]), F.least(a["xmax"], b["xmax"])
    y0, y1 = F.greatest(a["ymin"], b["ymin"]), F.least(a["ymax"], b["ymax"])
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax")))


def rebase(box: Column, origin: Column) -> Column:
    return F.struct(*((box[k] - origin["xmin" if k[0] == "x" else "ymin"]).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")))


def band_distance(p: Column, lo: Column, hi: Column) -> Column:
    """How far a value lies outside its band."""
    return F.greatest(F.lit(0.0), lo - p) + F.greatest(F.lit(0.0), p - hi)


def stars(p: Column) -> Column:
    """The usual significance levels."""
    return F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**")).when(p < 0.05, F.lit("*")).otherwise(F.lit("ns"))


def lookup(c: Column, table: dict, default: int = -1) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(default))


def indicator(c: Column, value: str) -> Column:
    return (c == value).cast("double")


def number_text(c: Column, places: int = 1) -> Column:
    return F.coalesce(F.format_string(f"%.{places}f", c), F.lit("n/a"))


def needs_treatment(code: Column) -> Column:
    return ~F.endswith(code, F.lit("_0"))


def relaxed(truth: Column, pred: Column, margin: int = 1) -> Column:
    """A prediction within the margin counts as right."""
    return F.when(F.abs(truth - pred) <= margin, truth).otherwise(pred)


def md5_order(seed: int, *ids: Column | str) -> Column:
    """A fixed pseudo-random order number of a row."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *ids).cast("binary")), 1, 7), 16, 10).cast("long")


def count_at_least(scores: Column, limit: float) -> Column:
    return F.size(F.filter(scores, lambda s: s >= limit))
