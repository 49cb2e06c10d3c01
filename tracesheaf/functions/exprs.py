"""Column expressions: names, keys, labels, thresholds, units."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fov_name(pos_name: Column, p: Column) -> Column:
    """``<pos_name>_p<p>``, the name defaulting to ``pos_`` and four digits."""
    return F.concat(F.coalesce(pos_name, F.concat(F.lit("pos_"), F.lpad(p.cast("string"), 4, "0"))), F.lit("_p"), p.cast("string"))


def well_name(fov: Column) -> Column:
    """what stands before the first underscore."""
    return F.substring_index(fov, "_", 1)


def condition_key(c1: Column, c2: Column) -> Column:
    """F8: both conditions, the one that is there, or ``NoCondition``; empty text counts as missing."""
    both = F.concat_ws("_", F.nullif(c1, F.lit("")), F.nullif(c2, F.lit("")))
    return F.coalesce(F.nullif(both, F.lit("")), F.lit("NoCondition"))


def threshold_spikes(spikes: Column, threshold: Column, raw: bool = False) -> Column:
    """spikes above the threshold, others 0; null without spikes or threshold; ``raw`` passes them through."""
    return spikes if raw else F.when(threshold.isNotNull(), F.transform(spikes, lambda v: F.when(v > threshold, v).otherwise(0.0)))


def cell_area(n_pixels: Column, pixel_size: Column) -> Column:
    """F16: pixels times pixel size squared; in pixels where the size is unknown or 0."""
    return F.when(F.coalesce(pixel_size, F.lit(0.0)) == 0, n_pixels.cast("double")).otherwise(n_pixels * pixel_size * pixel_size)


def area_unit(pixel_size: Column) -> Column:
    """The unit text of recorded results: ``µm`` whenever a size is given, even 0."""
    return F.when(pixel_size.isNotNull(), "µm").otherwise("pixel")


def display_condition(key: Column) -> Column:
    """an evoked key without its stimulus tag and pulse length."""
    bare = F.regexp_replace(key, "_evk_(non_)?stim", "")
    return F.when(F.contains(key, F.lit("_evk_")), F.regexp_replace(bare, "_[^_]*$", "")).otherwise(key)


def numeric_intensity(key: Column, index: int) -> Column:
    """the first number in the index-th underscore token (negative: from the end); infinity if none."""
    parts = F.split(key, "_")
    at = F.lit(index) if index >= 0 else F.size(parts) + index
    return F.coalesce(F.regexp_extract(F.coalesce(F.get(parts, at), F.lit("")), r"(\d+\.?\d*)", 1).try_cast("double"), F.lit(float("inf")))


def leading_number(text: Column) -> Column:
    """The number a text starts with; an error where there is none."""
    got = F.regexp_extract(text, r"^\s*(\d+\.?\d*)", 1).try_cast("double")
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit("no leading number in "), text)).cast("double"))


def condition_tag(key: Column) -> Column:
    """an evoked key without its last two tokens."""
    parts = F.split(key, "_")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def seconds(frame: Column, total_seconds: Column, n_frames: Column) -> Column:
    """frame to seconds by the whole seconds of the mean recording time."""
    return frame * F.floor(total_seconds) / n_frames


_NUMBER = r"([-+]?\d+(?:\.\d+)?)"
_TIMES = r"\s*\*\s*"


def _signed(text: str) -> float:
    return float(re.sub(r"\s+", "", text))


def led_power(equation: str | None, x: Column) -> Column:
    """power from percent by one of five forms (linear, quadratic, exponential, power, logarithm); otherwise the percent itself.

    Coefficients must be written out; only the start of the text has to match. It is compiled to a column expression once.
    """
    text, plus = (equation or "").strip(), r"\s*([-+]\s*\d+(?:\.\d+)?)"
    x = x.cast("double")
    forms = [
        (rf"y\s*=\s*{_NUMBER}{_TIMES}x\s*(?:\^|\*\*)\s*2{plus}{_TIMES}x{plus}", lambda a, b, c: a * x * x + b * x + c),
        (rf"y\s*=\s*{_NUMBER}{_TIMES}exp\(\s*{_NUMBER}{_TIMES}x\s*\){plus}", lambda a, b, c: a * F.exp(b * x) + c),
        (rf"y\s*=\s*{_NUMBER}{_TIMES}x\s*(?:\^|\*\*)\s*{_NUMBER}{plus}", lambda a, b, c: a * F.pow(x, F.lit(b)) + c),
        (rf"y\s*=\s*{_NUMBER}{_TIMES}log\(\s*x\s*\){plus}", lambda a, b: a * F.log(x) + b),
        (rf"y\s*=\s*{_NUMBER}{_TIMES}x{plus}", lambda a, b: a * x + b),
    ]
    for pattern, form in forms:
        if m := re.match(pattern, text):
            return form(*map(_signed, m.groups()))
    return x


def power_label(power: Column, equation: str | None, pulse: Column | None = None) -> Column:
    """``1.234mW/cm²`` after an equation, else ``5%``; then the pulse length, ``unknown`` by default."""
    if (equation or "").strip():
        text = F.format_string("%.3fmW/cm²", led_power(equation, power))
    else:
        text = F.concat(power.cast("string"), F.lit("%"))
    return text if pulse is None else F.concat_ws("_", text, F.coalesce(pulse, F.lit("unknown")))


def axis_unit(key: Column) -> Column:
    """the unit on an evoked axis."""
    return F.when(F.contains(key, F.lit("mW/cm²")), "mW/cm²").otherwise("%")


def tick_label(key: Column) -> Column:
    """the tick of a power label, its unit and pulse length removed."""
    return F.regexp_replace(F.substring_index(key, "_", 1), "mW/cm²|%", "")


def pulse_of(key: Column) -> Column:
    return F.get(F.split(key, "_"), F.lit(1))


def parse_selection(text: Column) -> Column:
    """``0-3, 7`` as a sorted array of distinct ints; parts that are not numbers or ranges are ignored."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s))
    good = F.filter(parts, lambda s: F.rlike(s, F.lit(r"^\d{1,9}(\s*-\s*\d{1,9})?$")))

    def span(s: Column) -> Column:
        lo, hi = F.trim(F.substring_index(s, "-", 1)).cast("int"), F.trim(F.substring_index(s, "-", -1)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(good, span))))
