"""Column expressions for cleaning text, numbers and dates."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?\s*$"

# Text layouts tried, in this order, when a date is not ISO.
DATE_LAYOUTS = (
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^\d{4}/\d{1,2}$", "yyyy/M"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3}[ -]\d{4}$", "MMM[ ][-]yyyy"),
    (r"^[A-Za-z]{4,9} \d{4}$", "MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
)
SLASHED = r"^(\d{1,2})/(\d{1,2})/\d{4}$"  # day or month first, as the column has it


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- names ------------------------------------------------------------------

def header_name(name: str) -> str:
    """Snake-case form of one column header."""
    return re.sub(r"[^0-9A-Za-z]+", "_", str(name).strip()).strip("_").lower()


def safe_token(c: Column | str) -> Column:
    """Lower-case token of letters, digits and underscores; blank becomes 'unknown'."""
    text = F.coalesce(as_col(c).cast("string"), F.lit(""))
    token = F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(token == "", F.lit("unknown")).otherwise(token)


def predictor_token(c: Column | str) -> Column:
    """Like safe_token, but blank stays blank."""
    return F.lower(F.trim(F.regexp_replace(as_col(c), "[^0-9A-Za-z]+", "_"), F.lit("_")))


def feature_token(name: str) -> str:
    """Feature-name prefix for a series id."""
    return str(name).replace("::", "__").replace("/", "_").replace(" ", "_")


def feature_name(series_id: Column | str, lag: Column | str) -> Column:
    """'<safe series id>__lag<k>' for long feature tables."""
    sid = F.replace(F.replace(F.replace(as_col(series_id), F.lit("::"), F.lit("__")), F.lit("/"), F.lit("_")),
                    F.lit(" "), F.lit("_"))
    return F.concat(sid, F.lit("__lag"), as_col(lag).cast("string"))


def join_parts(sep: str, *parts: Column | str) -> Column:
    """Concatenate the parts that are neither NULL nor blank."""
    cols = F.array(*[as_col(p).cast("string") for p in parts])
    return F.array_join(F.filter(cols, lambda x: x.isNotNull() & (F.trim(x) != "")), sep)


def file_name(path: Column | str) -> Column:
    return F.url_decode(F.regexp_replace(F.element_at(F.split(as_col(path), "/"), -1), r"\+", "%2B"))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def file_suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def term_label(path: Column | str) -> Column:
    """Search-term label taken from an export's file name."""
    stem = file_stem(path)
    bare = F.trim(F.regexp_replace(F.regexp_replace(stem, r"(?i)^time[_-]series[_-]GB[_-]?", ""), "[_-]+", " "))
    return F.when(bare == "", stem).otherwise(bare)


def mapped_name(c: Column | str, renames: dict[str, str], prefix: str) -> Column:
    """Rename by a fixed map; names outside it become '<prefix>__<name>'."""
    fallback = F.concat(F.lit(prefix + "__"), as_col(c))
    if not renames:
        return fallback
    pairs = [F.lit(x) for kv in renames.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), as_col(c)), fallback)


# ---- numbers ----------------------------------------------------------------

def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = as_col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def to_number(c: Column | str) -> Column:
    """Text to double, thousands commas removed, anything else NULL."""
    text = F.replace(as_col(c).cast("string"), F.lit(","), F.lit(""))
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def to_count(c: Column | str) -> Column:
    """As to_number, and suppression stars are removed too."""
    return to_number(F.trim(F.translate(as_col(c).cast("string"), ",*", "")))


def log10_positive(c: Column | str) -> Column:
    return F.when(as_col(c) > 0, F.log10(as_col(c)))


def log1p_clipped(c: Column | str) -> Column:
    return F.log1p(F.when(as_col(c) < 0, F.lit(0.0)).otherwise(as_col(c)))


def expm1_clipped(c: Column | str) -> Column:
    grown = F.expm1(as_col(c))
    return F.when(grown < 0, F.lit(0.0)).otherwise(grown)


def clip01(c: Column | str) -> Column:
    return F.least(F.greatest(as_col(c), F.lit(0.0)), F.lit(1.0))


def zscore(x: Column | str, mean: Column | str, sd: Column | str) -> Column:
    """Descriptive z-score: NULL where the deviation is missing or zero."""
    sd = as_col(sd)
    return F.when(sd > 0, (as_col(x) - as_col(mean)) / sd)


def train_scale(sd: Column | str) -> Column:
    """Train-window deviation: missing or zero becomes one."""
    sd = as_col(sd)
    return F.when(sd > 0, sd).otherwise(F.lit(1.0))


# ---- dates ------------------------------------------------------------------

def only_day_first(c: Column | str) -> Column:
    """Whether a slashed date can only have its day first; one such value decides for its column."""
    return F.coalesce(F.regexp_extract(F.trim(as_col(c).cast("string")), SLASHED, 1).try_cast("int") > 12, F.lit(False))


def to_day(c: Column | str, layout: str | None = None, day_first: Column | bool = False) -> Column:
    """Text to date. Without a layout: ISO first, then DATE_LAYOUTS; bare numbers are never dates.

    Months without a day are their first day. In slashed dates the month comes first unless day_first says otherwise or the
    numbers rule it out.
    """
    text = F.trim(as_col(c).cast("string"))
    if layout:
        return F.to_date(F.try_to_timestamp(text, F.lit(layout)))
    tries = [F.when(text.rlike(ISO_DATE), F.to_date(text.try_cast("timestamp")))]
    tries += [F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(fmt)))) for shape, fmt in DATE_LAYOUTS]
    month, day = (F.to_date(F.try_to_timestamp(text, F.lit(fmt))) for fmt in ("M/d/yyyy", "d/M/yyyy"))
    order = day_first if isinstance(day_first, Column) else F.lit(day_first)
    tries.append(F.when(text.rlike(SLASHED), F.when(order, F.coalesce(day, month)).otherwise(F.coalesce(month, day))))
    return F.coalesce(*tries)


def from_yyyymmdd(c: Column | str) -> Column:
    """Compact dates: a trailing '.0' is dropped and the text is padded to eight digits."""
    text = F.regexp_replace(F.trim(as_col(c).cast("string")), r"\.0$", "")
    return F.to_date(F.try_to_timestamp(F.lpad(text, 8, "0"), F.lit("yyyyMMdd")))


def year_start(c: Column | str) -> Column:
    """1 January of a year in 1..9999; other years NULL."""
    y = as_col(c).cast("string").try_cast("int")
    return F.when(y.between(1, 9999), F.make_date(y, F.lit(1), F.lit(1)))


def is_monthly(freq: str) -> bool:
    return freq.upper().startswith("M")


def period(c: Column | str, freq: str = "W") -> Column:
    """Start of the week (Monday) or month as a date; 'D' keeps the day."""
    if freq.upper().startswith("D"):
        return F.to_date(as_col(c))
    return F.date_trunc("month" if is_monthly(freq) else "week", as_col(c)).cast("date")


def step_period(start: Column | str, steps: Column | str, freq: str = "W") -> Column:
    """The period that many steps after start."""
    start, steps = as_col(start), as_col(steps).cast("int")
    if is_monthly(freq):
        return F.to_date(F.add_months(F.date_trunc("month", start).cast("date"), steps))
    return F.date_add(start, steps * (1 if freq.upper().startswith("D") else 7))


# ---- bands ------------------------------------------------------------------

def severity_band(score: Column | str, cutpoints: Sequence[float] = (0.25, 1.0, 2.0)) -> Column:
    low, mid, high = cutpoints
    s = as_col(score)
    return (F.when(s >= high, "severe").when(s >= mid, "moderate").when(s >= low, "mild")
            .when(s > 0, "borderline").otherwise("none"))


def risk_band(p: Column | str, expected: Column | str) -> Column:
    p, e = as_col(p), as_col(expected)
    return (F.when((p >= 0.35) | (e >= 50), "very high").when((p >= 0.15) | (e >= 20), "high")
            .when((p >= 0.05) | (e >= 5), "moderate").otherwise("low"))


def missing_status(fraction: Column | str) -> Column:
    f = F.coalesce(as_col(fraction), F.lit(0.0))
    return F.when(f > 0.5, "failed").when(f > 0.1, "warning").otherwise("passed")


def missing_notes(fraction: Column | str) -> Column:
    f = F.coalesce(as_col(fraction), F.lit(0.0))
    return F.when(f > 0.1, F.concat(F.round(f * 100, 0).cast("int").cast("string"), F.lit("% of values are missing."))
                  ).otherwise("No heuristic anomalies detected.")
