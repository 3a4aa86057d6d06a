"""Risk scoring of a table of events.

An event row has: event_id, event_name, pathogen, attendance, duration_hours, indoor and the six level
columns; its context has prevalence, reproduction_number, attendance_probability_if_infectious,
dispersion_k and regional_expected_transmissions, as columns of the same row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import scalars as S

# Log-scale weight of each level of each factor; levels not listed weigh nothing.
LEVEL_WEIGHTS = {
    "crowding": {"low": -0.15, "medium": 0.25, "high": 0.70},
    "ventilation": {"good": -0.45, "medium": 0.20, "poor": 0.80, "low": 0.80, "high": -0.45},
    "vocalisation": {"low": 0.0, "medium": 0.30, "high": 0.70},
    "alcohol": {"low": 0.0, "medium": 0.15, "high": 0.35},
    "travel_mixing": {"low": 0.0, "medium": 0.20, "high": 0.45},
    "mitigation": {"low": 0.0, "medium": -0.35, "high": -0.70},
}
# Weights of place and of hours beyond a bound; the cap of the amplification; normal quantiles.
INDOOR, OUTDOOR = 0.60, -0.25
LONG, MIDDLE, SHORT = (8, 0.60), (4, 0.30), (1, -0.15)
TAF_CAP = 25.0
Z_99, Z_95 = 2.3263478740408408, 1.6448536269514722


def level_weight(kind: str, level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LEVEL_WEIGHTS[kind].items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.trim(level))), F.lit(0.0))


def duration_weight(hours: Column) -> Column:
    return (F.when(hours > LONG[0], LONG[1]).when(hours > MIDDLE[0], MIDDLE[1])
            .when(hours < SHORT[0], SHORT[1]).otherwise(0.0))


def factor_columns() -> dict[str, Column]:
    """Each factor's contribution to the log amplification, in a fixed order."""
    out = {"indoor": F.when(F.col("indoor"), INDOOR).otherwise(OUTDOOR)}
    for kind in LEVEL_WEIGHTS:
        out[kind] = level_weight(kind, F.col(f"{kind}_level"))
    out["duration"] = duration_weight(F.col("duration_hours"))
    return out


def names_by_weight(weights: dict[str, Column], positive: bool, size: int, fallback: str) -> Column:
    """Names of the strongest factors of one sign, strongest first; ties keep the factors' order."""
    entries = [F.when((w > 0) if positive else (w < 0), F.struct((-F.abs(w)).alias("k"), F.lit(i).alias("i"),
                                                                F.lit(name.replace("_", " ")).alias("name")))
               for i, (name, w) in enumerate(weights.items())]
    names = F.slice(F.sort_array(F.array_compact(F.array(*entries))), 1, size)["name"]
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(fallback)


def high_quantile(mean: Column, z: float = Z_99) -> Column:
    """Normal approximation of a high Poisson quantile, at least one."""
    return F.when(mean <= 0, 1.0).otherwise(F.greatest(F.lit(1.0), mean + F.lit(z) * F.sqrt(mean) + 0.5))


def amplification(events: DataFrame) -> DataFrame:
    """Adds factors, log amplification, TAF, expected infectious attendees, threshold and explanation."""
    named = factor_columns()
    weighed = events.select("*", *[w.alias(f"_w_{name}") for name, w in named.items()])
    weights = {name: F.col(f"_w_{name}") for name in named}
    score = F.lit(0.0)
    for w in weights.values():
        score = score + w
    factors = F.create_map(*[x for name, w in weights.items() for x in (F.lit(name), w)])
    scored = (weighed.withColumn("factors", factors).withColumn("log_amplification", score)
              .withColumn("taf", F.least(F.exp("log_amplification"), F.lit(TAF_CAP)))
              .withColumn("expected_infectious_attendees",
                          F.col("attendance") * F.col("prevalence") * F.col("attendance_probability_if_infectious"))
              .withColumn("superspreading_threshold", high_quantile(
                  F.col("expected_infectious_attendees") * F.col("reproduction_number"))))
    text = F.format_string(
        "TAF is %.2f. Main amplifying factors: %s. Main reducing factors: %s. Context uses prevalence=%.4f, "
        "R_t=%.2f, dispersion k=%.2f.", F.col("taf"),
        names_by_weight(weights, True, 3, "baseline event conditions"), names_by_weight(weights, False, 2, "none"),
        F.col("prevalence"), F.col("reproduction_number"), F.col("dispersion_k"))
    return scored.withColumn("explanation", text).drop(*[f"_w_{name}" for name in named])


def validated(events: DataFrame) -> DataFrame:
    """Adds status and error: the first argument out of range, if any."""
    rules = [
        (F.col("attendance") < 0, "attendance must be non-negative"),
        (~F.col("prevalence").between(0, 1), "prevalence must be between 0 and 1"),
        (~F.col("attendance_probability_if_infectious").between(0, 1),
         "attendance_probability_if_infectious must be between 0 and 1"),
        (F.col("reproduction_number") < 0, "reproduction_number must be non-negative"),
        (F.col("dispersion_k") <= 0, "dispersion_k must be positive"),
    ]
    error = F.lit("")
    for broken, message in reversed(rules):
        error = F.when(broken, message).otherwise(error)
    return events.withColumn("error", error).withColumn("status", F.when(F.col("error") == "", "ok").otherwise("error"))


def moments(events: DataFrame) -> DataFrame:
    """Adds the mean and variance of the secondary infections of each scored event.

    The infectious attendees are binomial, and each of them infects a negative binomial number with the mean R x TAF and the
    dispersion k; so the total has these two moments in closed form.
    """
    q = F.least(F.col("prevalence") * F.col("attendance_probability_if_infectious"), F.lit(1.0))
    m = F.col("reproduction_number") * F.col("taf")
    people = F.col("attendance").cast("double") * q
    return events.withColumns({"expected_secondary_infections": people * m,
                               "variance_secondary_infections": people * (m + m * m / F.col("dispersion_k")) + people * (1 - q) * m * m})


def event_moments(events: DataFrame) -> DataFrame:
    """One risk row per event: moments, their normal tail beyond the threshold and quantiles (not below 0), band and regional index.

    Events with arguments out of range are error rows. Without spread the tail is whether the mean exceeds the threshold.
    """
    scored = moments(amplification(validated(events)))
    ok, mean, spread = F.col("status") == "ok", F.col("expected_secondary_infections"), F.sqrt("variance_secondary_infections")
    beyond = F.col("superspreading_threshold")
    tail = F.when(spread > 0, N.normal_sf(F.try_divide(beyond - mean, spread))).otherwise((mean > beyond).cast("double"))
    out = scored.withColumn("p_superspreading", F.when(ok, tail))
    region = F.col("regional_expected_transmissions")
    return out.select(
        "event_id", "event_name", "pathogen", "status", "error", "expected_infectious_attendees",
        F.col("taf").alias("transmission_amplification_factor"), F.when(ok, mean).alias("expected_secondary_infections"),
        F.when(ok, F.col("variance_secondary_infections")).alias("variance_secondary_infections"), "superspreading_threshold", "p_superspreading",
        *[F.when(ok, F.greatest(F.lit(0.0), mean + F.lit(z) * spread)).alias(f"secondary_infections_{name}")
          for name, z in (("p05", -Z_95), ("p50", 0.0), ("p95", Z_95))],
        F.when(ok, S.risk_band("p_superspreading", "expected_secondary_infections")).alias("risk_band"),
        F.when(ok & (region > 0), mean / region).alias("regional_contribution_index"), "explanation")
