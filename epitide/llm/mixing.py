"""Mixing sources to target weights: raking of token weights to margins, then sampling by calibrated probabilities."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import join_counted

TEMPERATURE = 0.7  # targets are the shares of tokens raised to this power, so that small sources and languages gain
BUDGET = 0.8  # expected share of the tokens that stays
ROUNDS, TOLERANCE = 30, 1e-4
WHOLE = 1e9  # factor of a value that is drawn whole
TOPICS = (("table", r" \| "), ("marked", r"(!!|\$\$\$|%%%|###|&&&|\*\*\*)"), ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]|[0-9]{4}"))
OTHER_TOPIC = "prose"


def topic_of(text: Column) -> Column:
    """The first pattern of TOPICS that a text has, or prose."""
    out = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Blanks and line ends plus one; an empty text has no token."""
    gaps = F.length(text) - F.length(F.translate(text, " \n", ""))
    return F.when(F.length(text) == 0, 0).otherwise(gaps + 1).cast("long")


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
              row_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every row, and its key if it has one; null sources and languages read as ''."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"),
                       F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), topic_of(text).alias("topic"), tokens_of(text).alias("tokens"),
                       *([F.col(row_col)] if row_col else []))


def flattened(shares: dict[str, float], temperature: float) -> dict[str, float]:
    raised = {k: v**temperature if v > 0 else 0.0 for k, v in shares.items()}
    return {k: v / (sum(raised.values()) or 1.0) for k, v in raised.items()}


def margins(table: dict[tuple[str, str], float], lang: dict[str, float], topic: dict[str, float],
            b: dict[str, float], c: dict[str, float], rounds: int = 50) -> None:
    """Fits the factors b and c of a small table of languages and topics to its two margins, in place."""
    for _ in range(rounds):
        for factors, targets, axis, others in ((b, lang, 0, c), (c, topic, 1, b)):
            sums = dict.fromkeys(factors, 0.0)
            for key, value in table.items():
                sums[key[axis]] += value * others[key[1 - axis]]
            for k in factors:
                factors[k] = targets.get(k, 0.0) / sums[k] if sums[k] > 0 else 0.0


def with_factors(cells: DataFrame, b: dict[str, float], c: dict[str, float]) -> DataFrame:
    """Cells with of_lang and of_topic. The factors are rows, not literals, so that the plan of every round runs the same compiled code."""
    pairs = [(g, k, float(u), float(v)) for g, u in b.items() for k, v in c.items()]
    names = ("lang", "topic", "of_lang", "of_topic")
    columns = zip(*pairs, strict=True) if pairs else ([],) * 4
    kinds = (pa.string(), pa.string(), pa.float64(), pa.float64())
    table = pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)
    return cells.join(cells.sparkSession.createDataFrame(table), ["lang", "topic"])


def source_factors(cells: DataFrame, b: dict[str, float], c: dict[str, float]) -> DataFrame:
    """The factor of every source that brings it to its target, given those of languages and topics."""
    rows = with_factors(cells, b, c).withColumn("other", F.col("of_lang") * F.col("of_topic")).drop("of_lang", "of_topic")
    return rows.join(
        rows.groupBy("source").agg(F.sum(F.col("share") * F.col("other")).alias("now"), F.max("target").alias("aim")).select(
            "source", F.when(F.col("now") > 0, F.col("aim") / F.col("now")).otherwise(0.0).alias("factor")), "source")


def rake(docs: DataFrame, temperature: float = TEMPERATURE, lang_target: dict | None = None, topic_target: dict | None = None,
         source_target: DataFrame | None = None) -> DataFrame:
    """Cells (source, lang, topic, tokens, share) with multiplier: raked share over share.

    docs: source, lang, topic, tokens. Sources stay a distributed table; only sums by language and topic, a table that does not
    grow with the documents, come to the driver between rounds.
    """
    return _raked(docs, temperature, lang_target, topic_target, source_target)[0].drop("target")


def _raked(docs: DataFrame, temperature: float, lang_target: dict | None, topic_target: dict | None,
           source_target: DataFrame | None) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """The cells of rake(), with the target of their source, and the targets of languages and topics."""
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    cells = stage(cells, "mix-cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    pairs = {(r[0], r[1]): r[2] / total for r in cells.groupBy("lang", "topic").agg(F.sum("tokens")).collect()}
    lang, topic = ({} for _ in range(2))
    for (g, k), v in pairs.items():
        lang[g], topic[k] = lang.get(g, 0.0) + v, topic.get(k, 0.0) + v
    lang_aim, topic_aim = (_restricted(given, own, temperature) for given, own in ((lang_target, lang), (topic_target, topic)))
    sources = cells.groupBy("source").agg(F.pow(F.sum("tokens") / F.lit(float(total or 1)), F.lit(temperature)).alias("raised"))
    if source_target is not None:
        given = source_target.select(F.coalesce("source", F.lit("")).alias("source"), "weight").groupBy("source").agg(F.sum("weight").alias("given"))
        sources = sources.join(given, "source", "left").select("source", F.coalesce("given", F.lit(0.0)).cast("double").alias("raised"))
    raised = sources.agg(F.sum("raised")).first()[0] or 1.0
    cells = stage(cells.join(sources, "source").select("source", "lang", "topic", "tokens", (F.col("tokens") / F.lit(float(total or 1))).alias("share"),
                                                       (F.col("raised") / F.lit(raised)).alias("target")), "mix-shares")
    b, c = dict.fromkeys(lang, 1.0), dict.fromkeys(topic, 1.0)
    if not pairs:
        return cells.withColumn("multiplier", F.lit(1.0)), lang_aim, topic_aim
    for _ in range(ROUNDS):
        before = dict(b), dict(c)
        sums = source_factors(cells, b, c).groupBy("lang", "topic").agg(F.sum(F.col("share") * F.col("factor"))).collect()
        margins({(r[0], r[1]): r[2] for r in sums}, lang_aim, topic_aim, b, c)
        scale = max(b.values()) or 1.0  # only products count; keep the factors of languages at 1 at most
        b.update({k: v / scale for k, v in b.items()})
        c.update({k: v * scale for k, v in c.items()})
        if max(abs(new[k] - old[k]) / max(abs(old[k]), 1e-12) for new, old in zip((b, c), before, strict=True) for k in new) < TOLERANCE:
            break
    return source_factors(cells, b, c).select("source", "lang", "topic", "tokens", "share", "target",
                                              (F.col("factor") * F.col("other")).alias("multiplier")), lang_aim, topic_aim


def _restricted(given: dict | None, own: dict[str, float], temperature: float) -> dict[str, float]:
    """A target over the values that occur; what is given for others is shared out."""
    if given is None:
        return flattened(own, temperature)
    return flattened({k: given.get(k, 0.0) for k in own}, 1.0)


def reachable(aims: dict[str, float], shares: dict[str, float], budget: float) -> dict[str, float]:
    """Shares of all tokens to draw: the budget dealt out by the targets, but no value gets more than it has; others get what is over."""
    want, over = {}, dict(aims)
    while over:
        rest, weight = budget - sum(want.values()), sum(over.values())
        full = [k for k, v in over.items() if weight and rest * v / weight >= shares[k]]
        if not full:
            return want | {k: rest * v / weight if weight else 0.0 for k, v in over.items()}
        want |= {k: shares[k] for k in full}
        over = {k: v for k, v in over.items() if k not in want}
    return want


def source_wants(cells: DataFrame, budget: float) -> DataFrame:
    """source, want: reachable() for the sources, which stay a distributed table."""
    sources = stage(cells.groupBy("source").agg(F.sum("share").alias("own"), F.max("target").alias("aim")), "mix-sources")
    scale, before = budget, -1
    while True:
        full = F.col("own") <= F.lit(scale) * F.col("aim")
        r = sources.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("own"))), F.sum(F.when(~full, F.col("aim")))).first()
        if (r[0] or 0) == before or not r[2]:
            return sources.select("source", F.least(F.col("own"), F.lit(scale) * F.col("aim")).alias("want"))
        scale, before = max(scale, (budget - (r[1] or 0.0)) / r[2]), r[0]


def bounded(cells: DataFrame, b: dict[str, float], c: dict[str, float]) -> DataFrame:
    """Cells with the probability that draws from every source what is wanted of it: one factor for a source, at most 1 for a cell.

    With the cells of a source by falling weight, those before some cell are drawn whole and the others in proportion to their weights.
    """
    ranked = Window.partitionBy("source").orderBy(F.desc("weight"), "lang", "topic")
    rows = with_factors(cells, b, c).withColumn("weight", F.col("multiplier") * F.col("of_lang") * F.col("of_topic")).drop("of_lang", "of_topic").withColumns({
        "whole": F.coalesce(F.sum("share").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum(F.col("share") * F.col("weight")).over(ranked.rowsBetween(0, Window.unboundedFollowing))})
    factor = F.when(F.col("rest") > 0, (F.col("want") - F.col("whole")) / F.col("rest"))
    rows = rows.withColumn("factor", F.when((factor >= 0) & (factor * F.col("weight") <= 1 + 1e-9), factor)).withColumn(
        "factor", F.min_by("factor", F.when(F.col("factor").isNotNull(), -F.col("weight"))).over(Window.partitionBy("source")))
    chance = F.when(F.col("weight") > 0, F.coalesce(F.least(F.lit(1.0), F.col("factor") * F.col("weight")), F.lit(1.0))).otherwise(0.0)
    return rows.withColumn("probability", chance).drop("weight", "whole", "rest", "factor")


def probabilities(cells: DataFrame, lang_aim: dict[str, float], topic_aim: dict[str, float], budget: float | None = BUDGET) -> DataFrame:
    """Cells with probability, at most 1, whose expected tokens meet the budget and the targets of all three margins.

    The bound holds within the raking: a cell at 1 stays there and the others make up for it. No document is drawn twice, so a value
    gets at most the tokens it has; what its target asks beyond them goes to the other values of its margin (see achieved()).
    Without a budget the largest is taken at which no single target asks for more than its value has.
    """
    pairs = {(r[0], r[1]): r[2] for r in cells.groupBy("lang", "topic").agg(F.sum("share")).collect()}
    if not pairs:
        return cells.withColumn("probability", F.lit(0.0))
    shares = dict.fromkeys(lang_aim, 0.0), dict.fromkeys(topic_aim, 0.0)
    for key, v in pairs.items():
        for axis in (0, 1):
            shares[axis][key[axis]] += v
    if budget is None:
        sources = cells.groupBy("source").agg((F.sum("share") / F.max(F.when(F.col("target") > 0, F.col("target")))).alias("most")).agg(F.min("most")).first()[0]
        budget = min([1.0, sources or 1.0, *[own[k] / v for own, aims in zip(shares, (lang_aim, topic_aim), strict=True) for k, v in aims.items() if v > 0]])
    wants = [reachable(aims, own, budget) for aims, own in zip((lang_aim, topic_aim), shares, strict=True)]
    cells = stage(cells.join(source_wants(cells, budget), "source"), "mix-wants")
    # what a value must give whole is drawn whole from the start
    factors = tuple({k: WHOLE if 0 < own[k] <= v * (1 + 1e-9) else 1.0 for k, v in want.items()} for want, own in zip(wants, shares, strict=True))
    for _ in range(ROUNDS):
        at_most = F.col("probability") >= 1 - 1e-9
        drawn = F.col("share") * F.col("probability")
        sums = {(r[0], r[1]): (r[2] or 0.0, r[3] or 0.0) for r in bounded(cells, *factors).groupBy("lang", "topic").agg(
            F.sum(F.when(at_most, drawn)), F.sum(F.when(~at_most, drawn))).collect()}
        gaps = [abs(sum(w + f for key, (w, f) in sums.items() if key[axis] == k) - v) for axis in (0, 1) for k, v in wants[axis].items()]
        if max(gaps) < TOLERANCE * budget:
            break
        steps = dict.fromkeys(factors[0], 1.0), dict.fromkeys(factors[1], 1.0)
        for _ in range(50):
            for axis, want in enumerate(wants):
                for k, v in want.items():
                    own = [(w, f * steps[1 - axis][key[1 - axis]]) for key, (w, f) in sums.items() if key[axis] == k]
                    whole, free = sum(w for w, _ in own), sum(f for _, f in own)
                    step = (v - whole) / free if free > 0 and v > whole else v / (whole + free) if whole + free > 0 else 1.0
                    steps[axis][k] = min(max(step, 0.1), 10.0) if v > 0 else 0.0
        for own, step in zip(factors, steps, strict=True):
            own.update({k: (own[k] if own[k] == WHOLE else min(max(own[k] * v, 1 / WHOLE), WHOLE)) if v else 0.0 for k, v in step.items()})
    return bounded(cells, *factors)


def achieved(docs: DataFrame, budget: float = BUDGET, temperature: float = TEMPERATURE, lang_target: dict | None = None, topic_target: dict | None = None,
             source_target: DataFrame | None = None, **columns: str) -> DataFrame:
    """margin, value, share (of all tokens), target, most (the largest share that can be drawn without repeating a document), expected
    (the share of the drawn tokens) of every source, language and topic."""
    cells, lang_aim, topic_aim = _raked(described(docs, **columns), temperature, lang_target, topic_target, source_target)
    cells = stage(probabilities(cells, lang_aim, topic_aim, budget), "mix-achieved")
    drawn = F.col("share") * F.col("probability")
    total = cells.agg(F.sum(drawn)).first()[0] or 1.0
    out = None
    for margin, aims in (("source", None), ("lang", lang_aim), ("topic", topic_aim)):
        target = F.max("target") if aims is None else F.max(F.create_map(*[x for k, v in (aims or {"": 0.0}).items() for x in (F.lit(k), F.lit(float(v)))])[F.col(margin)])
        rows = cells.groupBy(margin).agg(F.sum("share").alias("share"), target.alias("target"), (F.sum(drawn) / F.lit(total)).alias("expected")).select(
            F.lit(margin).alias("margin"), F.col(margin).alias("value"), "share", "target", F.least(F.lit(1.0), F.col("share") / F.lit(budget)).alias("most"), "expected")
        out = rows if out is None else out.unionByName(rows)
    return out


def mix(docs: DataFrame, budget: float | None = BUDGET, temperature: float = TEMPERATURE, lang_target: dict | None = None, topic_target: dict | None = None,
        source_target: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", row_col: str | None = None) -> DataFrame:
    """Every row with the weight of its cell, its probability and whether it is drawn.

    Returns doc_id, source, lang, topic, tokens, multiplier (of the raking without a bound), probability, kept. source_target holds
    source and weight. A draw depends on doc_id alone, so repeated rows
    share it; rows without an id share one draw. Rows without tokens are never drawn (probability 0). Null sources and languages
    are values of their own. An empty table gives no rows; other columns are ignored, but a key of the rows, row_col, is kept.
    """
    rows = stage(described(docs, id_col, text_col, source_col, lang_col, row_col), "mix-rows")
    cells = stage(probabilities(*_raked(rows, temperature, lang_target, topic_target, source_target), budget).select(
        "source", "lang", "topic", "multiplier", "probability"), "mix-weights")
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 11).cast("double") + 0.5) / float(1 << 53)
    return join_counted(rows, cells, ["source", "lang", "topic"], "left").select(
        *([row_col] if row_col else []), "doc_id", "source", "lang", "topic", "tokens", F.coalesce("multiplier", F.lit(0.0)).alias("multiplier"),
        F.coalesce("probability", F.lit(0.0)).alias("probability")).withColumn("kept", (F.col("tokens") > 0) & (draw < F.col("probability")))
