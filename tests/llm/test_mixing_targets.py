"""Draws meet the targets of sources, languages and topics, as far as no document is drawn twice."""
import numpy as np
import pytest

from epitide.llm import mixing


@pytest.fixture(scope="module")
def uneven(spark):
    """A hot source and small ones, with uneven languages and topics."""
    rng = np.random.default_rng(5)
    words = {"prose": "plain words", "table": "a | b", "contact": "me@x now"}
    made = []
    for k in range(4000):
        source = rng.choice(["hot", *[f"s{j}" for j in range(6)]], p=[0.7] + [0.05] * 6)
        lang = rng.choice(["en", "de", "es"], p=[0.7, 0.25, 0.05] if source == "hot" else [0.3, 0.5, 0.2])
        made.append((k, f"{words[rng.choice(list(words), p=[0.8, 0.05, 0.15])]} " + "x " * int(rng.integers(5, 60)), str(lang), str(source)))
    return spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string")


@pytest.mark.parametrize("budget", [0.8, 0.4, None])
def test_drawn_tokens_meet_the_targets(uneven, budget):
    drawn = mixing.mix(uneven, budget).toPandas()
    mass, total = drawn.tokens * drawn.probability, drawn.tokens.sum()
    assert drawn.probability.between(0, 1).all() and (budget is None or abs(mass.sum() / total - budget) < 1e-3)
    spent = mass.sum() / total
    for margin in ("source", "lang", "topic"):
        share = drawn.groupby(margin).tokens.sum() / total
        aim = (share**mixing.TEMPERATURE / (share**mixing.TEMPERATURE).sum()).to_dict()
        want = mixing.reachable(aim, share.to_dict(), spent)
        got = (mass.groupby(drawn[margin]).sum() / total).to_dict()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-3 * spent + 1e-4, margin
        if budget != 0.8:
            assert max(abs(got[k] / spent - aim[k]) for k in aim) < 2e-3, margin


def test_a_table_of_source_targets(spark, uneven):
    aim = {"hot": 0.3, "s0": 0.1, **{f"s{j}": 0.12 for j in range(1, 6)}}
    table = spark.createDataFrame(list(aim.items()), "source string, weight double")
    got = {r["value"]: r for r in mixing.achieved(uneven, 0.3, source_target=table).filter("margin = 'source'").collect()}
    assert all(abs(got[k]["expected"] - v) < 2e-3 and abs(got[k]["target"] - v) < 1e-9 for k, v in aim.items())
