"""Words one edit apart and their commoner forms against comparisons of every two words."""
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epitide.llm import queries, variants
from epitide.llm.common import table


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=2):
    near = {w: [] for w in counts}
    words = sorted(counts)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for a in words:
        for k in (len(a), len(a) + 1):
            for b in by_length.get(k, []):
                if (k > len(a) or a < b) and one_edit(a, b):
                    near[a].append(b)
                    near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def as_rows(frame):
    rows = frame.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), max_size=25))
def test_scan_finds_every_pair_once(words):
    listed = sorted(words)
    want = [(i, j) for i in range(len(listed)) for j in range(i + 1, len(listed)) if one_edit(listed[i], listed[j])]
    assert sorted(variants.scan(listed)) == want


@pytest.mark.parametrize("group_words", [2, 8, 512])
def test_crowded_vocabulary(spark, group_words):
    draw = random.Random(5)
    words = {"".join(draw.choices("abcdé", k=draw.randint(5, 8))) for _ in range(300)}
    words |= {"prefix" + "".join(draw.choices("ab", k=draw.randint(1, 7))) for _ in range(150)}  # one front for a third of all
    words |= {w[:k] + draw.choice("xyz") + w[k + 1:] for w in list(words)[:100] for k in (0, 2, len(w) - 1)}
    counts = {w: draw.choice([3, 3, 4, 6, 12, 30, 100, 500]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert as_rows(variants.spelling_variants(frame, group_words=group_words)) == brute(counts)


def contract_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query_against_every_two_words(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    found = queries.QUERIES["op12_spelling_variants"](spark, sf)
    assert dict(found.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    assert as_rows(found) == brute(contract_counts(rows))


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "ÀÉÎÕü ÀÉÎÕü àéîõü", "Hello×hello÷HELLO ß", "don't DON'T", "word" * 9000, "the quick brown fox " * 4000,
                                          "ÀÉÎÕü", "hello " * 4, "hella hellb hellc " * 3])] * 2
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    assert {r["word"]: r["n"] for r in variants.word_counts(docs, respell=variants.slipped).collect()} == contract_counts(rows)
    assert as_rows(variants.spelling_variants(variants.word_counts(docs, respell=variants.slipped))) == brute(contract_counts(rows))


def test_rows_without_id_keep_their_words(spark):
    docs = spark.createDataFrame([(None, "plain words plain words plain")], "doc_id bigint, text string")
    assert {tuple(r) for r in variants.word_counts(docs, respell=variants.slipped).collect()} == {("plain", 3)}


def test_chains_lead_to_the_last_form(spark):
    rows = [(f"aaaaa{'b' * i}", 3 * 2 ** i) for i in range(9)]
    found = variants.spelling_variants(spark.createDataFrame(rows, "word string, n bigint"))
    assert {r["root"] for r in found.collect()} == {"aaaaabbbbbbbb"}


def test_empty_table(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0
    assert variants.word_counts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
