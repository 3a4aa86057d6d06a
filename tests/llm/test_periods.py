"""Periodic runs against comparisons of all words at all lags."""
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epitide.llm import periods, queries
from epitide.llm.common import table


def brute(w, least=12):
    """All maximal stretches of each lag, without those that have a smaller period."""
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                run = w[i:j + q]
                if not any(all(run[k] == run[k + p] for k in range(len(run) - p)) for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def collapsed(w, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.integers(0, 40))
def test_lag_scan_finds_all_runs(words, period, more):
    tail = [words[i % min(period, len(words))] for i in range(more)] if words else []
    w = words + tail + words[::-1][:11]
    assert periods.lag_scan(np.array(w, np.int64)) == brute(w)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=50), max_size=4))
def test_splitting_loses_no_run(docs):
    codes = np.array([x for d in docs for x in d], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    segments = periods.surviving(codes, bounds)
    for d, lo in zip(docs, bounds):
        for start, length, _ in brute(d):
            assert any(a <= lo + start and lo + start + length <= b for a, b in segments)
    for a, b in segments:
        assert b - a >= 12 and np.unique(codes[a:b], return_counts=True)[1].min() >= 2


ODD = [None, "", " \t\n ", "one", "a " * 500, "a b " * 300 + "c", " ".join(["x y z"] * 4), " ".join(["x y z"] * 3), "p q r s t u v p q r s t u v p",
       "A a " * 8, " ".join(str(i % 7) for i in range(40)) + " " + " ".join(str(i % 3) for i in range(30)), " ".join(map(str, range(3000))) + " " + " ".join(map(str, range(3000))),
       "é é " * 12, "x\x0by\x0cz " * 6, "same same " * 9, "same same " * 9]


def test_odd_texts(spark):
    rows = [(i, t, [1]) for i, t in enumerate(ODD)] + [(None, "k " * 20, [1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs array<int>")
    found = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["kept"]) for r in periods.periodic_runs(docs.repartition(3)).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        w = split(text)
        want = brute(w) if len(w) < 2000 else [(0, 6000, 3000)]
        assert found[i] == (want, collapsed(w, want))


def test_very_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "w " * 200_000), (2, "u v w " * 60_000)], "doc_id bigint, text string")
    found = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["kept"]) for r in periods.periodic_runs(docs).collect()}
    assert found == {1: ([(0, 200_000, 1)], "w"), 2: ([(0, 180_000, 3)], "u v w")}


def test_query_against_all_lags(spark, sf):
    want = {}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        w = planted(r["doc_id"], split(r["text"]))
        if len(w) > 3000:
            continue
        runs = brute(w)
        longest = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        want[r["doc_id"]] = (len(runs), *longest, 1000 * longest[1] // longest[2] if runs else None, digest,
                             hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = queries.QUERIES["op13_word_runs"](spark, sf)
    assert [t for c, t in found.dtypes if c in names[:5]] == ["bigint"] * 5
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in found.collect()}
    assert {k: got[k] for k in want} == want and sum(v[0] > 0 for v in want.values()) > 5


def test_short_runs_are_refused(spark):
    with pytest.raises(ValueError):
        periods.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string"), least=5)


def test_empty_table(spark):
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string"), periods.planted_tail).count() == 0
