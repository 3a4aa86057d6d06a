"""Near-duplicate documents: b-bit MinHash signatures joined by Hamming distance over several indexes, confirmed on full sets."""
from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import textops as T
from .common import arrow_map, join_counted, texts

SYMBOLS = 45  # of 16 bits each, that the indexes are made of
FINE_SYMBOLS = 91  # of 8 bits each, for a finer distance between candidates
LANES, LANE_BITS = 3, 21  # of a long, so that differing symbols can be counted by one addition
FINE_LANES, FINE_BITS = 7, 9
MISS = 1e-5  # probability that a pair at the threshold lies beyond the signature distance that the join guarantees
CHUNK_ERRORS = 1

_rng = np.random.default_rng(7)
FLIPS = _rng.integers(0, 2**63, SYMBOLS + FINE_SYMBOLS, dtype=np.uint64)
FACTORS = _rng.integers(0, 2**62, SYMBOLS + FINE_SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = _rng.integers(0, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = "doc_id bigint, n bigint, total bigint, parity bigint, signature array<bigint>, fine array<bigint>"


def distance_bound(similarity: float, symbols: int = SYMBOLS) -> int:
    """Differing symbols, of so many, that a pair of at least that similarity exceeds with a probability of at most MISS."""
    p, tail, d = 1 - similarity, 1.0, -1
    while tail > MISS and d < symbols:
        d += 1
        tail -= comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
    return d


def chunks(bound: int) -> list[list[int]]:
    """By pigeonhole, two signatures within the bound differ in at most CHUNK_ERRORS symbols of one of these chunks at least."""
    n = bound // (CHUNK_ERRORS + 1) + 1
    return [list(range(SYMBOLS))[k::n] for k in range(n)]


def shingle_sets(piece: T.Slice, size: int) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of every text; a text with fewer words is one shingle, one without words none."""
    begin, end = T.words(piece, T.NOT_SPACE)
    hashes, first = T.word_hashes(piece, begin, end), T.word_counts(piece, begin)
    joined = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for j in range(size):
        joined += hashes[j:j + len(joined)] * STEPS[j]
    joined = T.mix(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a:b - size + 1]))
        elif b > a:
            out.append(T.mix((hashes[a:b] * STEPS[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of every set, packed into longs: those of the indexes, and the fine ones. Sets lie end to end, none empty."""
    packed = np.zeros((len(starts), SYMBOLS // LANES), np.int64)
    fine = np.zeros((len(starts), FINE_SYMBOLS // FINE_LANES), np.int64)
    for k in range(SYMBOLS + FINE_SYMBOLS):
        least = T.mix(np.minimum.reduceat((sets ^ FLIPS[k]) * FACTORS[k], starts))
        if k < SYMBOLS:
            packed[:, k // LANES] |= (least & np.uint64(0xFFFF)).astype(np.int64) << (LANE_BITS * (k % LANES))
        else:
            j = k - SYMBOLS
            fine[:, j // FINE_LANES] |= (least & np.uint64(0xFF)).astype(np.int64) << (FINE_BITS * (j % FINE_LANES))
    return packed, fine


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), total and parity (a digest of the set), signature, fine; the last four null for an empty set."""
    def work(batch):
        for piece in T.slices(batch.column("text")):
            sets = shingle_sets(piece, size)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            columns = [[None] * len(n) for _ in range(4)]
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                starts = np.r_[0, np.cumsum(n[full])[:-1]]
                again = T.mix(every)
                totals, parities = np.add.reduceat(again, starts), np.bitwise_xor.reduceat(every * again, starts)
                found = (T.signed(totals), T.signed(parities), *signatures(every, starts))
                for i, *values in zip(full.tolist(), *[v.tolist() for v in found], strict=True):
                    for column, value in zip(columns, values, strict=True):
                        column[i] = value
            yield (batch.column("doc_id").slice(piece.lo, piece.hi - piece.lo), n, *columns)
    return arrow_map(docs, SKETCH, work)


def index_keys(sets: DataFrame, bound: int) -> DataFrame:
    """key, id: for every chunk each choice of the symbols that have to agree, the allowed errors left out."""
    parts = [(i, kept) for i, chunk in enumerate(chunks(bound)) for kept in combinations(chunk, max(1, len(chunk) - CHUNK_ERRORS))]
    ddl = "key bigint, id bigint"

    def work(batch):
        packed = np.asarray(batch.column("signature").values).reshape(batch.num_rows, -1).astype(np.uint64)
        symbols = np.stack([(packed[:, k // LANES] >> np.uint64(21 * (k % LANES))) & np.uint64(0xFFFF) for k in range(SYMBOLS)])
        keys = np.empty((batch.num_rows, len(parts)), np.uint64)
        for j, (chunk, kept) in enumerate(parts):
            key = np.full(batch.num_rows, chunk * SYMBOLS + kept[0], np.uint64)
            for k in kept:
                key = T.mix(key * np.uint64(T.BASE) + symbols[k] + np.uint64(k << 16))
            keys[:, j] = key
        yield (T.signed(keys.reshape(-1)), np.repeat(np.asarray(batch.column("id")), len(parts)))
    return arrow_map(sets.select("id", "signature"), ddl, work)


def distance(a: Column, b: Column, longs: int, lanes: int, bits: int) -> Column:
    """Symbols in which two packed signatures differ: an addition carries a bit out of every lane that is not zero."""
    carry = sum((2 ** (8 * (bits // 8)) - 1) << (bits * k) for k in range(lanes))
    mark = sum(2 ** (8 * (bits // 8)) << (bits * k) for k in range(lanes))
    out = F.lit(0)
    for i in range(longs):
        out = out + F.bit_count((a[i].bitwiseXOR(b[i]) + F.lit(carry)).bitwiseAND(F.lit(mark)))
    return out


def near(num: int, den: int, fine: bool = False) -> Column:
    """Whether two sets, as a and b, can be similar enough: by size, and by the symbols of the indexes or the fine ones."""
    sizes = F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num
    if fine:
        apart = distance(F.col("a.fine"), F.col("b.fine"), FINE_SYMBOLS // FINE_LANES, FINE_LANES, FINE_BITS)
        return sizes & (apart <= distance_bound(num / den, FINE_SYMBOLS))
    return sizes & (distance(F.col("a.signature"), F.col("b.signature"), SYMBOLS // LANES, LANES, LANE_BITS) <= distance_bound(num / den))


COMPARED = "a bigint, b bigint, common bigint, together bigint, extra array<bigint>, missing array<bigint>"


def compared(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) with how many shingles both share and have together, and which ones only a or only b has.

    The texts of the pairs come together, no others are moved.
    """
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    known = stage(join_counted(docs, needed, "doc_id"), "near-texts")
    both = pairs.join(known.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").join(
        known.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")

    def work(batch):
        for lo in range(0, batch.num_rows, 64):  # a few pairs at a time, whatever the batch holds
            part = batch.slice(lo, 64)
            sides = [[s for piece in T.slices(part.column(c)) for s in shingle_sets(piece, size)] for c in ("text_a", "text_b")]
            differ = [[np.setdiff1d(x, y, assume_unique=True) for x, y in zip(*order, strict=True)] for order in (sides, sides[::-1])]
            common = [len(x) - len(e) for x, e in zip(sides[0], differ[0], strict=True)]
            together = [len(y) + len(e) for y, e in zip(sides[1], differ[0], strict=True)]
            yield part.column("a"), part.column("b"), common, together, *[[T.signed(e).tolist() for e in side] for side in differ]
    return arrow_map(both.select("a", "b", "text_a", "text_b"), COMPARED, work)


def similar(compared_pairs: DataFrame, num: int, den: int) -> DataFrame:
    return compared_pairs.filter((F.col("common") * den >= F.col("together") * num) & (F.col("together") > 0)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of every linked id: labels spread over the links and jump to their own label's label."""
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = stage(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "near-labels")
    while True:
        reached = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("other"))
        spread = stage(labels.join(reached, F.col("id") == F.col("a")).select("id", F.least("label", "other").alias("label"), F.col("label").alias("old")), "near-spread")
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = stage(spread.join(jump, "label", "left").select("id", F.least("label", "further").alias("label"), "old"), "near-labels")
        labels = moved.select("id", "label")
        if moved.filter("label != old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group of near-duplicates: shingles of `size` words, linked at a Jaccard similarity of num / den or more.

    Returns doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id). Words are separated by
    blanks, tabs, line ends and feeds; A-Z is lower-cased. A text with fewer words is one shingle. Null and empty texts and texts
    without words are linked with nothing. Rows with the same id count as one document with several texts; a null id is linked
    with nothing but equal sets, of which it takes the component. An empty table gives no rows; other columns are ignored.

    Equal sets first become one class. A class is looked up under every key of its signature and compared with the most central
    class of each bucket, its hub. Two other members of a bucket are compared only if their components differ: by what sets them
    apart from the hub, if both were compared with it, and in full otherwise.
    """
    rows = texts(docs, id_col, text_col)
    sketched = stage(sketches(rows, size), "near-sketches")
    classes = stage(sketched.filter("n > 0").groupBy("n", "total", "parity", "signature", "fine").agg(F.min("doc_id").alias("id")), "near-classes")
    sets = classes.filter(F.col("id").isNotNull() & (F.col("n") * den >= (F.col("n") + 1) * num)).select("id", "n", "signature", "fine")
    keys = index_keys(sets, distance_bound(num / den))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    hits = around_hubs(stage(keys.join(stage(buckets, "near-buckets"), "key"), "near-shared"))

    first = stage(with_sets(hits.select(F.col("id").alias("a"), F.col("low").alias("b")).distinct(), sets).filter(near(num, den)).select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b")), "near-pairs")
    tested = stage(compared(first, rows, size), "near-tested")
    links = similar(tested, num, den)
    labels = components(links)

    told = stage(tested.select(F.col("b").alias("hub"), F.col("a").alias("id"), "extra", "missing", (F.col("common") + F.size("missing")).alias("hub_n")).join(
        labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "near-told")
    beside = stage(beside_hubs(told, sets, num, den), "near-links")
    more = stage(without_hubs(hits, told, labels, sets, num, den).join(
        first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "near-pairs")
    if not more.isEmpty():
        beside = beside.unionByName(stage(similar(compared(more, rows, size), num, den), "near-links"))
    if not beside.isEmpty():
        labels = components(links.unionByName(beside))
    known = classes.join(labels, "id", "left").select("n", "total", "parity", F.coalesce("label", "id").alias("component_id"))
    return sketched.select("doc_id", "n", "total", "parity").join(stage(known, "near-known"), ["n", "total", "parity"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def around_hubs(shared: DataFrame) -> DataFrame:
    """key, id, low, members of every member of a bucket but its hub `low`.

    The hub is the member that meets most others over all its buckets: among copies of one text, one near the text itself.
    """
    scores = shared.groupBy("id").agg(F.sum("members").alias("score"))
    scored = stage(shared.join(scores, "id"), "near-scored")
    hubs = stage(scored.groupBy("key").agg(F.max(F.struct("score", "id")).alias("hub")).select("key", F.col("hub.id").alias("low")), "near-hubs")
    return stage(scored.join(hubs, "key").filter("id != low").select("key", "id", "low", "members"), "near-hits")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return pairs.alias("p").join(sets.alias("a"), F.col("p.a") == F.col("a.id")).join(sets.alias("b"), F.col("p.b") == F.col("b.id"))


def beside_hubs(told: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a > b) between members of different components that were both compared with a hub.

    What both share follows from what each lacks of the hub's set and has besides, so the full sets need not come together again.
    """
    mixed = told.groupBy("hub").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("hub")
    members = stage(told.join(mixed, "hub").join(sets.select("id", "n", "fine"), "id"), "near-members")
    common = (F.col("a.hub_n") - F.size("a.missing") - F.size("b.missing") + F.size(F.array_intersect("a.missing", "b.missing"))
              + F.size(F.array_intersect("a.extra", "b.extra")))
    pairs = members.alias("a").join(members.alias("b"), (F.col("a.hub") == F.col("b.hub")) & (F.col("a.id") > F.col("b.id")) & (
        F.col("a.label") != F.col("b.label")) & near(num, den, fine=True) & (common * den >= (F.col("a.n") + F.col("b.n") - common) * num))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def without_hubs(hits: DataFrame, told: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a > b) around a hub in different components, near by their fine signatures, of which one was too far from the hub
    to be compared with it. Around a hub are the members of all its buckets."""
    known = told.select(F.col("hub").alias("low"), "id", F.lit(True).alias("told"))
    around = stage(hits.filter("members > 2").select("low", "id").distinct().join(labels, "id", "left").select(
        "low", "id", F.coalesce("label", "id").alias("label")).join(known, ["low", "id"], "left").withColumn(
        "told", F.coalesce("told", F.lit(False))), "near-around")
    mixed = around.groupBy("low").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("told").alias("settled")).filter(
        "least != most AND NOT settled").select("low")
    members = stage(around.join(mixed, "low").join(sets.select("id", "n", "fine"), "id"), "near-open")
    pairs = members.filter("NOT told").alias("a").join(members.alias("b"), (F.col("a.low") == F.col("b.low")) & (F.col("a.label") != F.col("b.label")) & (
        F.col("b.told") | (F.col("a.id") > F.col("b.id"))) & near(num, den, fine=True))
    return pairs.select(F.greatest("a.id", "b.id").alias("a"), F.least("a.id", "b.id").alias("b")).distinct()
