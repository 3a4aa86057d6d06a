"""Spelling variants: words one edit apart by scans of sorted lists, and the commoner form that each word leads to."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_map, join_counted, texts

LETTERS = "A-Za-zÀ-ÿ"
GROUP_WORDS = 512  # a group with more words is split before it is scanned
CONTEXT = ["longest", "head", "tail", "below", "before", "after"]


def lower_ascii(word: Column) -> Column:
    """Lower-cases only A to Z."""
    return F.when(F.lower(word) == word, word).otherwise(
        F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", respell=None, least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs of letters, lower-cased, of at least so many characters and occurrences. respell(doc_id, word), where given, changes them."""
    found = texts(docs, id_col, text_col).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    found = found.select("doc_id", lower_ascii(F.col("run")).alias("word"))
    if respell:
        found = found.select(respell(F.col("doc_id"), F.col("word")).alias("word"))
    return found.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def halves(entries: DataFrame) -> DataFrame:
    """Sends every word of a group to two smaller groups.

    The words of a group are at most `longest` long, or one less, and share their first `head` and last `tail` characters. If two of them
    differ by one edit, what they share in front and at the end leaves out no more than that edit; so within the rest they share the
    front half or the end half. A pair that shares the front half is found there alone: elsewhere `below` bounds its common front.
    """
    half = F.ceil((F.col("longest") - F.col("head") - F.col("tail") - 1) / 2).cast("int")
    front = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("below").alias("below"))
    end = F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail"), F.least("below", F.col("head") + half).alias("below"))
    parts = entries.select("word", "n", "longest", F.explode(F.array(front, end)).alias("part")).select("word", "n", "longest", "part.*")
    return parts.withColumn("before", F.expr("left(word, head)")).withColumn("after", F.expr("right(word, tail)"))


def groups(words: DataFrame, group_words: int = GROUP_WORDS) -> list[DataFrame]:
    """Words in groups of at most group_words in which all pairs one edit apart meet exactly once; overfull groups are halved again.

    A group whose words differ in one character only is not split further; it has no more words than there are characters.
    """
    entries = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longest")).select(
        "*", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.col("longest").alias("below"))
    done = []
    while True:
        entries = stage(halves(entries), "variant-groups")
        hot = stage(entries.groupBy(*CONTEXT).count().filter((F.col("count") > group_words) & (F.col("longest") - F.col("head") - F.col("tail") > 1)), "variant-hot")
        if hot.isEmpty():
            return [*done, entries]
        done.append(join_counted(entries, hot.drop("count"), CONTEXT, "left_anti"))
        entries = join_counted(entries, hot.drop("count"), CONTEXT, "left_semi")


def common(a: str, b: str) -> int:
    """Length of the common front."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def scan(words: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j), i < j, of a sorted list of different words that are one edit apart.

    For each word the list is walked in order with the band of the edit matrix around its diagonal: three cells a row, one row for each
    character of the listed word. Rows of the front that a word shares with the one before it stand already. Once a row has
    only cells above one, all following words with that front are skipped.
    """
    shared = [0, *map(common, words, words[1:])]
    pairs, n = [], len(words)
    rows = [(2, 0, 1)] * (1 + max(map(len, words), default=0))
    for i, q in enumerate(words):
        m, j, ready = len(q), i + 1, 0
        while j < n:
            w, depth = words[j], min(ready, shared[j])
            low, mid, high = rows[depth]
            alive = True
            while depth < len(w):
                c = w[depth]
                depth += 1
                # cells of the listed word's first `depth` characters against the first depth - 1, depth, depth + 1 of q
                new_low = min(low + (q[depth - 2] != c), mid + 1) if 1 < depth <= m + 1 else mid + 1 if depth == 1 else 2
                new_mid = min(mid + (q[depth - 1] != c), high + 1, new_low + 1) if depth <= m else 2
                high = min(high + (q[depth] != c), new_mid + 1) if depth < m else 2
                low, mid = new_low, new_mid
                if low > 1 and mid > 1 and high > 1:
                    alive = False
                    break
                rows[depth] = (low, mid, high)
            j += 1
            if alive:
                ready = depth
                if {-1: low, 0: mid, 1: high}.get(m - len(w), 2) == 1:
                    pairs.append((i, j - 1))
            else:
                ready = depth - 1
                while j < n and shared[j] >= depth:
                    j += 1
    return pairs


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, near, near_n): every word with each word that differs by one inserted, deleted or replaced character, in both directions."""
    def work(batch):
        out = [], [], []
        for group in batch.to_pylist():
            head, tail, longest, below = (group[k] for k in ("head", "tail", "longest", "below"))
            members = sorted((e["word"][head:len(e["word"]) - tail], e["word"], e["n"]) for e in group["members"])
            for i, j in scan([e[0] for e in members]):
                (_, a, n_a), (_, b, n_b) = members[i], members[j]
                if max(len(a), len(b)) == longest and common(a, b) < below:
                    for column, values in zip(out, ((a, b), (b, a), (n_b, n_a)), strict=True):
                        column.extend(values)
        yield out

    found = None
    for part in groups(words, group_words):
        lists = part.groupBy(*CONTEXT).agg(F.collect_list(F.struct("word", "n")).alias("members")).filter(F.size("members") > 1).select(
            "longest", "head", "tail", "below", "members")
        pairs = arrow_map(lists, "word string, near string, near_n bigint", work)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms. Each round doubles the steps taken, so a chain of k words takes log2(k) rounds."""
    at = stage(forms.select("word", F.coalesce("form", "word").alias("root")), "variant-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(at.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "variant-roots")
        at = after.drop("moved")
        if after.filter("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, ratio: int = 2, group_words: int = GROUP_WORDS) -> DataFrame:
    """Every word of (word, n), each different, with the commoner spelling it stands for.

    Returns word, n, n_near (words one edit apart), form (the near word of largest n, ties: smallest in code-point order, if that n is
    at least ratio * n; else null), form_n, root (the end of the chain of forms; the word itself without form). Words of one
    character are near each other, not near the empty word, which must not be given. An empty table gives no rows.
    """
    words = stage(words.select("word", "n"), "variant-words")
    best = near_words(words, group_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best"))
    commoner = -F.col("best.least") >= ratio * F.col("n")
    forms = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(commoner, F.col("best.near")).alias("form"),
        F.when(commoner, -F.col("best.least")).alias("form_n")), "variant-forms")
    return forms.join(roots(forms), "word")


def slipped(doc_id: Column, word: Column) -> Column:
    """The word without one of its characters, where the checksum of document and word says so."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(F.pmod(h, F.lit(97)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)
