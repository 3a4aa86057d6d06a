"""Plain versions of the operators, for small tables."""
import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near(rows, size, num, den):
    """doc_id -> (set size, component) for rows with different ids."""
    sets = {}
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0D]+", lower(text))
        sets[i] = {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def contamination(texts, items, window=13):
    """(words, hits, item ids) of every text."""
    split = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = defaultdict(set)
    for item, text in items:
        words = split(lower(text))
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[k:k + n])].add(str(item))
    out = []
    for text in texts:
        words = split(lower(text))
        hit, found = [False] * len(words), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                own = windows.get(tuple(words[k:k + n]))
                if own:
                    found |= own
                    hit[k:k + n] = [True] * n
        out.append((len(words), sum(hit), sorted(found)))
    return out


def repeats(texts, length):
    """(bytes, removed, runs, digest of what stays) of every text."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if times[d[k:k + length]] > 1:
                covered[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(d)) if covered[k] and (k == 0 or not covered[k - 1]))
        kept = bytes(b for b, c in zip(d, covered, strict=True) if not c)
        out.append((len(d), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits)))
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and doubled % 10 == 0)
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def utf16(text):
    raw = text.encode("utf-16-le")
    return [raw[k] + 256 * raw[k + 1] for k in range(0, len(raw), 2)]


def kneser_ney(texts, order, alphabet):
    """Probability of a symbol (a UTF-16 code unit) after a context, by the recursive definition over dictionaries."""
    counts = {order: Counter()}
    for text in texts:
        seq = [0] * (order - 1) + utf16(text)
        counts[order].update(tuple(seq[k:k + order]) for k in range(len(seq) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k in counts:
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        discounts[k] = [max(0.0, min(j, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else 0.5 for j in (1, 2, 3)]

    def probability(context, w, k=order):
        if k == 0:
            return 1 / alphabet
        own = {g: c for g, c in counts[k].items() if g[:-1] == context}
        if not own:
            return probability(context[1:], w, k - 1)
        total, cut = sum(own.values()), [discounts[k][min(c, 3) - 1] for c in own.values()]
        c = own.get((*context, w), 0)
        return (c - discounts[k][min(c, 3) - 1] if c else 0) / total + sum(cut) / total * probability(context[1:], w, k - 1)
    return probability
