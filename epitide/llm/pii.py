"""Personal data: exact patterns, and a character BiLSTM with CRF transitions, trained in numpy, that adds spans to theirs."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import arrow_map, share, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of every kind
WIDTH, STRIDE, MARGIN = 64, 32, 16  # characters of a window, between windows, and around a token of interest
REACH = 64  # characters around a bracketed at, which stands apart from name and domain
LONGEST, SHARED = 8_192, 256  # a longer stretch is decoded in pieces that share so many characters
DECODED = 1 << 18  # characters decoded at once
EMBED, HIDDEN, CODES = 12, 16, 98
FIT_ROWS = 600  # documents with tokens of interest that the network is fitted on, chosen by a hash of the id
FIT_WINDOWS = 4_500
EPOCHS, BATCH, RATE = 24, 96, 0.02
SURE = 0.95  # least mean probability of an added span
FORBIDDEN = -1e4

# patterns fixed by what counts as each kind
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]|\[at\]")
TOKEN = re.compile(r"(?<!\S)(?:[^\s0-9@\[]|\[(?!at\]))*+(?:[0-9@]|\[at\])\S*")
MARKED = T.byte_table((0x30, 0x39), (0x40, 0x40), (0x5B, 0x5B))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each begins at the first character in reach of its @, which keeps long runs without one linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL.match(text, begin - 1):
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)  # no later match can reach over this @
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans that the patterns find, by begin and then kind; end exclusive, in code points."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", CARD, 12, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around tokens with a digit, an @ or a bracketed at; every taught form has one of these."""
    out: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        margin = REACH if "[at]" in m[0] else MARGIN
        begin, end = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def pieces(begin: int, end: int) -> list[tuple[int, int, int, int]]:
    """A stretch in pieces of bounded length: begin and end of each, and between which places its spans may begin."""
    if end - begin <= LONGEST:
        return [(begin, end, begin, end)]
    cuts = range(begin, end - SHARED, LONGEST - SHARED)
    return [(a, min(a + LONGEST, end), a + (SHARED // 2 if a > begin else 0), min(a + LONGEST - SHARED // 2, end) if a + LONGEST < end else end) for a in cuts]


def codes(text: str) -> np.ndarray:
    """Printable ASCII one by one, other characters as blank, letter or mark; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where((points >= 32) & (points < 127), points - 31, np.where(points < 32, 1, 96)).astype(np.int64)


def tags(spans: list[Span], begin: int, end: int) -> np.ndarray:
    out = np.zeros(end - begin, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        lo, hi = max(a, begin), min(b, end)
        if lo < hi:
            out[lo - begin:hi - begin] = k + 1
            if a >= begin:
                out[a - begin] = k
    return out


def window_starts(n: int) -> list[int]:
    """Windows every STRIDE characters; the last one ends with the region."""
    return [*range(0, max(1, n - WIDTH), STRIDE), *([n - WIDTH] if n > WIDTH else [])]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """An LSTM over windows (time first), with its gradient."""

    def __init__(self, rng):
        self.w = rng.normal(0, 0.2, (EMBED + HIDDEN, 4 * HIDDEN))
        self.b = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]

    def forward(self, x, mask, keep: bool = False):
        h, c, out, self.kept = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN)), np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)):
            z = np.concatenate([x[t], h], axis=1)
            gates = z @ self.w + self.b
            i, f, o = np.split(sigmoid(gates[:, :3 * HIDDEN]), 3, axis=1)
            g, before, m = np.tanh(gates[:, 3 * HIDDEN:]), c, mask[t][:, None]
            c = (f * c + i * g) * m
            bent = np.tanh(c)
            h = o * bent * m
            out[t] = h
            if keep:
                self.kept.append((z, i, f, o, g, before, bent, m))
        return out

    def backward(self, d_out):
        dw, db, dx = np.zeros_like(self.w), np.zeros_like(self.b), np.empty((*d_out.shape[:2], EMBED))
        dh, dc = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
        for t in range(len(d_out) - 1, -1, -1):
            z, i, f, o, g, before, bent, m = self.kept[t]
            dh = (dh + d_out[t]) * m
            dc = (dc + dh * o * (1 - bent**2)) * m
            gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dw += z.T @ gates
            db += gates.sum(axis=0)
            back = gates @ self.w.T
            dx[t], dh, dc = back[:, :EMBED], back[:, EMBED:], dc * f
        return dx, dw, db


def log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Embedding, two directions, emissions and transitions. Inside tags follow only their own kind."""
    seed: int = 11
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.embedding = rng.normal(0, 0.3, (CODES, EMBED))
        self.out, self.bias = rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), np.zeros(TAGS)
        self.moves = np.zeros((TAGS, TAGS))
        self.allowed = np.zeros((TAGS, TAGS))
        inside = np.arange(2, TAGS, 2)
        self.allowed[:, inside] = FORBIDDEN
        self.allowed[inside, inside] = self.allowed[inside - 1, inside] = 0
        self.params = {"embedding": self.embedding, "aw": self.ahead.w, "ab": self.ahead.b, "bw": self.back.w, "bb": self.back.b,
                       "out": self.out, "bias": self.bias, "moves": self.moves}

    def emissions(self, x, keep: bool = False):
        """x: windows of codes, time first. Scores of every tag at every place."""
        mask = (x > 0).astype(float)
        e = self.embedding[x]
        h = np.concatenate([self.ahead.forward(e, mask, keep), self.back.forward(e[::-1], mask[::-1], keep)[::-1]], axis=2)
        if keep:
            self.h = h
        return h @ self.out + self.bias

    def marginals(self, scores, mask):
        """Log partition, probability of every tag at every place, and expected transitions, by forward and backward sums."""
        moves = self.moves + self.allowed
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + self.allowed[0]
        for t in range(1, len(scores)):
            new = log_sum(alpha[t - 1][:, :, None] + moves, 1) + scores[t]
            alpha[t] = np.where(mask[t][:, None] > 0, new, alpha[t - 1])
        for t in range(len(scores) - 2, -1, -1):
            new = log_sum(moves + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None] > 0, new, beta[t + 1])
        total = log_sum(alpha[-1], 1)
        places = np.exp(alpha + beta - total[:, None]) * mask[:, :, None]
        pairs = np.zeros_like(moves)
        for t in range(1, len(scores)):
            p = np.exp(np.minimum(alpha[t - 1][:, :, None] + moves + (scores[t] + beta[t] - total[:, None])[:, None, :], 0))
            pairs += (p * mask[t][:, None, None]).sum(axis=0)
        return total, places, pairs

    def gradients(self, x, y):
        mask = (x > 0).astype(float)
        scores = self.emissions(x, keep=True)
        _, places, pairs = self.marginals(scores, mask)
        gold = (y[:, :, None] == np.arange(TAGS)) * mask[:, :, None]
        seen = np.zeros_like(pairs)
        np.add.at(seen, (y[:-1][mask[1:] > 0], y[1:][mask[1:] > 0]), 1)
        d = (places - gold) / x.shape[1]
        dh = d @ self.out.T
        da, aw, ab = self.ahead.backward(dh[:, :, :HIDDEN])
        db, bw, bb = self.back.backward(dh[::-1, :, HIDDEN:])
        de = np.zeros_like(self.embedding)
        np.add.at(de, x, da + db[::-1])
        return {"embedding": de, "aw": aw, "ab": ab, "bw": bw, "bb": bb, "out": np.einsum("tbh,tbk->hk", self.h, d),
                "bias": d.sum(axis=(0, 1)), "moves": (pairs - seen) / x.shape[1]}

    def train(self, x, y):
        """Adam over shuffled batches of windows (windows first); the same rows give the same network."""
        rng = np.random.default_rng(self.seed)
        m, v, step = {k: np.zeros_like(p) for k, p in self.params.items()}, {k: np.zeros_like(p) for k, p in self.params.items()}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                part = order[lo:lo + BATCH]
                step += 1
                for k, g in self.gradients(x[part].T, y[part].T).items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.params[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.ahead.kept = self.back.kept = []
        self.h = None

    def best_path(self, scores):
        """Viterbi over one stretch."""
        moves, best, back = self.moves + self.allowed, scores[0] + self.allowed[0], []
        for t in range(1, len(scores)):
            ways = best[:, None] + moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + scores[t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])

    def spans(self, stretches: list[str]) -> list[list[Span]]:
        """Spans of each stretch. Windows overlap; where they do their scores are averaged, the middle of a window counting most,
        and the whole stretch is decoded at once, so no span depends on where a window ends."""
        windows, places = [], []
        coded = [codes(s) for s in stretches]
        for k, c in enumerate(coded):
            for a in window_starts(len(c)):
                part = c[a:a + WIDTH]
                windows.append(np.r_[part, np.zeros(WIDTH - len(part), np.int64)])
                places.append((k, a, len(part)))
        tent = 1.0 + np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1])
        sums = [np.zeros((len(c), TAGS)) for c in coded]
        weights = [np.zeros(len(c)) for c in coded]
        for lo in range(0, len(windows), 512):
            scores = self.emissions(np.array(windows[lo:lo + 512]).T)
            for j, (k, a, n) in enumerate(places[lo:lo + 512]):
                sums[k][a:a + n] += scores[:n, j] * tent[:n, None]
                weights[k][a:a + n] += tent[:n]
        out = []
        for s, w in zip(sums, weights, strict=True):
            if not len(s):
                out.append([])
                continue
            scores = s / w[:, None]
            path = self.best_path(scores)
            found = []
            if path.any():
                _, sure, _ = self.marginals(scores[:, None, :], np.ones((len(scores), 1)))
                begins = np.flatnonzero(path % 2 == 1)
                for a in begins.tolist():
                    b = a + 1
                    while b < len(path) and path[b] == path[a] + 1:
                        b += 1
                    if sure[np.arange(a, b), 0, path[a:b]].mean() >= SURE:
                        found.append((KINDS[path[a] // 2], a, b))
            out.append(found)
        return out


def rewritten(text: str, spans: list[Span], change) -> tuple[str, list[Span]]:
    """The text with every labelled span changed, and all labels moved to where they stand now."""
    out, labels, at, length = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        new = change(kind, text[a:b])
        out += [text[at:a], new]
        length += a - at
        labels.append((kind, length, length + len(new)))
        length, at = length + len(new), b
    return "".join(out) + text[at:], labels


def without_code(kind: str, old: str) -> str:
    new = re.sub(r"^\+[0-9]{1,3}[ -]?", "", old) if kind == "phone" else old
    return new if len(new) >= 8 else old


def varied(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """A labelled text in forms that the patterns miss: phone numbers without a country code, emails with a bracketed at, also
    without blanks around it and without digits."""
    def apart(kind, old):
        return old.replace("@", " [at] ") if kind == "email" else without_code(kind, old)

    def plain(kind, old):
        bare = re.sub("[0-9]", "", old)
        return bare.replace("@", " [at] ") if kind == "email" and bare[:1] != "@" else old

    def close(kind, old):
        return old.replace("@", "[at]") if kind == "email" else without_code(kind, old)
    if any(spans[k][2] > spans[k + 1][1] for k in range(len(spans) - 1)):
        return []  # spans that overlap stay as they are
    forms = [rewritten(text, spans, change) for change in (apart, plain, close)]
    return [f for k, f in enumerate(forms) if f[0] != text and f not in forms[:k]]


def fit(docs: DataFrame) -> Tagger | None:
    """Labelled spans are those of the patterns in a bounded sample of texts, and varied copies of them; none give no network."""
    interesting = docs.filter(F.col("text").rlike("[0-9@]"))
    rate = FIT_ROWS / max(1, interesting.count())
    chosen = interesting.filter(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 30)) < F.lit(rate * float(1 << 30)))
    ddl = "codes binary, tags binary"

    def encode(batch):
        out = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            for begin, end in regions(text):
                own = [(k, a - begin, b - begin) for k, a, b in spans if begin <= a and b <= end]
                for stretch, labels in [(text[begin:end], own), *varied(text[begin:end], own)]:
                    c, y = codes(stretch), tags(labels, 0, len(stretch))
                    for a in window_starts(len(c)):
                        n = len(c[a:a + WIDTH])
                        out.append((np.r_[c[a:a + WIDTH], np.zeros(WIDTH - n, np.int64)].astype(np.uint8).tobytes(),
                                    np.r_[y[a:a + WIDTH], np.zeros(WIDTH - n, np.int64)].astype(np.uint8).tobytes()))
        if out:
            yield tuple(map(list, zip(*out, strict=True)))
    sampled = arrow_map(chosen, ddl, encode).orderBy(F.xxhash64("codes", "tags"), "codes").limit(FIT_WINDOWS)
    rows = sampled.toArrow().to_pylist()
    y = np.array([np.frombuffer(r["tags"], np.uint8) for r in rows]).astype(np.int64)
    if not y.any():
        return None
    tagger = Tagger()
    tagger.train(np.array([np.frombuffer(r["codes"], np.uint8) for r in rows]).astype(np.int64), y)
    return tagger


def whole_words(text: str, a: int, b: int) -> tuple[int, int]:
    """An email's span widened to where its first and last words begin and end, by REACH characters at most."""
    first, last = max(0, a - REACH), min(len(text), b + REACH)
    while a > first and LOCAL.match(text, a - 1):
        a -= 1
    while b < last and re.match("[A-Za-z0-9-]", text[b]):
        b += 1
    return a, b


def added_spans(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """What the network finds besides: trimmed of blanks, with a mark of a taught form, and clear of every span of the patterns."""
    out: list[Span] = []
    for kind, a, b in found:
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())
        if kind == "email" and b > a:
            a, b = whole_words(text, a, b)
        if b > a and MARK.search(text, a, b) and not any(a < y and x < b for _, x, y in [*base, *out[-1:]]):
            out.append((kind, a, b))
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the personal data in its text.

    Returns doc_id, base (spans of the patterns) and added (spans of the network that touch none of those), each an array of kind,
    begin, end in code points, end exclusive, ordered by begin and then kind. Null and empty texts have none. Rows that repeat are
    treated alike; very long stretches of marked tokens are decoded in pieces that share 256 characters. If no pattern matches anywhere there is nothing to learn from and nothing is added; an empty table gives no
    rows; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    model = share(docs.sparkSession, fit(rows))
    kind = "array<struct<kind: string, begin: int, end: int>>"
    ddl = f"doc_id bigint, base {kind}, added {kind}"

    def work(batch):
        tagger = model()
        for piece in T.slices(batch.column("text")):
            n = piece.hi - piece.lo
            base, added = [[] for _ in range(n)], [[] for _ in range(n)]
            marked = np.unique(piece.text_of(np.flatnonzero(MARKED[piece.data]))).tolist()
            own, stretches = {}, []
            for row in marked:
                own[row] = bytes(piece.data[piece.offsets[row]:piece.offsets[row + 1]]).decode("utf-8", "replace")
                base[row] = base_spans(own[row])
                stretches += [(row, *part) for a, b in regions(own[row]) for part in pieces(a, b)]
            while tagger and stretches:
                sizes = np.cumsum([b - a for _, a, b, _, _ in stretches])
                now = max(1, int(np.searchsorted(sizes, DECODED)))
                decoded = tagger.spans([own[row][a:b] for row, a, b, _, _ in stretches[:now]])
                for (row, begin, _, first, last), found in zip(stretches[:now], decoded, strict=True):
                    moved = [(k, a + begin, b + begin) for k, a, b in found if first <= a + begin < last]
                    added[row] += added_spans(own[row], base[row], moved)
                stretches = stretches[now:]
            packed = [[[{"kind": k, "begin": a, "end": b} for k, a, b in s] for s in side] for side in (base, added)]
            yield (batch.column("doc_id").slice(piece.lo, n), *packed)
    return arrow_map(rows, ddl, work)
