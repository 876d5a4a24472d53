"""Personal data: candidate spans, judged by gradient-boosted trees.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers;
what they find and validate is always a span. Beyond them, generators with high
recall propose further spans, overlapping ones included: addresses written out
("name at host dot com"), numbers with telephone or card grouping, the parts of
a run in which two numbers stand side by side, and keys, tokens and passwords.
Each candidate is described by its format (lengths, groups, digits, checks) and
its context (characters and words around it, how other candidates overlap it).
Boosted regression trees give a score, calibrated on held-out examples by
Platt's method; a threshold for each kind is chosen there for precision. Of
overlapping candidates above the threshold the most probable stays.

No table marks personal data, so the trees are trained on examples that are
made here from fixed templates and a fixed seed: `EXAMPLES` texts of random
words that hold data of each kind and look-alikes (versions, dates, sums,
serial numbers, measures). Calibration and thresholds come from as many texts
that hold other forms and look-alikes besides. The model is fitted on the driver
in a few seconds and is a few hundred small arrays.

All patterns and features take time in proportion to the text, or to it times
the logarithm of its candidates.

Defined results: a null text is the empty text and has no spans; spans are in
code points with exclusive ends; equal texts get equal spans; whole texts are
searched, and only texts that no pattern or generator can match (`WORTH`) are
passed over quickly; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

# The base patterns, and the order of kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators of further candidates.
MORE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![0-9.])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)){3}[0-9]{1,3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){3}(?:[ .-]?[0-9]{1,3})?(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])0[0-9]{1,4}[ /.-][0-9]{3,8}(?:[ .-][0-9]{2,5}){0,2}(?![0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[bap]-|AIza)[A-Za-z0-9_-]{12,}")),
    ("secret", re.compile(r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|api[_-]?key|token)\s?[=:]\s?[^\s,;]{6,}")),
)
#: What every span of the base patterns and of MORE holds, generator by generator; a text without any of it has none.
WORTH = re.compile(r"[0-9@]|\(at\)|\[at\]| at |AKIA|ASIA|gh[pousr]_|sk-|xox[bap]-|AIza|(?i:password|passwd|pwd|secret|api[_-]?key|token)\s?[=:]")
EXAMPLES = 3000
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.2, 32
PRECISION = 0.98
TLDS = frozenset("com net org edu gov io de fr es uk eu info co us ca".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small_part(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 3 or len(s) == 3 and s <= "255"


def addresses(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of local part, @, domain with a dot: from each @ backwards, since no local part holds one."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        done = m.end() if m else at + 1
        if m:
            out.append(("email", begin, done))
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns, by kind and start."""
    out = []
    if "@" in text:
        out += addresses(text)
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(small_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        d = only_digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Further spans that may be personal data; they may overlap."""
    return sorted({(k, m.start(), m.end()) for k, p in MORE for m in p.finditer(text)}, key=lambda x: (x[1], x[2], x[0]))


CLUES = {
    "email": ("mail", "e-mail", "contact", "write", "address", "reach"),
    "ip": ("ip", "host", "server", "address", "from", "ping"),
    "card": ("card", "visa", "credit", "pay", "account", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "dial"),
    "secret": ("key", "password", "token", "secret", "login", "aws"),
}
AGAINST = ("version", "v", "section", "release", "isbn", "order", "no", "number", "serial", "part", "total", "id", "invoice", "page", "chapter", "build", "ratio", "build")


def entropy(s: str) -> float:
    n = len(s) or 1
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def overlaps(spans: list[tuple[str, int, int]]) -> dict[tuple[str, int, int], tuple[int, int]]:
    """For each span, how many others it meets and how many others hold it whole, by one sweep."""
    starts, ends = sorted(a for _, a, _ in spans), sorted(b for _, _, b in spans)
    rank = {b: i for i, b in enumerate(sorted(set(ends)))}
    tree = [0] * (len(rank) + 1)  # counts of the ends seen, as partial sums
    out, group = {}, []
    order = sorted(spans, key=lambda s: s[1])

    def below(i: int) -> int:
        total = 0
        while i > 0:
            total += tree[i]
            i -= i & -i
        return total

    seen = 0
    for n, span in enumerate(order):
        group.append(span)
        i = rank[span[2]] + 1
        while i <= len(rank):
            tree[i] += 1
            i += i & -i
        if n + 1 < len(order) and order[n + 1][1] == span[1]:
            continue
        seen = n + 1
        for s in group:
            meets = bisect_left(starts, s[2]) - bisect_right(ends, s[1])
            out[s] = meets - 1, seen - below(rank[s[2]]) - 1
        group = []
    return out


def describe(text: str, span: tuple[str, int, int], around: tuple[int, int]) -> list[float]:
    """Features of format and context; `around` from overlaps()."""
    kind, a, b = span
    s = text[a:b]
    d = only_digits(s)
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, a - 40) : a], text[b : b + 40]
    words = [w.strip(".,:;()=#").lower() for w in before.split()[-4:]]
    tail = re.split(r"\.| dot |\(dot\)|\[dot\]", s)[-1].strip().lower()
    value = re.split(r"[=:]", s)[-1].strip()
    return [
        float(KINDS.index(kind)), len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count(" "), s.count("-"), s.count("."), s.count("("), float(s[:1] == "+"), float(luhn(d)) if len(d) >= 12 else -1.0,
        float(all(map(small_part, groups))) if groups else 0.0, entropy(value), sum(c.isupper() for c in s) / len(s), sum(c.isalpha() for c in s) / len(s),
        float(tail in TLDS), float("@" in s), float(" at " in s), float(" dot " in s),
        float(any(w in CLUES[kind] for w in words)), float(any(w in AGAINST for w in words)), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(before[-1:] in "$€£#"), float(after[:1] in "%€$°"), float(before[-2:-1].isdigit()), float(after[1:2].isdigit()),
        float(around[0]), float(around[1]),
        float(len(value)), sum(c.isdigit() for c in value) / max(1, len(value)), float(d[:1] in "3456") if d else 0.0, float("555" in groups),
    ]


class Trees:
    """Gradient boosting of depth-limited regression trees on binned features, logistic loss."""

    def __init__(self) -> None:
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = math.log(mean / (1 - mean))
        score = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        n = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(n, -1), np.zeros(n, int), np.zeros(n)
        node = np.zeros(len(g), int)
        for i in range(n):
            rows = np.flatnonzero(node == i)
            sg, sh = g[rows].sum(), h[rows].sum()
            value[i] = RATE * sg / (sh + 1.0)
            if i >= 2**DEPTH - 1 or len(rows) < 8:
                continue
            best = 1e-3
            for f in range(b.shape[1]):
                bins = b[rows, f]
                gl = np.cumsum(np.bincount(bins, g[rows], BINS + 1))[:-1]
                hl = np.cumsum(np.bincount(bins, h[rows], BINS + 1))[:-1]
                gain = gl**2 / (hl + 1) + (sg - gl) ** 2 / (sh - hl + 1) - sg**2 / (sh + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[i], cut[i] = float(gain[k]), f, k
            if feature[i] >= 0:
                node[rows] = np.where(b[rows, feature[i]] <= cut[i], 2 * i + 1, 2 * i + 2)
        return feature, cut, value

    @staticmethod
    def _walk(tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(b), int)
        for _ in range(DEPTH):
            f = feature[at]
            inner = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.start + sum(self._walk(t, b) for t in self.trees)


def made_example(rng: random.Random, unseen: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """A text of random words with data and look-alikes, and the spans of the data."""
    syllables = "an the er in on re st ti ou ea ch le de que ung lich os ar ment tion".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card(sep: str) -> str:
        d = rng.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def name() -> str:
        return word() + rng.choice(["", ".", "_"]) + rng.choice([word(), digits(2)])

    host = lambda: rng.choice(["mail", "", "corp"]) + word()
    tld = lambda: rng.choice(sorted(TLDS))
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    good = {
        "email": [lambda: f"{name()}@{host()}.{tld()}", lambda: f"{name()} at {host()} dot {tld()}", lambda: f"{name()}(at){host()}.{tld()}", lambda: f"{name()} [at] {host()} [dot] {tld()}"],
        "ip": [lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: "[.]".join(str(rng.randint(1, 255)) for _ in range(4))],
        "card": [lambda: card(rng.choice(["", " ", "-"])), lambda: card(".")],
        "phone": [lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+49 {digits(3)} {digits(3)} {digits(4)}", lambda: f"0{digits(2)} {digits(4)} {digits(4)}"],
        "secret": [lambda: "AKIA" + "".join(rng.choice(chars) for _ in range(16)), lambda: rng.choice(["password=", "api_key=", "token: "]) + "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 24))), lambda: "ghp_" + "".join(rng.choice(chars + chars.lower()) for _ in range(30))],
    }
    bad = [
        lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"order {digits(4)} {digits(4)} {digits(4)} {digits(4)}", lambda: f"{digits(16)}",
        lambda: f"{word()} at {word()} dot {word()}", lambda: f"at {word()} {word()}", lambda: f"isbn {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"0{digits(2)} {digits(3)}", lambda: f"{digits(3)}.{digits(2)}", lambda: "token: " + word() + word() + "en", lambda: "password: " + word() + "ing" + word(), lambda: f"total {digits(3)} {digits(3)} {digits(4)}",
        lambda: f"{word()} at {word()}. {word().title()} {word()}", lambda: f"{word()} at {word()}. {rng.choice(sorted(TLDS)).title()} {word()}", lambda: f"{word()}={word()}", lambda: f"section {rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}", lambda: f"0{digits(3)}.{digits(4)} kg",
    ]
    if unseen:
        good["email"] += [lambda: f"{name()} (at) {host()} (dot) {tld()}", lambda: f"{name()} at {word()}.{host()}.{tld()}"]
        good["phone"] += [lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"]
        good["card"] += [lambda: f"37{digits(2)} {digits(6)} {digits(5)}"]
        good["secret"] += [lambda: "sk-" + "".join(rng.choice(chars.lower()) for _ in range(32)), lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"']
        bad += [
            lambda: f"part {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", lambda: f"{digits(16)} {word()}", lambda: f"pwd: {word()}{word()}", lambda: f"{word()} at {word()}.{word()}",
            lambda: f"secret: {word()}ing, {word()}", lambda: f"build {rng.randint(1, 99)}.{rng.randint(0, 99)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"sk-{word()}-{word()}-{word()}", lambda: f"0{digits(3)}-{digits(4)} {rng.choice(['EUR', 'cm'])}", lambda: f"id {digits(3)} {digits(3)} {digits(4)}",
        ]
    text, spans = "", []
    for _ in range(rng.randint(1, 4)):
        text += " ".join(word() for _ in range(rng.randint(1, 8))) + rng.choice([" ", ", ", ": "])
        if rng.random() < 0.5:
            kind = rng.choice(KINDS)
            if rng.random() < 0.3:
                text += rng.choice(CLUES[kind]) + " "
            s = rng.choice(good[kind])()
            spans.append((kind, len(text), len(text) + len(s)))
            text += s
            if rng.random() < 0.15:
                other = rng.choice(["card", "phone"])
                s = rng.choice(good[other])()
                text += " "
                spans.append((other, len(text), len(text) + len(s)))
                text += s
        else:
            text += rng.choice(bad)()
        text += rng.choice([" ", ". ", ", "])
    return text + " ".join(word() for _ in range(3)), spans


def examples(rng: random.Random, n: int, unseen: bool):
    """Features, truth and kind of the candidates of `n` made texts."""
    x, y, kinds = [], [], []
    for _ in range(n):
        text, truth = made_example(rng, unseen)
        base = set(base_spans(text))
        found = candidates(text)
        around = overlaps(sorted({*base, *found}))
        for c in found:
            if c in base:  # needs no judgement
                continue
            x.append(describe(text, c, around[c]))
            y.append(float(c in truth))
            kinds.append(c[0])
    return np.array(x), np.array(y), np.array(kinds)


@lru_cache(maxsize=1)
def model():
    """Trees, calibration (slope, shift) and thresholds by kind; the same wherever it is fitted.

    The trees see the usual forms only; calibration and thresholds come from
    texts that also hold forms and look-alikes the trees have not seen.
    """
    x, y, _ = examples(random.Random(20), EXAMPLES, False)
    trees = Trees().fit(x, y)
    x, t, kinds = examples(random.Random(21), EXAMPLES, True)
    s = trees.score(x)
    slope, shift = 1.0, 0.0
    for _ in range(30):  # Platt scaling by Newton steps
        p = 1 / (1 + np.exp(-(slope * s + shift)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((t - p) * s).sum() - 1e-2 * (slope - 1), (t - p).sum() - 1e-2 * shift])
        h = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        slope, shift = slope + d[0], shift + d[1]
    p = 1 / (1 + np.exp(-(slope * s + shift)))
    thresholds = {}
    for kind in KINDS:
        mine = kinds == kind
        # the lowest from which on precision is as asked for; if none is, the one of the best precision
        options = [(t[q].mean(), c) for c in np.linspace(0.02, 0.98, 97) if (q := mine & (p >= c)).sum() >= 20]
        fine = [c for precision, c in options if precision >= PRECISION]
        thresholds[kind] = float(min(fine)) if fine else float(max(options)[1]) if options else 1.1
    return trees, (slope, shift), thresholds


def merged(stretches) -> tuple[list[int], list[int]]:
    """Begins and ends of the stretches, overlapping ones made one."""
    begins, ends = [], []
    for a, b in sorted(stretches):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def find(text: str | None, fitted) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans: base ones and those of the trees that do not overlap them or each other."""
    if not text or not WORTH.search(text):
        return [], []
    base = base_spans(text)
    known = set(base)
    more = [c for c in candidates(text) if c not in known]
    chosen = []
    if more:
        trees, (slope, shift), thresholds = fitted
        around = overlaps(sorted({*base, *more}))
        z = slope * trees.score(np.array([describe(text, c, around[c]) for c in more])) + shift
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        begins, ends = merged((a, b) for _, a, b in base)
        for c, q in sorted(zip(more, p.tolist(), strict=True), key=lambda v: (-v[1], v[0])):
            at = bisect_left(begins, c[2])  # of the taken stretches, which are apart, only the last that begins before the span's end can meet it
            if q >= thresholds[c[0]] and (at == 0 or ends[at - 1] <= c[1]):
                chosen.append(c)
                begins.insert(at, c[1])
                ends.insert(at, c[2])
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + chosen, key=order)


def join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: `id_col`, base and spans array<struct<kind, start, end>>, by kind and start."""
    return _apply(docs, id_col, text_col, "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>", lambda base, spans, text: (base, spans))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: `id_col`, text with each span replaced by its kind in brackets."""

    def cover(base, spans, text):
        if not spans:
            return (text or "",)
        out, at = [], 0
        for k, a, b in sorted(spans, key=lambda s: s[1:]):
            if a >= at:
                out += [text[at:a], f"[{k}]"]
            at = max(at, b)
        return ("".join(out) + text[at:],)

    return _apply(docs, id_col, text_col, "text string", cover)


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans by kind, their SHA-256, all spans as a string and their number."""

    def row(base, spans, text):
        n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
        return (*n, hashlib.sha256(join(base).encode()).hexdigest(), join(spans), len(spans))

    return _apply(docs, id_col, text_col, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint", row)


def _apply(docs: DataFrame, id_col: str, text_col: str, columns: str, row) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(docs.sparkSession)
    fitted = model()
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, {columns}"
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in slices(batches):
            rows = [row(*find(t, fitted), t) for t in b.column(1).to_pylist()]
            fields = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow.names[1:]]
            as_struct = lambda v: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in v] if isinstance(v, list) else v
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([as_struct(v) for v in f], arrow.field(i + 1).type) for i, f in enumerate(fields))], arrow.names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
