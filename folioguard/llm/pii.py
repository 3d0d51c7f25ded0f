"""Personal data: base patterns, and more spans by candidate gradient boosting.

Generators propose overlapping candidate spans with high recall.  Boosted trees
look at a candidate's format and context, and a calibrated threshold for each
kind says which candidates are redacted.  Base spans always are.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "mac", "mail_words", "number", "secret", "ssn")
KINDS = BASE_KINDS + MORE_KINDS
#: Synthetic examples that the trees are fitted on, and calibrated on.
EXAMPLES = 6000
#: Wanted share of right redactions among those of a kind, on the calibration rows.
PRECISION = 0.97

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_GENERATORS = (
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("mac", re.compile(r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b")),
    ("number", re.compile(r"[+(]?[0-9][0-9 ().\-/]{6,28}[0-9]")),
    ("secret", re.compile(r"[A-Za-z0-9_/+=\-]{16,}")),
    ("ssn", re.compile(r"\b[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}\b")),
)
_MAIL_WORDS = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]++(?: ?[(\[{]dot[)\]}] ?|\.)[A-Za-z]{2,24}", re.I)

#: Words before a span that speak for personal data, or against.
CUES_FOR = ("account", "acct", "api", "apikey", "auth", "bank", "bearer", "call", "card", "cell", "fax", "iban", "id", "key", "konto", "mac", "mail",
            "mobile", "passport", "password", "phone", "pin", "pwd", "reach", "secret", "social", "ssn", "tel", "tin", "token", "write")
CUES_AGAINST = ("chapter", "checksum", "commit", "edition", "figure", "hash", "invoice", "isbn", "issue", "item", "line", "md5", "no", "order", "page",
                "part", "pp", "price", "revision", "sha1", "table", "total", "vol", "version", "year")
_WORD_BEFORE = re.compile(r"[A-Za-z0-9]+")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping (kind, start, end) proposals of all generators."""
    out = []
    if "at)" in (low := text.lower()) or "at]" in low or "at}" in low:
        out += [("mail_words", m.start(), m.end()) for m in _MAIL_WORDS.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in _GENERATORS:
            for m in pattern.finditer(text):
                if kind != "secret" or _DIGIT.search(m.group()):
                    out.append((kind, m.start(), m.end()))
    return out


def mod97(s: str) -> bool:
    s = re.sub(r"[^A-Z0-9]", "", s)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]) or 0) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate as numbers."""
    s = text[start:end]
    n = len(s)
    digits = _digits(s)
    letters = sum(c.isalpha() for c in s)
    counts = {c: s.count(c) for c in set(s)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    groups = re.split(r"[^A-Za-z0-9]+", s)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    before = [w.lower() for w in _WORD_BEFORE.findall(text[max(0, start - 40) : start])][-3:]
    last, nxt = text[start - 1 : start], text[end : end + 1]
    year = len(digits) == 8 and re.search(r"(?:19|20)[0-9]{2}", s) is not None
    return [
        KINDS.index(kind),
        n,
        len(digits),
        len(digits) / n,
        letters / n,
        entropy,
        len(groups),
        max(map(len, groups)),
        min(map(len, groups)),
        switches / n,
        luhn(digits) if len(digits) > 11 else 0,
        mod97(s) if kind == "iban" else 0,
        all(c in "0123456789abcdefABCDEF" for c in s),
        any(c.isupper() for c in s) and any(c.islower() for c in s),
        sum(w in CUES_FOR for w in before),
        sum(w in CUES_AGAINST for w in before),
        last in "\"'=:",
        nxt in "\"'",
        last == "=" or text[max(0, start - 3) : start].strip(" \"'") in ("=", ":"),
        last.isalnum(),
        nxt.isalnum(),
        s[0] in "+(",
        year,
        s.count("/") + s.count("."),
    ]


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of the candidates in ``n`` made-up lines, half of which
    hold personal data and half something that looks like it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    hexa = lambda k: "".join("0123456789abcdef"[d] for d in rng.integers(0, 16, k))
    alnum = lambda k: "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[d] for d in rng.integers(0, 62, k))
    word = lambda: "".join(pick("bcdfglmnrst") + pick("aeiou") for _ in range(int(rng.integers(1, 4))))

    def iban(good: bool) -> str:
        body = num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}DE00")) % 97
        s = f"DE{check if good else (check + 13) % 97 + 2:02d}{body}"
        return pick([s, " ".join(s[i : i + 4] for i in range(0, 22, 4))])

    good = {
        "iban": (("iban", "account", "bank"), lambda: iban(True)),
        "mac": (("mac", "device", "from"), lambda: pick(":-").join(hexa(2) for _ in range(6))),
        "mail_words": (("write", "mail", "to"), lambda: f"{word()} {pick(['(at)', '[at]'])} {word()} {pick(['(dot)', '[dot]'])} {pick(['com', 'org', 'net'])}"),
        "number": (("phone", "tel", "call", "fax", "mobile"), lambda: pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(7)}", f"0{num(2)}/{num(8)}"])),
        "secret": (("token", "key", "secret", "password", "auth"), lambda: pick(['= "{}"', "={}", ": {}", ' "{}"']).format(pick([hexa, alnum])(int(rng.integers(20, 48))))),
        "ssn": (("ssn", "social", "number", "id"), lambda: f"{num(3)}-{num(2)}-{num(4)}"),
    }
    bad = {
        "iban": (("part", "order", "item"), lambda: iban(False)),
        "mac": (("at", "time", "took"), lambda: "-".join(num(2) for _ in range(6))),
        "mail_words": (("met", "seen"), lambda: f"{word()} (at) {word()}.{word()}{word()}{word()}"),
        "number": (("page", "total", "year", "pp", "isbn", "order"), lambda: pick([f"19{num(2)}-20{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"978-{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{num(3)} {num(3)} {num(3)}", num(16), num(12)])),
        "secret": (("commit", "checksum", "the", "see", "file"), lambda: pick([hexa(40), f"{word()}_{word()}_{word()}_{num(2)}", f"{word()}/{word()}/{word()}{num(3)}/{word()}", f"{word()}-{word()}-{num(4)}-{word()}", "=" * 20 + num(1)])),
        "ssn": (("part", "no", "item"), lambda: f"{num(3)} {num(2)} {num(4)}"),
    }
    x, y = [], []
    for i in range(n):
        kind = MORE_KINDS[i % len(MORE_KINDS)]
        true = bool(rng.integers(2))
        cues, make = (good if true else bad)[kind]
        cue = pick(cues) if rng.random() < 0.85 else word()
        left = " ".join(word() for _ in range(int(rng.integers(1, 6))))
        value = make()
        head = f"{left} {cue}{'' if value[:1] in '=:' else pick([' ', ': '])}"
        line = f"{head}{value} {word()} {word()}."
        for c in candidates(line):
            # A proposal that only grazes what was put in is wrong whatever it is.
            inside = c[1] >= len(head) - 1 and c[2] <= len(head) + len(value)
            whole = c[2] - c[1] >= 0.8 * len(value.strip(' =:"'))
            x.append(features(line, *c))
            y.append(true and inside and whole and c[0] == kind)
    return np.array(x, np.float64), np.array(y, np.int64)


@dataclass
class Boosted:
    """Complete trees of one depth: a feature and a cut for each inner node, a
    value for each leaf; then Platt scaling and a threshold for each kind."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    platt: tuple[float, float]
    threshold: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
            out += v[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * self.margin(x) + self.platt[1], -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32) -> Boosted:
    """Gradient boosting on the logistic loss, over quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), start)
    inner = (1 << depth) - 1
    features_, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            for j, e in enumerate(edges):
                if not len(e) or not len(rows):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))
                hs = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, float(e[k]))
            features_[t, node], cuts[t, node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        for leaf in range(inner + 1):
            rows = at == leaf + inner
            leaves[t, leaf] = rate * g[rows].sum() / (h[rows].sum() + 1)
        margin += leaves[t, at - inner]
    return Boosted(features_, cuts, leaves, start, (1.0, 0.0), {})


def calibrated(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Boosted:
    """Platt scaling, then for each kind the lowest threshold above which the
    wanted share is right (never under one half)."""
    z = np.stack([model.margin(x), np.ones(len(x))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - y) + 1e-3 * w)
    model.platt = (float(w[0]), float(w[1]))
    p = model.probability(x)
    for kind in MORE_KINDS:
        own = x[:, 0] == KINDS.index(kind)
        order = np.argsort(-p[own])
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        model.threshold[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return model


def fit(n: int = EXAMPLES, seed: int = 11) -> Boosted:
    """Trees on one half of ``n`` synthetic lines, calibration on the other."""
    return calibrated(boost(*examples(n // 2, seed)), *examples(n - n // 2, seed + 1))


def more_spans(text: str, model: Boosted, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the trees select, apart from ``taken`` and from each other: of
    two that overlap the likelier stays, then the earlier, longer, first listed."""
    proposed = candidates(text)
    if not proposed:
        return []
    x = np.array([features(text, *c) for c in proposed], np.float64)
    p = model.probability(x)
    sure = [(-p[i], c[1], -c[2], KINDS.index(c[0]), c) for i, c in enumerate(proposed) if p[i] >= model.threshold[c[0]]]
    if not sure:
        return []
    covered = np.zeros(len(text) + 1, bool)
    for _, a, b in taken:
        covered[a:b] = True
    out = []
    for *_, (kind, a, b) in sorted(sure):
        if not covered[a:b].any():
            covered[a:b] = True
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_spans(text: str | None, model: Boosted) -> list[tuple[str, int, int]]:
    text = text or ""
    base = base_spans(text)
    return base + more_spans(text, model, base)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the
    bracketed kind that starts first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def spans_column(text: Column, model: Boosted) -> Column:
    """array of (kind, start, end) for each whole text: base kinds first, then
    the others by name, each by start; in code points, end exclusive.  A null
    text counts as empty and has no spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind: string, start: long, end: long>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py(), model)] for t in texts], kind)

    return run(text)


def redact_column(text: Column, model: Boosted) -> Column:
    """Each text with its spans replaced by ``[KIND]``; a null text stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if (s := t.as_py()) is None else redact_text(s, find_spans(s, model)) for t in texts], pa.string())

    return run(text)
