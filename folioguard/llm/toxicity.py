"""Toxicity scores from bags of subwords.

Every character n-gram of a word, and the word itself, is a row of an embedding
table; a word is the mean of its rows and a text the mean of its words, which
goes into a linear softmax.  Table and softmax are trained jointly.  An unseen
misspelling shares most n-grams, and so most of its vector, with the word it
stands for.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
DIMENSIONS = 4
ORDERS = (3, 4, 5)
#: Of so many epochs one takes the texts as they are, the others misspelled copies.
COPIES = 4
#: The factor on bag weights, so that trained numbers stay of order one.
SCALE = 1000.0
#: Bounds of the labelled sample that the model is fitted on: rows with label 1,
#: rows with label 0, and characters of a sampled text.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 2000, 3000, 20_000
BLOCK_CHARS = 1 << 16
#: Rows of the table that a step updates at a time.
CHUNK = 1 << 15

_SEPARATES = np.zeros(128, bool)
_SEPARATES[:33] = True
_SEPARATES[[ord(c) for c in "\"#%&()+,-./:;<=>?[\\]^_`{|}~!"]] = True
_RNG = np.random.Generator(np.random.PCG64(5))
_FACTORS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(f"[^{re.escape(''.join(map(chr, np.flatnonzero(_SEPARATES))))}]+")
_LONGER_WORD = re.compile(r"[^\W\d_]{4,}")


def _bucket(h: np.ndarray, order: int) -> np.ndarray:
    h = (h + np.uint64(order)) * _MIX
    h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _blocks(text: str) -> Iterator[str]:
    """``text`` in parts that end at a space, where one is near enough."""
    at = 0
    while len(text) - at > BLOCK_CHARS:
        end = text.rfind(" ", at + 1, at + BLOCK_CHARS)
        end = at + BLOCK_CHARS if end < 0 else end
        yield text[at:end]
        at = end
    yield text[at:]


def subwords(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket of each n-gram, its word's number, number of words)."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = _SEPARATES[np.minimum(code, 127)] & (code < 128)
    code = np.where(gap, 32, code).astype(np.uint64)
    first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    if not len(first):
        return np.empty(0, np.int32), np.empty(0, np.int64), 0
    word = np.cumsum(np.concatenate([[False], ~gap[1:] & gap[:-1]])) - 1
    gaps = np.cumsum(gap)
    buckets, words = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, ORDERS[-1] + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] + code[n - 1 :] * _FACTORS[n - 1]
        if n in ORDERS:
            at = np.flatnonzero(gaps[n - 2 : n - 2 + m] == gaps[:m])  # no gap but at the ends
            buckets.append(_bucket(h[at], n))
            words.append(word[at + 1])
    place = np.arange(len(code)) - first[np.maximum(word, 0)]
    whole = np.add.reduceat(np.where(gap, np.uint64(0), code * _FACTORS[8 + place % 56]), first)
    buckets.append(_bucket(whole, 0))
    words.append(np.arange(len(first)))
    return np.concatenate(buckets), np.concatenate(words), len(first)


@dataclass
class Bags:
    """Words of some texts: the buckets of the distinct ones with the word's number of
    each, how many a word has, and the word and the text of each one said."""

    bucket: np.ndarray
    word: np.ndarray
    rows: np.ndarray
    said: np.ndarray
    text: np.ndarray
    share: np.ndarray  #: one by the number of words in that text

    @staticmethod
    def of(texts: list[str]) -> Bags:
        found = [_WORD.findall(t.lower()) for t in texts]
        index: dict[str, int] = {}
        said = np.array([index.setdefault(w, len(index)) for words in found for w in words], np.int64)
        lengths = np.array([len(words) for words in found], np.int64)
        bucket, word, n = subwords(" ".join(index))
        return Bags(bucket, word, np.bincount(word, minlength=n), said, np.repeat(np.arange(len(texts)), lengths), np.repeat(1 / np.maximum(lengths, 1), lengths))

    def means(self, row: np.ndarray, texts: int) -> np.ndarray:
        """Of each text the mean over words, repeats included, of the mean of ``row`` over
        their buckets."""
        words = np.bincount(self.word, row[self.bucket], len(self.rows)) / self.rows
        return np.bincount(self.text, words[self.said] * self.share, texts)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Of each bucket the sum of ``values`` of the texts, by its weight in their means."""
        words = np.bincount(self.said, values[self.text] * self.share, len(self.rows)) / self.rows
        return np.bincount(self.bucket, words[self.word], BUCKETS).astype(np.float32)


def misspelled(text: str, draw: random.Random) -> str:
    """``text`` with each word of four letters or more changed once behind its first
    letter: two inner letters swapped, an inner one left out or any one doubled."""

    def change(match: re.Match) -> str:
        w = match.group()
        how, at = int(3 * draw.random()), draw.random()
        if how == 2:
            i = 1 + int(at * (len(w) - 1))
            return w[: i + 1] + w[i:]
        i = 1 + int(at * (len(w) - 3))
        return w[:i] + (w[i + 1] + w[i] if how else "") + w[i + 1 + how :]

    return _LONGER_WORD.sub(change, text)


def longer_words(text: str) -> np.ndarray:
    """Where the words start and end that ``misspelled`` changes."""
    return np.array([m.span() for m in _LONGER_WORD.finditer(text)], np.int32).reshape(-1, 2)


def as_numpy(draw: random.Random) -> np.random.RandomState:
    """A generator of the numbers that ``draw.random()`` would give."""
    *key, at = draw.getstate()[1]
    same = np.random.RandomState()
    same.set_state(("MT19937", key, at))
    return same


def all_misspelled(texts: list[str], spans: list[np.ndarray], draw: np.random.RandomState) -> list[str]:
    """What ``misspelled`` makes of each text in turn, at once.  ``spans``: the
    ``longer_words`` of each."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    first, end = (np.concatenate(spans) + np.repeat(starts[:-1], list(map(len, spans)))[:, None]).T
    drawn = draw.random_sample((len(first), 2))
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    how = (3 * drawn[:, 0]).astype(np.int64)
    i = first + 1 + (drawn[:, 1] * (end - first - np.where(how == 2, 1, 3))).astype(np.int64)
    times = np.ones(len(code), np.int64)
    times[i[how == 0]] = 0
    times[i[how == 2]] = 2
    swap = i[how == 1]
    code[swap], code[swap + 1] = code[swap + 1], code[swap]
    ends = np.concatenate([[0], np.cumsum(times)])[starts[1:] - 1]
    made = np.repeat(code, times).tobytes().decode("utf-32-le", "surrogatepass")
    return [made[a:b] for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)]


@dataclass
class Model:
    """``weight``: what each bucket adds to a word's log-odds; ``scale`` and
    ``shift`` calibrate the mean over a text's words."""

    weight: np.ndarray
    scale: float
    shift: float

    def raw(self, text: str) -> float:
        """The mean over words of the mean of their rows; no words give zero."""
        total, words = 0.0, 0
        for block in _blocks(text):
            bucket, word, n = subwords(block)
            if n:
                value = self.weight[bucket]
                hit = np.flatnonzero(value)
                if len(hit):
                    total += float((value[hit] / np.bincount(word, minlength=n)[word[hit]]).sum())
                words += n
        return total / max(words, 1)

    def score(self, text: str) -> float:
        z = self.scale * self.raw(text) + self.shift
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def _adam(param: np.ndarray, grad: np.ndarray, m: np.ndarray, v: np.ndarray, rate: float, step: int) -> None:
    """One step of Adam in place; ``grad`` is used up."""
    m *= 0.9
    m += 0.1 * grad
    grad *= grad
    grad *= 0.01
    v *= 0.99
    v += grad
    np.multiply(v, 1 / (1 - 0.99**step), out=grad)
    np.sqrt(grad, out=grad)
    grad += 1e-5
    np.divide(m, grad, out=grad)
    grad *= rate / (1 - 0.9**step)
    param -= grad


def train(texts: list[str], labels: np.ndarray, *, epochs: int = 18, batch: int = 64, rate: float = 0.02, shrink: float = 0.25, seed: int = 1) -> Model:
    """Fit the table and the softmax jointly with Adam on the cross-entropy, at a
    falling rate.  After each step every row is shortened by ``rate * shrink`` (down
    to zero: a group lasso), so rows whose gradients do not keep a direction vanish.
    Bags are made batch by batch, of distinct words, so the driver holds the texts and
    the table alone.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    draw, spans = as_numpy(random.Random(seed)), [longer_words(t) for t in texts]
    labels = np.asarray(labels, np.int64)
    if not len(texts) or labels.min() == labels.max():  # one class only: that class, for any text
        return Model(np.zeros(BUCKETS), 1.0, 4.0 if len(texts) and labels.max() else -4.0)
    table = np.ascontiguousarray(rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)).astype(np.float32).T)
    soft = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, soft, bias)]
    step, steps = 0, epochs * -(-len(texts) // batch)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            read = [texts[i] for i in own]
            bags = Bags.of(all_misspelled(read, [spans[i] for i in own], draw) if epoch % COPIES else read)
            hidden = np.stack([SCALE * bags.means(row, len(own)) for row in table], axis=1).astype(np.float32)
            logits = hidden @ soft + bias
            off = np.exp(logits - logits.max(axis=1, keepdims=True))
            off /= off.sum(axis=1, keepdims=True)
            off[np.arange(len(own)), labels[own]] -= 1
            off = (off / len(own)).astype(np.float32)
            # With two labels all gradients of rows lie along one direction.
            along, slope = soft[:, 1] - soft[:, 0], bags.spread(SCALE * off[:, 1])
            now = rate * (1 - step / steps)
            step += 1
            for param, grad, (m, v) in zip((soft, bias), (hidden.T @ off, off.sum(axis=0)), moments[1:], strict=True):
                _adam(param, grad, m, v, now, step)
            m, v = moments[0]
            for low in range(0, BUCKETS, CHUNK):
                part = slice(low, low + CHUNK)
                for d in range(DIMENSIONS):
                    _adam(table[d, part], along[d] * slope[part], m[d, part], v[d, part], now, step)
                length = np.sqrt(np.einsum("ij,ij->j", table[:, part], table[:, part])) + np.float32(1e-12)
                table[:, part] *= np.maximum(0, 1 - now * shrink / length)
    odds = SCALE * ((soft[:, 1] - soft[:, 0]) @ table).astype(np.float64)
    return Model(odds, 1.0, float(bias[1] - bias[0]))


def calibrate(model: Model, texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Logistic scale and shift for the mean of a text, by Newton steps; a row
    counts as often as its weight says."""
    x = np.array([model.raw(t) for t in texts])
    spread = x.std() or 1.0
    z = np.stack([x / spread, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weights * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-3])
        w -= np.linalg.solve(hessian, z.T @ (weights * (p - labels)) + np.array([1e-2, 1e-3]) * w)
    return Model(model.weight, float(w[0] / spread), float(w[1]))


def trained(texts: list[str], labels: np.ndarray, counts: tuple[int, int] | None = None) -> Model:
    """A model of all rows.  Its scale and shift are those that a model of four fifths
    of them needs on the fifth that it has not seen, where each label weighs as in
    ``counts``, the numbers of all rows with label 0 and 1 (None: as in ``labels``).
    Where a part would lack a label, all rows serve both ends."""
    labels = np.asarray(labels, np.int64)
    apart = np.arange(len(labels)) % 5 == 4
    if not len(labels) or any(len(set(part.tolist())) < 2 for part in (labels[apart], labels[~apart])):
        apart = np.ones(len(labels), bool)
        model = whole = train(texts, labels)
    else:
        with ThreadPoolExecutor(2) as both:
            part = both.submit(train, [t for t, a in zip(texts, apart, strict=True) if not a], labels[~apart])
            whole, model = train(texts, labels), part.result()
    if not len(labels) or labels.min() == labels.max():
        return model
    own = labels[apart]
    have = np.bincount(own, minlength=2)
    share = np.array(counts if counts else np.bincount(labels, minlength=2), float)
    weights = (share / share.sum() * len(own) / have)[own]
    model = calibrate(model, [t for t, a in zip(texts, apart, strict=True) if a], own, weights)
    return Model(whole.weight, model.scale, model.shift)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_toxic: int = MOST_TOXIC,
    most_clean: int = MOST_CLEAN,
    most_chars: int = MOST_CHARS,
) -> Model:
    """Train on a bounded sample of the labelled rows, drawn by a hash of the key.

    At most ``most_toxic`` rows with label 1 and ``most_clean`` with label 0,
    texts of at most ``most_chars`` characters each, reach the driver.  The labels
    of all rows are counted, and calibration weighs the sample by these counts,
    so the threshold of one half means the same at every size.  A key with both
    labels is toxic; of several texts with one key the smallest is taken.  Null
    labels, keys and texts are not sampled.  Without labels of both kinds the
    model gives every text the same score.
    """
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    numbers = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.length("text").between(1, most_chars))
    drawn = [known.where(F.col("label") == kind).orderBy(F.xxhash64("id"), "id").limit(most) for kind, most in ((1, most_toxic), (0, most_clean))]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most most_toxic + most_clean rows
    rows = texts.join(sample, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: r["id"])
    return trained([r["text"] for r in rows], np.array([r["label"] for r in rows], np.int64), (numbers.get(0, 0), numbers.get(1, 0)))


def score_column(text: Column, model: Model) -> Column:
    """The score of each whole text, 0 to 1; a null text scores as an empty one, and
    so does one without words.  Equal texts have equal scores, whatever their rows;
    long texts are read in blocks, which does not change a score beyond rounding."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py() or "") for t in texts], pa.float64())

    return run(text)
