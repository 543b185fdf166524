"""Toxicity by a gap-weighted subsequence kernel and a support vector machine on Nyström landmarks.

The kernel of two words counts their common subsequences of three letters (the word's two ends count as letters), each
weighted by how far it is spread out, so a word with letters put between or an ending of its own stays close to the
word it comes from.  The kernel sees gaps of up to three characters in all, so words with other characters between their
letters are also read without them, and letters that stand alone are joined.  Landmarks are words that mark toxic training documents, spread out by the kernel itself, and common
words beside them.  A sentence is as bad as its worst word and a document as its worst sentence; a linear support vector
machine on the landmarks' whitened kernel is trained on the worst sentences of labelled documents, picked anew as it gets
better.  As the kernel has an explicit feature map, the machine is one weight for each subsequence when it scores.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged

DECAY, SPAN = 0.7, 7
LETTERS = 32
#: Number of subsequences of four letters.
KEYS = LETTERS**4
LANDMARKS, COMMON = 128, 32
#: Bounds of the training sample: documents of each label, taken in the order of a hash of their doc_id.
FIT_TOXIC, FIT_CLEAN = 2000, 4000
CANDIDATES, MIN_DOCS = 4000, 4
MAX_LIKENESS = 0.8
#: Rounds of training, weight of the margin, and words that a document shows of itself.
ROUNDS, PENALTY, SHOWN = 4, 0.01, 3
THRESHOLD = 0.3
CACHE_WORDS = 400_000
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‚‘’…¿¡*_~`-#%&$+=/\\|^@"


#: Letters of words, the longest landmarks, and words valued at once.
PIECE, LONGEST, AT_ONCE = re.compile(r"[^\W\d_]+"), 24, 200_000
#: Three or more letters that stand alone, with anything but letters between them.
SPELLED = re.compile(r"(?<![^\W\d_])[^\W\d_](?![^\W\d_])(?:[\W\d_]++[^\W\d_](?![^\W\d_])){2,}+")
SPELLED_BLOCK = 4096


def words_of_text(text: str | None) -> set[str]:
    """The distinct words of a text, lower case, without punctuation at their ends; those with other characters between letters also in pieces and joined."""
    out = {c.strip(_EDGE) for c in set(text.lower().split())} if text else set()
    for word in [w for w in out if not w.isalpha()]:
        pieces = PIECE.findall(word)
        out.update(p for p in pieces if len(p) > 1)
        out.add("".join(pieces))
    out.discard("")
    return out


def spelled(text: str | None) -> list[str]:
    """Runs of letters that stand alone (i d i o t, i--d--i--o--t), joined; gaps may have any length."""
    return ["".join(PIECE.findall(run)) for run in SPELLED.findall(text.lower())] if text else []


def parts_of_text(text: str | None) -> Iterator[set[str]]:
    """What is valued of a text: its words, and by blocks all words of up to ``LONGEST`` letters that its spelled runs can hold."""
    yield words_of_text(text)
    for run in spelled(text):
        for lo in range(0, len(run), SPELLED_BLOCK):
            block = run[lo : lo + SPELLED_BLOCK + LONGEST - 1]
            yield {block[k : k + n] for n in range(3, LONGEST + 1) for k in range(len(block) - n + 1)}


def _codes(word: str) -> np.ndarray:
    """Letters as numbers below ``LETTERS``: the two ends, a-z apart, all others by their code point."""
    at = np.frombuffer(word.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    return np.where((at >= 97) & (at <= 122), at - 97, np.where(at == _START, 26, np.where(at == _END, 27, 28 + at % (LETTERS - 28))))


_START, _END = 1, 2  # control characters that stand for a word's ends

#: Places of four letters within a span, relative to the first, and their weights.
_STEPS = [(j, k, n, DECAY ** (n + 1)) for n in range(3, SPAN) for k in range(2, n) for j in range(1, k)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse feature maps of words: (word, subsequence, weight), one row for each subsequence of a word, norm 1 for each word."""
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = _codes("".join(f"{chr(_START)}{w}{chr(_END)}" for w in words))
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # letters from here to the word's end
    owner, keys, weights = [], [], []
    for j, k, n, weight in _STEPS:
        at = np.flatnonzero(left > n)
        owner.append(word[at])
        keys.append(((codes[at] * LETTERS + codes[at + j]) * LETTERS + codes[at + k]) * LETTERS + codes[at + n])
        weights.append(np.full(len(at), weight))
    owner, keys, weights = np.concatenate(owner), np.concatenate(keys), np.concatenate(weights)
    joint, where = np.unique(owner * KEYS + keys, return_inverse=True)
    weight = np.bincount(where, weights, len(joint))
    owner, keys = joint // KEYS, joint % KEYS
    norm = np.sqrt(np.bincount(owner, weight**2, len(words)))
    return owner, keys, weight / norm[owner]


class Landmarks:
    """Words whose feature maps lie side by side, as a matrix over the subsequences that any of them has."""

    def __init__(self, words: list[str]):
        self.words = words
        owner, keys, weight = features(words)
        self.keys, row = np.unique(keys, return_inverse=True)
        self.place = np.full(KEYS, -1, dtype=np.int32)
        self.place[self.keys] = np.arange(len(self.keys))
        self.maps = np.zeros((len(self.keys), len(words)), dtype=np.float32)
        self.maps[row, owner] = weight

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each word with each landmark."""
        out = np.zeros((len(words), len(self.words)))
        for lo in range(0, len(words), 1024):
            owner, keys, weight = features(words[lo : lo + 1024])
            known = self.place[keys] >= 0
            owner, rows = owner[known], self.maps[self.place[keys[known]]] * weight[known, None]
            if len(owner):
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                out[lo + owner[first]] = np.add.reduceat(rows, first, axis=0)
        return out


class Reader:
    """Values of words, each distinct word computed once."""

    def __init__(self, value: Callable[[list[str]], np.ndarray], none: float):
        self.value, self.none, self.known = value, none, {}

    def worst(self, documents: list[set[str]]) -> list[list[tuple[float, str]]]:
        """For each document its ``SHOWN`` words of the largest values, largest first; a document without words has one empty word."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = list(set().union(*documents) - self.known.keys())
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            self.known.update(zip(part, self.value(part).tolist(), strict=True))
        get = self.known.__getitem__
        return [nlargest(SHOWN, zip(map(get, words), words, strict=True)) or [(self.none, "")] for words in documents]

    def worst_of_texts(self, texts: list[str | None]) -> list[list[tuple[float, str]]]:
        """:meth:`worst` of texts, whose parts are valued ``AT_ONCE`` words or so at a time."""
        best: list[list[tuple[float, str]]] = [[] for _ in texts]
        owners, parts, size = [], [], 0

        def flush() -> None:
            for k, values in zip(owners, self.worst(parts), strict=True):
                best[k] = nlargest(SHOWN, {*best[k], *values}) if best[k] else values

        for k, text in enumerate(texts):
            for part in parts_of_text(text):
                owners.append(k)
                parts.append(part)
                size += len(part)
                if size >= AT_ONCE:
                    flush()
                    owners, parts, size = [], [], 0
        flush()
        return best


@dataclass
class Linear:
    """One weight for each subsequence (those with any), and a bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def value(self) -> Callable[[list[str]], np.ndarray]:
        dense = np.zeros(KEYS, dtype=np.float32)
        dense[self.keys] = self.weights

        def run(words: list[str]) -> np.ndarray:
            owner, keys, weight = features(words)
            return np.bincount(owner, dense[keys] * weight, len(words)) + self.bias

        return run


@dataclass
class Nearest:
    """The largest kernel with a landmark, times how much that landmark tells: what training starts from."""

    words: list[str]
    tells: np.ndarray
    bias: float = 0.0

    def value(self) -> Callable[[list[str]], np.ndarray]:
        landmarks = Landmarks(self.words)
        return lambda words: (landmarks.kernel(words) * self.tells).max(axis=1)


@dataclass
class Model:
    """The machine, and how the two largest values of a document turn into a probability."""

    machine: Linear
    curve: np.ndarray

    def probability(self, first: Column, second: Column) -> Column:
        return 1 / (1 + F.exp(-(first * float(self.curve[0]) + second * float(self.curve[1]) + float(self.curve[2]))))


def _worst(docs: DataFrame, machine: Linear | Nearest, extra: str) -> DataFrame:
    """doc_id, ``extra``, the document's worst words and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(machine.value(), machine.bias)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                worst = reader.worst_of_texts(batch.column(2).to_pylist())
                words, values = [[w for _, w in x] for x in worst], [[v for v, _ in x] for x in worst]
                columns = [batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string())), pa.array(values, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", extra, "words", "worst"])

    return docs.select(F.col("doc_id").cast("long"), F.col(extra).cast("int"), "text").mapInArrow(run, f"doc_id long, {extra} int, words array<string>, worst array<double>")


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never looked at."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded training sample: doc_id, text and y."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = F.xxhash64("doc_id")
    some = known.where("y = 1").orderBy(order, "doc_id").limit(FIT_TOXIC).union(known.where("y = 0").orderBy(order, "doc_id").limit(FIT_CLEAN))
    return staged(docs.select("doc_id", "text").join(some, "doc_id"))


def _landmarks(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Words of toxic documents by how much they tell, each unlike those before it, and common words of clean ones; and what each tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = [], []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = sorted(w for w in words_of_text(text.as_py()).union(spelled(text.as_py())) if 3 <= len(w) <= LONGEST)
                words += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64())], ["word", "y"])

    counts = staged(sample.select("text", "y").mapInArrow(run, "word string, y long").groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = max(n.get(1, 0), 1), max(n.get(0, 0), 1)
    tells = F.log((F.col("t") + 0.5) / n1) - F.log((F.col("c") + 0.5) / n0)
    marked = counts.where((F.col("t") >= MIN_DOCS) & (tells > 1)).select("word", tells.alias("tells")).orderBy(F.desc("tells"), "word").limit(CANDIDATES).collect()
    common = counts.orderBy(F.desc("c"), "word").limit(COMMON).collect()
    chosen: list[str] = []
    having: dict[int, dict[int, float]] = defaultdict(dict)  # subsequence: landmark: weight
    for word in [r["word"] for r in marked]:
        if len(chosen) == LANDMARKS - COMMON:
            break
        _, keys, weight = features([word])
        like: Counter = Counter()
        for key, x in zip(keys.tolist(), weight.tolist(), strict=True):
            for k, y in having[key].items():
                like[k] += x * y
        if max(like.values(), default=0.0) < MAX_LIKENESS:
            for key, x in zip(keys.tolist(), weight.tolist(), strict=True):
                having[key][len(chosen)] = x
            chosen.append(word)
    told = {r["word"]: r["tells"] for r in marked}
    words = chosen + [r["word"] for r in common if r["word"] not in chosen]
    return words, np.array([told[w] if w in chosen else 0.0 for w in words])


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, by Newton steps on the active rows."""
    x = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        if not active.any():
            break
        a, c = x[active], cost[active][:, None]
        new = np.linalg.solve(np.diag(ridge) + a.T @ (a * c), a.T @ (y[active] * cost[active]))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def _curve(values: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over the two largest values of each document, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([values, np.ones((len(values), 1))])
    w, ridge = np.array([1.0, 0.0, 0.0]), np.array([1e-2, 1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (target - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return np.maximum(w, [1e-3, 0.0, -np.inf])


def _two(worst: list[float]) -> tuple[float, float]:
    return worst[0], worst[min(1, len(worst) - 1)]


def _constant(bias: float) -> Model:
    return Model(Linear(np.zeros(0, dtype=np.int64), np.zeros(0), bias), np.array([1.0, 0.0, 0.0]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the bounded sample; what the driver gets is ``SHOWN`` words for each sampled document.

    Without labels of both kinds the model is a constant.
    """
    sample = _sample(docs, labels)
    words, tells = _landmarks(sample)
    if not words:
        return _constant(-3.0)
    landmarks = Landmarks(words)
    value, vector = np.linalg.eigh(landmarks.kernel(words))
    whiten = vector / np.sqrt(np.maximum(value, 1e-3))
    machine: Linear | Nearest = Nearest(words, tells)
    against: Counter = Counter()
    for _ in range(ROUNDS):
        rows = _worst(sample, machine, "y").collect()
        toxic = sorted(r["words"][0] for r in rows if r["y"])
        for r in rows:
            if not r["y"]:  # words of clean documents stay on, each as often as it was among the worst, so that none comes back
                against.update(r["words"])
        if not toxic or not against:
            return _constant(3.0 if toxic else -3.0)
        clean = sorted(against)
        y = np.repeat([1.0, -1.0], [len(toxic), len(clean)])
        times = np.array([against[w] for w in clean], dtype=np.float64)
        cost = np.concatenate([np.full(len(toxic), 0.5 / len(toxic)), 0.5 * times / times.sum()]) * len(y)
        w = _svm(landmarks.kernel(toxic + clean) @ whiten, y, cost, PENALTY * len(y) / 100)
        machine = Linear(landmarks.keys, landmarks.maps @ (whiten @ w[:-1]), float(w[-1]))
    rows = _worst(sample, machine, "y").select("doc_id", "y", "worst").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["worst"]))
    return Model(machine, _curve(np.array([_two(r["worst"]) for r in rows]), np.array([1.0 if r["y"] else -1.0 for r in rows])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, held_out, score, predicted, words (the worst ones).

    Null and empty texts score as a text without any word near a landmark.  Rows are scored one by one: repeated rows
    and null ids come back as they are (a null id is not held out); other columns are ignored.
    """
    marked = docs.select("doc_id", held_out("doc_id").cast("int").alias("held"), "text")
    p = model.probability(F.get("worst", F.lit(0)), F.coalesce(F.get("worst", F.lit(1)), F.get("worst", F.lit(0))))
    return (
        _worst(marked, model.machine, "held")
        .select("doc_id", (F.col("held") == 1).alias("held_out"), p.alias("score"), "words")
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )
