"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares words by their gap-weighted subsequences of three letters:
``phi_abc(w)`` sums ``DECAY ** gaps`` over the places where a, b, c occur in
order within a span of ``SPAN`` letters, and k(v, w) is the cosine of two such
maps.  An insult keeps most of its subsequences when letters are inserted,
dropped or replaced.  Words are letters only: signs inside a word are taken out
(``i.d!ot``), digits that stand for letters are read as these, runs of single
letters are joined (``i d i o t``), and long words are read in windows.

Landmarks are words of the labelled sentences: those most associated with
either label, and frequent others.  A word's features are its kernel values to
the landmarks, whitened by the landmarks' own kernel matrix (Nyström).
A linear squared-hinge machine learns from witnesses: of the toxic texts all
words that stand out by their counts, or look worse than what nearly all clean
texts hold, chosen anew each round, against the worst words of the clean texts.
Witnesses with a letter put in count as toxic too.  A logistic fit turns
the three highest margins of a text's different words, and its length, into a
probability.  A word that shares no
subsequence with a landmark has the margin of an empty text.

Learning takes at most ``max_rows`` labelled texts of each label, the smallest
by a hash of the id, and reads them whole.  In the logistic fit
they are weighted to the labels' shares among all labelled ids, so that scores
do not follow the bound.  Scoring reads whole texts.

Cases: a null or empty text scores as one without any known word.  With no labelled
text of one of the labels, all scores are the share of toxic labels (0 with none).
Repeated rows get equal scores; a null id is scored and never learned from.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from regionframe.llm.arrow import slices, tidy
from regionframe.llm.store import modest_batches
from regionframe.llm.text import ENTRY, Memo

SPAN, DECAY = 6, 0.75
#: Letters of a word read at once, and the step between windows of longer words.
WINDOW, STEP = 14, 5
#: Texts times log odds by which a word has to stand out to be a first witness.
STANDS_OUT, LOG_ODDS = 10.0, 2.5
#: What a toxic text with a letter put into its worst word weighs in the logistic fit.
STRETCHED_WEIGHT = 0.005
_ALPHABET = 64
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_DECAYS = DECAY ** np.arange(SPAN - 2)
_LAST = 1 << 30
_PARTS = re.compile(r"[^\W_]+")
#: Digits and signs that stand for letters (fixed values).
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_ACCENTS = re.compile("[\u0300-\u036f]")
_INNER = re.compile(r"(?<=[^\W\d_])[013457@$!](?=[^\W\d_])")


def _letters(word: str) -> str:
    plain = _ACCENTS.sub("", unicodedata.normalize("NFKD", word.casefold()))
    return plain if plain.isalpha() else "".join(c for c in plain if c.isalpha())


def units(token: str) -> list[str]:
    """The words that a white-space token is read as."""
    plain = token.rstrip(".,;:!?#*$%&|")  # at the end they stand for no letter
    if plain.isascii() and plain.isalpha() and len(plain) <= WINDOW:
        return [plain.lower()]
    token = _INNER.sub(lambda m: m[0].translate(_SIGNS), token)
    parts = [p for p in (_letters(x) for x in _PARTS.findall(token)) if p]
    if len(parts) > 1:
        whole = "".join(parts)
        parts = ([] if max(map(len, parts)) <= 2 else parts) + [whole]
    out = []
    for p in parts:
        out += [p] if len(p) <= WINDOW else [p[k : k + WINDOW] for k in range(0, len(p) - WINDOW + STEP, STEP)]
    return out


def _codes(words: list[str]) -> np.ndarray:
    """words x WINDOW letter codes, -1 past the end."""
    out = np.full((len(words), WINDOW), -1, np.int32)
    for k, w in enumerate(words):
        c = [ord(x) - 97 if "a" <= x <= "z" else 26 + ord(x) % (_ALPHABET - 26) for x in w[:WINDOW]]
        out[k, : len(c)] = c
    return out


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers (-1: none), for each word, and their numbers of gaps."""
    n = codes.shape[1]
    cols, gaps = [], []
    for i, j in _OFFSETS:
        a, b, c = codes[:, : n - j], codes[:, i : n - j + i], codes[:, j:]
        cols.append(np.where(c >= 0, (a * _ALPHABET + b) * _ALPHABET + c, -1))
        gaps += [j - 2] * (n - j)
    return np.concatenate(cols, 1), np.array(gaps, np.int32)


def _weights(f: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Weights of the occurrences, over the length of the word's feature map.

    A subsequence that occurs twice in a word adds up before it is squared.
    """
    key = np.sort(np.where(f >= 0, f * 4 + gaps, _LAST), 1)
    value = np.where(key == _LAST, 0, _DECAYS[key & 3])
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] >> 2 != key[:, :-1] >> 2
    starts = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(value.ravel(), starts)
    square = np.bincount(starts // key.shape[1], sums * sums, minlength=len(f))
    return (_DECAYS[gaps] / np.sqrt(np.maximum(square, 1e-9))[:, None]).astype(np.float32)


class Landmarks:
    """Kernel values against fixed words, by an inverted table of their subsequences."""

    CHUNK = 1000

    def __init__(self, words: list[str]):
        self.words = words
        f, gaps = _features(_codes(words))
        unit = _weights(f, gaps)
        codes = np.unique(f[f >= 0])
        self.slot = np.zeros(_ALPHABET**3 + 1, np.int32)  # the last one is for -1
        self.slot[codes] = np.arange(1, len(codes) + 1)
        self.rows = np.zeros((len(codes) + 1, len(words)), np.float32)
        np.add.at(self.rows, (self.slot[f], np.arange(len(words))[:, None]), unit)
        self.rows[0] = 0

    def _each(self, words: list[str]):
        for k in range(0, len(words), self.CHUNK):
            f, gaps = _features(_codes(words[k : k + self.CHUNK]))
            yield self.slot[f], _weights(f, gaps)

    def kernel(self, words: list[str]) -> np.ndarray:
        """words x landmarks."""
        out = [np.zeros((0, len(self.words)), np.float32)]
        for slot, unit in self._each(words):
            part = np.zeros((len(slot), len(self.words)), np.float32)
            at, col = np.nonzero(slot)
            if len(at):
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                part[at[starts]] = np.add.reduceat(self.rows[slot[at, col]] * unit[at, col, None], starts)
            out.append(part)
        return np.concatenate(out)

    def linear(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """kernel(words) @ weights, without the matrix."""
        table = (self.rows @ weights).astype(np.float32)
        return np.concatenate([np.zeros(0, np.float32), *((table[slot] * unit).sum(1) for slot, unit in self._each(words))])


def spelled(tokens: list[str]) -> list[str]:
    """Words made of runs of three or more single letters."""
    out, run = [], []
    for t in [*tokens, ""]:
        part = _letters(t) if len(t) <= 3 else ""
        if len(part) == 1:
            run.append(part)
            continue
        if len(run) >= 3:
            out += units("".join(run))
        run = []
    return out


@dataclass
class ToxicityModel:
    words: list[str]
    whiten: np.ndarray
    weight: np.ndarray
    bias: float
    #: weights of evidence()'s numbers and a shift, of the logistic fit
    fit: np.ndarray

    def __post_init__(self):
        self.linear = self.whiten @ self.weight if len(self.words) else np.zeros(0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[evidence, np.ones(len(evidence))] @ self.fit, -40, 40)))


def evidence(margins, bias: float, words: int) -> list[float]:
    """Of a text: the three highest margins of its different words, and its length."""
    top = sorted(margins, reverse=True)[:3] if len(margins) < 8 else heapq.nlargest(3, margins)
    return [max(x, bias) for x in top] + [bias] * (3 - len(top)) + [math.log1p(words)]


class Scorer:
    """Scores texts; keeps the margins of the tokens it has met, up to LIMIT bytes in two generations."""

    LIMIT = 48 << 20

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.marks = Landmarks(model.words) if model.words else None
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}
        self.used = 0

    def _learn(self, tokens: set[str]) -> None:
        tokens = sorted(tokens)
        parts = [units(t) for t in tokens]
        margin = self._words([w for p in parts for w in p])
        at = 0
        for t, p in zip(tokens, parts, strict=True):
            self.known[t] = max(margin[at : at + len(p)], default=self.model.bias)
            at += len(p)

    def _words(self, words: list[str]) -> list[float]:
        return (self.marks.linear(words, self.model.linear) + self.model.bias).tolist() if words else []

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of each text."""
        out = []
        split = [(t or "").split() for t in texts]
        if self.marks is not None:
            if 2 * self.used > self.LIMIT:
                self.known, self.older, self.used = {}, self.known, 0
            new = {x for s in split for x in s} - self.known.keys()
            self.used += sum(map(len, new)) + ENTRY * len(new)
            again = new & self.older.keys()
            self.known |= {t: self.older[t] for t in again}
            self._learn(new - again)
        for text, tokens in zip(texts, split, strict=True):
            margins = []
            if self.marks is not None and tokens:
                margins = list(map(self.known.__getitem__, set(tokens)))
                if _RUN.search(text):
                    margins += self._words(spelled(tokens))
            out.append(evidence(margins, self.model.bias, len(tokens)))
        return self.model.probability(np.array(out).reshape(-1, 4))


_RUN = re.compile(r"(?:(?<!\S)[^\W\d_]\W{0,2}\s+){2}[^\W\d_]\W{0,2}(?!\S)")


def _machine(x: np.ndarray, y: np.ndarray, times: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear squared-hinge machine, by Newton steps; a row counts ``times``, and classes weigh the same."""
    c = cost * times * np.where(y > 0, 0.5 / max(1, times[y > 0].sum()), 0.5 / max(1, times[y < 0].sum())) * times.sum()
    w = np.zeros(x.shape[1] + 1)
    reg = np.r_[np.ones(x.shape[1]), 1e-3]
    for _ in range(40):
        grad, curve = reg * w, np.diag(reg)
        for k in range(0, len(x), 4096):  # rows within the margin, a few at a time
            z = np.c_[x[k : k + 4096], np.ones(len(x[k : k + 4096]))].astype(float)
            slack = 1 - y[k : k + 4096] * (z @ w)
            on = slack > 0
            z, slack, side = z[on], slack[on], y[k : k + 4096][on]
            scaled = z * c[k : k + 4096][on, None]
            grad -= (side * slack) @ scaled
            curve += z.T @ scaled
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights and shift of a logistic fit with a slight prior."""
    z = np.c_[x, np.ones(len(x))]
    w, reg = np.zeros(z.shape[1]), 1e-2 * np.eye(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (weights * p * (1 - p))[:, None]) + reg, z.T @ (weights * (p - y)) + reg @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def stretched(word: str) -> list[str]:
    """The word with one letter put in, at each inner place (the letter varies with the place)."""
    return [word[:k] + "xqzvj"[k % 5] + word[k:] for k in range(1, len(word))]


def train(rows: list[tuple[str | None, int]], landmarks: int = 96, rounds: int = 4, counts: tuple[int, int] | None = None) -> ToxicityModel:
    """Learn from (text, 0 or 1) pairs, on the driver; they stand for ``counts`` texts of label 0 and 1 (as many as there are)."""
    y = np.array([1 if v else 0 for _, v in rows])
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    c0, c1 = counts or (n0, n1)
    if not n1 or not n0:
        share = c1 / (c0 + c1) if c0 + c1 else 0.0
        return ToxicityModel([], np.zeros((0, 0)), np.zeros(0), 0.0, np.array([0, 0, 0, 0, math.log(max(share, 1e-9) / max(1 - share, 1e-9))]))
    of = Memo(units)
    words, sizes, marked = [], [], []  # of each text its different words, its length, and a mark that copies share
    for t, _ in rows:
        tokens = (t or "").split()
        doc = [u for x in tokens for u in of[x]] + spelled(tokens)
        words.append(frozenset(doc))
        sizes.append(len(tokens))
        marked.append(hashlib.blake2b(" ".join(doc).encode("utf-8", "surrogatepass"), digest_size=16).digest())
    seen = [Counter(), Counter()]
    for doc, label in {m: (d, v) for m, d, v in zip(marked, words, y, strict=True)}.values():  # copies count once
        seen[label].update({u for u in doc if len(u) >= 3})
    odds = {u: math.log((c + 0.5) / (n1 + 1)) - math.log((seen[0][u] + 0.5) / (n0 + 1)) for u, c in seen[1].items()}
    odds |= {u: math.log(0.5 / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1)) for u, c in seen[0].items() if u not in odds}
    # how far a word stands out with either label, beyond LOG_ODDS
    value = lambda u: seen[1][u] * (odds[u] - LOG_ODDS) if odds[u] > LOG_ODDS else min(0.0, seen[0][u] * (odds[u] + LOG_ODDS))
    ranked = sorted(odds, key=lambda u: (-value(u), u))
    common = sorted(seen[0], key=lambda u: (-seen[0][u], u))
    picked = list(dict.fromkeys([*ranked[: 2 * landmarks // 3], *ranked[: -landmarks // 6 : -1], *common[: landmarks // 6]]))
    marks = Landmarks(picked)
    own = marks.kernel(picked).astype(float)
    own = (own + own.T) / 2
    values, vectors = np.linalg.eigh(own)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    vocabulary = sorted({u for doc in words for u in doc})
    row = {u: k for k, u in enumerate(vocabulary)}
    typical = np.array([max(0.0, value(u)) for u in picked])
    strong, first = [np.zeros(0, bool)], [np.zeros(0)]
    for k in range(0, len(vocabulary), 5_000):  # neither the kernel nor the features of all words are held at once
        part = marks.kernel(vocabulary[k : k + 5_000])
        strong.append(part.any(1))
        first.append((part * part * typical).max(1))
    strong = np.concatenate(strong)
    spelling = [*vocabulary, ""]  # the last one is any unlike word

    def feats(spelt: list[str]) -> np.ndarray:
        return marks.kernel(spelt) @ whiten.astype(np.float32)

    x = [np.array([*sorted({row[u] for u in doc if strong[row[u]]}), len(vocabulary)], np.int32) for doc in words]
    del words, of
    # the first witness is the word nearest to one typical of the label
    margin = np.r_[np.concatenate(first), 0.0]
    clean_of = [d for d, v in zip(x, y, strict=True) if not v]
    toxic_of = [d for d, v in zip(x, y, strict=True) if v]
    known = np.array([u in odds and value(u) > STANDS_OUT for u in vocabulary] + [False])
    usual = STANDS_OUT
    held = np.concatenate(toxic_of)
    for _ in range(rounds):
        on = (margin > usual) | known
        toxic = held[on[held]] if on[held].any() else held
        some, times = np.unique(toxic, return_counts=True)
        bent = [v for i, n in zip(some.tolist(), times.tolist(), strict=True) if i < len(vocabulary) and n > 2 for v in stretched(vocabulary[i])]
        clean = np.unique(np.concatenate([d[np.argsort(-margin[d], kind="stable")[:5]] for d in clean_of]))
        spelt = [spelling[i] for i in some] + bent + [spelling[i] for i in clean]
        label = np.r_[np.ones(len(some) + len(bent)), -np.ones(len(clean))]
        weight, bias = _machine(feats(spelt), label, np.r_[times, np.ones(len(bent) + len(clean))])
        margin = np.r_[marks.linear(vocabulary, whiten @ weight), 0.0] + bias
        usual = np.quantile([margin[d].max() for d in clean_of], 0.99)
    seen_by = [evidence(margin[d], bias, n) for d, n in zip(x, sizes, strict=True)]
    # toxic texts once more, with a letter put into their worst word and nothing else against them
    top = [(spelling[d[margin[d].argmax()]], n) for d, n, v in zip(x, sizes, y, strict=True) if v and margin[d].max() > 0]
    top = [(word, n) for word, n in top if len(word) > 2]
    bent = [stretched(word)[len(word) // 2 - 1] for word, _ in top]
    low = marks.linear(bent, whiten @ weight) + bias
    seen_by += [evidence([float(v)], bias, n) for v, (_, n) in zip(low, top, strict=True)]
    # each label weighs as much as it has of all labelled texts
    of_label = np.array([c0 / n0, c1 / n1]) * len(y) / (c0 + c1)
    labels, weights = np.r_[y, np.ones(len(bent), int)], np.r_[of_label[y], np.full(len(bent), STRETCHED_WEIGHT * of_label[1])]
    return ToxicityModel(picked, whiten, weight, bias, _logistic(np.array(seen_by), labels, weights))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 900) -> ToxicityModel:
    """Learn from at most ``max_rows`` texts of each label (see the module's text)."""
    src = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"))
    src = src.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    all_of = {r["label"]: r["n"] for r in src.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
    src = src.filter("text IS NOT NULL").withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    picked = []
    for label in (0, 1):  # numbers only; the texts of at most 2 * max_rows ids follow
        part = src.filter(F.col("label") == label).select("h", "doc_id").distinct().orderBy("h", "doc_id").limit(max_rows)
        picked += [(r["doc_id"], label) for r in part.collect()]
    counts = all_of.get(0, 0), all_of.get(1, 0)
    if not picked:
        return train([], counts=counts)
    # as Arrow: a list of tuples would go through Python workers of another kind, which then stand beside those of mapInArrow
    doc_ids, of = zip(*picked, strict=True)
    ids = labelled.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "label": pa.array(of, pa.int32())}))
    # by the id alone first: this reaches the texts before they are shuffled to their labels
    found = src.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").join(F.broadcast(ids), ["doc_id", "label"], "left_semi").select("doc_id", "label", "text").toLocalIterator()
    rows = sorted({(r["doc_id"], r["label"], r["text"]) for r in found})
    return train([(text, label) for _, label, text in rows], counts=counts)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, for each row, and the columns named in ``carry`` (none of these two names) as they are."""
    if {"doc_id", "score"} & set(carry):
        raise ValueError("carry can't name doc_id or score")
    modest_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for b in slices(batches, 300):
            p = scorer.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), *b.columns[2:]], names=["doc_id", "score", *carry])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), *[StructField(c, docs.schema[c].dataType) for c in carry]])
    return src.mapInArrow(tidy(run), schema)
