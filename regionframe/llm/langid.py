"""Language identification by mixture inference over letter n-grams.

Learning counts hashed letter trigrams for each language over all given rows
(a partial aggregate; the model has languages x 2**BITS numbers).  For each
document, expectation-maximisation estimates the share of every language from
the trigram likelihoods, each document to its own maximum.  Then languages are
taken out, least loss first, down to pairs, and of all sets on the way and the
best single language the one of the highest penalised likelihood
``LL - penalty * (k - 1) * log(n)`` is chosen.  Sets are left out only where an
upper bound of their likelihood shows that none in them can win.

Cases: a null text or one without a letter is ``und`` with score 0 and no
languages; so is every text when nothing could be learned.  Rows to learn from
need a text and a non-null language.  A null id is never held out and never
learned from.  Ties between languages go to the alphabetically first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from regionframe.llm.arrow import slices, tidy
from regionframe.llm.store import modest_batches

#: 2**BITS hashed trigrams for each language.
BITS = 16
UND = "und"
#: Rows and bytes of text read at once.
_ROWS, _BYTES = 500, 400_000
#: Log likelihoods are maximal but for this much; shares do not fall below LEAST on the way, and up to NONE count as 0.
GAP, LEAST, NONE = 1e-4, 1e-12, 1e-9
_TABLE: list[np.ndarray] = []
_PREDICTED = StructType([StructField("doc_id", LongType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("langs", ArrayType(StringType())), StructField("shares", ArrayType(DoubleType()))])


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    #: languages x 2**BITS, natural logarithms of trigram probabilities
    logp: np.ndarray


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, 0 for all that is no letter."""
    if not _TABLE:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(t)
    return _TABLE[0]


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and bucket of every trigram centred on a letter; runs of non-letters count as one blank."""
    coded = [np.frombuffer(((t or "") + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    at = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
    c = _letters()[np.concatenate(coded)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c, at = c[keep].astype(np.uint64), at[keep]
    mid = np.flatnonzero(c)
    # the last code is always a blank, so mid + 1 exists; before the first there is a blank
    left = np.where(mid > 0, c[mid - 1], 0).astype(np.uint64)
    h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (c[mid] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[mid + 1] * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return at[mid], (h >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches):
    totals: dict[str, np.ndarray] = {}
    for b in slices(batches, _ROWS, _BYTES, 0):
        texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
        at, gram = _grams(texts)
        names = sorted(set(langs))
        lang_of = np.array([names.index(x) for x in langs])[at]
        n = np.bincount((lang_of << BITS) + gram, minlength=len(names) << BITS).reshape(len(names), -1)
        for k, name in enumerate(names):
            totals[name] = totals[name] + n[k] if name in totals else n[k]
    for name, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "gram", "n"])


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.05) -> LanguageModel:
    """Learn from all ``rows`` with a text and a language."""
    modest_batches(rows.sparkSession)
    src = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counted = src.mapInArrow(tidy(_count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(counted["lang"].unique()))
    n = np.zeros((len(langs), 1 << BITS))
    n[np.searchsorted(langs, counted["lang"].to_numpy(str)) if langs else [], counted["gram"].to_numpy(int)] = counted["n"].to_numpy(float)
    return LanguageModel(langs, np.log((n + smoothing) / (n.sum(1, keepdims=True) + smoothing * n.shape[1])))


def _step(pi, slope, power, active):
    """Shares times a power of their slopes; none is lost for good."""
    new = np.where(active, np.log(np.maximum(pi, LEAST)) + power[:, None] * np.log(slope), -np.inf)
    new = np.maximum(np.exp(new - new.max(1, keepdims=True)), LEAST) * active
    return new / new.sum(1, keepdims=True)


def _em(p, cnt, size, total, pi, plain, enough):
    """At the maximum of each document's likelihood over the languages with a share in ``pi``: shares, log likelihood, and how far below an upper bound it is.

    Each document stops alone, once the bound is within GAP, or not above ``enough``.  Log likelihood is
    concave in the shares, so no shares have more than it and ``total`` times the highest slope less 1.
    After ``plain`` rounds steps get longer; one that loses likelihood gives way to a plain one.
    """
    active = pi > 0
    shares, lls, gaps = pi.copy(), np.zeros(len(pi)), np.zeros(len(pi))
    live, open_ = np.arange(len(pi)), np.ones(len(pi), bool)
    trial, kept, slope, ll, power = pi, pi, np.ones_like(pi), np.full(len(pi), -np.inf), np.ones(len(pi))
    done = 0
    while len(live):
        starts, of = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        while True:
            s = np.einsum("ij,ij->i", trial[of], p)
            now = np.add.reduceat(cnt * np.log(s), starts)
            up = np.add.reduceat(p * (cnt / s)[:, None], starts) / total[:, None]
            take = (now >= ll) | (power == 1)
            kept, slope, ll = np.where(take[:, None], trial, kept), np.where(take[:, None], up, slope), np.where(take, now, ll)
            done += 1
            power = np.where(take & (done > plain), np.minimum(power * 1.5, 30), 1.0)
            gap = total * (np.where(active, slope, 0).max(1) - 1)
            stop = open_ & take & ((gap <= GAP) | (ll + gap <= enough))
            at = live[stop]
            shares[at], lls[at], gaps[at] = kept[stop], ll[stop], gap[stop]
            open_ &= ~stop
            if 4 * size[open_].sum() <= 3 * size.sum():
                break
            trial = _step(kept, slope, power, active)
        rows = np.repeat(open_, size)
        p, cnt = p[rows], cnt[rows]
        trial = _step(kept, slope, power, active)
        live, size, total, active, trial, kept, slope, ll, power, enough = (v[open_] for v in (live, size, total, active, trial, kept, slope, ll, power, enough))
        open_ = np.ones(len(live), bool)
    return shares, lls, gaps


def shares(texts: list[str | None], model: LanguageModel, penalty: float, rounds: int) -> np.ndarray:
    """texts x languages: the shares of the selected language sets; a row of zeros where there is no letter.

    ``rounds`` is the number of plain rounds before steps get longer; each text goes on to its own maximum.
    """
    k = len(model.langs)
    out = np.zeros((len(texts), k))
    at, gram = _grams(texts)
    if not len(at) or not k:
        return out
    key, cnt = np.unique((at << BITS) + gram, return_counts=True)
    doc, gram, cnt = key >> BITS, key & ((1 << BITS) - 1), cnt.astype(float)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    docs, size = doc[starts], np.diff(np.r_[starts, len(doc)])
    total = np.add.reduceat(cnt, starts)
    lp = model.logp.T[gram]
    # likelihoods are scaled for each trigram, which changes no comparison
    lp -= lp.max(1)[:, None]
    single = np.add.reduceat(lp * cnt[:, None], starts)
    p = np.exp(lp, out=lp)
    best = single.argmax(1)
    cost = penalty * np.log(np.maximum(total, 2))
    found = np.eye(k)[best]
    value = single[np.arange(len(docs)), best]

    def tried(todo, active):
        """_em for documents ``todo``; a set stops where neither it nor one of two or more in it can win."""
        use = np.zeros(len(docs), bool)
        use[todo] = True
        rows = np.repeat(use, size)
        start = active * (0.1 * active / active.sum(1, keepdims=True) + 0.9 * found[todo])
        return _em(p[rows], cnt[rows], size[todo], total[todo], start / start.sum(1, keepdims=True), rounds, value[todo] + cost[todo])

    todo = np.arange(len(docs)) if k > 1 else np.zeros(0, int)
    pi, ll, gap = tried(todo, np.ones((len(todo), k)))
    while len(todo):
        # a set can still win, or one in it: languages without a share are no part of it
        able = ll + gap > value[todo] + cost[todo]
        todo, pi, ll = todo[able], pi[able], ll[able]
        pi = np.where(pi > NONE, pi, 0)
        n = (pi > 0).sum(1)
        worth = ll - cost[todo] * (n - 1)
        better = (n > 1) & (worth > value[todo])
        value[todo[better]], found[todo[better]] = worth[better], pi[better]
        more = n > 2
        todo, active, n = todo[more], (pi[more] > 0).astype(float), n[more]
        # the language whose loss costs least goes next
        pi, ll, gap = np.zeros((len(todo), k)), np.full(len(todo), -np.inf), np.zeros(len(todo))
        rank = active.cumsum(1) * active
        for c in range(1, int(n.max(initial=0)) + 1):
            on = np.flatnonzero(n >= c)
            pi2, ll2, gap2 = tried(todo[on], active[on] * (rank[on] != c))
            top = ll2 + gap2 > ll[on] + gap[on]
            pi[on[top]], ll[on[top]], gap[on[top]] = pi2[top], ll2[top], gap2[top]
    out[docs] = found / found.sum(1, keepdims=True)
    return out


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 3.0, rounds: int = 12, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (share of that language), langs and shares (the selected set, largest first).

    Columns of ``docs`` named in ``carry`` follow as they are; they must not have one of these five names.
    """
    if set(carry) & set(_PREDICTED.names):
        raise ValueError(f"carry can't name one of {', '.join(_PREDICTED.names)}")
    modest_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in slices(batches, _ROWS, _BYTES // max(1, len(m.langs) // 8)):
            share = shares(b.column(1).to_pylist(), m, penalty, rounds)
            order = np.argsort(-share, axis=1, kind="stable")
            names, score, langs, parts = [], [], [], []
            for row, o in zip(share, order, strict=True):
                o = [k for k in o if row[k] > 0]
                names.append(m.langs[o[0]] if o else UND)
                score.append(min(1.0, float(row[o[0]])) if o else 0.0)
                langs.append([m.langs[k] for k in o])
                parts.append([float(row[k]) for k in o])
            made = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *b.columns[2:]], names=["doc_id", "lang_pred", "score", "langs", "shares", *carry])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    schema = StructType([*_PREDICTED.fields, *[StructField(c, docs.schema[c].dataType) for c in carry]])
    return src.mapInArrow(tidy(run), schema)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds
