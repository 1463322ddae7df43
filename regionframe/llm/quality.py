"""Quality rules: text statistics and a decision list learned from labels.

The list is learned by sequential covering.  Each rule is a conjunction of
thresholds on statistics: it grows on two thirds of the labelled rows by
information gain, is pruned on the other third, and joins the list only if it
is precise there; the rows it covers then leave.  The result is an ordered
Spark CASE expression over the statistics, so applying it needs no Python.

Cases: a null or empty text has zero statistics and fails the base rule.  With
no labelled row of one of the labels the list is empty.  Repeated rows get
equal results; rows with a null label or id are not learned from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionframe.llm.arrow import batched, slices
from regionframe.llm.store import modest_batches

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: name -> Spark SQL over the counts.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "CAST(n_dup_lines AS DOUBLE)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
_SCHEMA = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in COUNTS])
_BLANKS = bytes(range(9, 14)) + b" "


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(raw.count(bytes([b])) for b in _BLANKS)
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        pair = ids[:-1] * len(number) + ids[1:]
        _, pair = np.unique(pair, return_inverse=True)
        _, at, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        repeated = int(inside.sum())
    return n, chars, sum(raw.count(s.encode()) for s in SYMBOLS), len(lines) - len(set(lines)), repeated


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS, for each row's whole text."""
    modest_batches(docs.sparkSession)

    def run(batches):
        rows = ((d, *counts(t)) for b in slices(batches, 1000) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from batched(rows, _SCHEMA)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    #: (feature, True for >= and False for <, threshold)
    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, limit in self.tests:
            v = x[:, list(FEATURES).index(name)]
            out &= v >= limit if above else v < limit
        return out

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[name]}) {'>=' if above else '<'} {limit!r}D" for name, above, limit in self.tests)


@dataclass(frozen=True)
class DecisionList:
    """Rules for the label 0, in order; whatever none covers has the label 1."""

    rules: tuple[Rule, ...]

    def expression(self) -> Column:
        """Number of the first rule that covers a row, from 1; 0 if none does."""
        if not self.rules:
            return F.lit(0)
        return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {k}" for k, r in enumerate(self.rules, 1)) + " ELSE 0 END")

    def first(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), int)
        for k, r in reversed(list(enumerate(self.rules, 1))):
            out[r.covers(x)] = k
        return out


def _limits(v: np.ndarray, most: int) -> np.ndarray:
    values = np.unique(v)
    cuts = (values[1:] + values[:-1]) / 2
    return cuts if len(cuts) <= most else np.unique(cuts[np.linspace(0, len(cuts) - 1, most).astype(int)])


def _grown(x, y, longest, most):
    """One conjunction; y is true where the rule should cover."""
    tests, on = [], np.ones(len(x), bool)
    while len(tests) < longest and y[on].sum() and not y[on].all():
        p0, n0 = y[on].sum(), on.sum()
        best = (0.0, None, None)
        for j, name in enumerate(FEATURES):
            v = x[on, j]
            for limit in _limits(v, most):
                for above in (True, False):
                    hit = v >= limit if above else v < limit
                    p, n = y[on][hit].sum(), hit.sum()
                    if p:
                        gain = p * (math.log2(p / n) - math.log2(p0 / n0))
                        if gain > best[0] + 1e-12:
                            best = (gain, (name, above, float(limit)), hit)
        if best[1] is None:
            break
        tests.append(best[1])
        at = np.flatnonzero(on)
        on = np.zeros(len(x), bool)
        on[at[best[2]]] = True
    return tests


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.8, least: int = 4, longest: int = 4, rules: int = 12, limits: int = 64) -> DecisionList:
    """Sequential covering of the rows with the label 0 (``y`` is the label)."""
    bad = y == 0
    part = np.arange(len(x)) % 3 == 2  # rows come in a hashed order
    grow_x, grow_y, prune_x, prune_y = x[~part], bad[~part], x[part], bad[part]
    out: list[Rule] = []
    while len(out) < rules and grow_y.sum() >= least and not grow_y.all():
        tests = _grown(grow_x, grow_y, longest, limits)
        if not tests:
            break

        def worth(t):
            c = Rule(tuple(t)).covers(prune_x)
            p, n = prune_y[c].sum(), c.sum()
            return ((p - (n - p)) / n if n else -1.0, n)

        while len(tests) > 1 and worth(tests[:-1])[0] >= worth(tests)[0]:
            tests = tests[:-1]
        rule = Rule(tuple(tests))
        c, g = rule.covers(prune_x), rule.covers(grow_x)
        p, n = prune_y[c].sum() + grow_y[g].sum(), c.sum() + g.sum()
        if n < least or p < precision * n or (c.sum() and prune_y[c].sum() < precision * c.sum()):
            break
        out.append(rule)
        grow_x, grow_y, prune_x, prune_y = grow_x[~g], grow_y[~g], prune_x[~c], prune_y[~c]
    return DecisionList(tuple(out))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 20_000) -> DecisionList:
    """Learn from at most ``max_rows`` labelled rows, the smallest by a hash of the id."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).distinct()
    marks = marks.withColumn("h", F.xxhash64("doc_id", F.lit(9))).orderBy("h", "doc_id", "label").limit(max_rows)
    rows = stats.join(F.broadcast(marks), "doc_id").select("h", "doc_id", "label", *[F.expr(e).alias(n) for n, e in FEATURES.items()]).toPandas()
    rows = rows.sort_values(["h", "doc_id", "label", *FEATURES])
    if rows["label"].nunique() < 2:
        return DecisionList(())
    return learn(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(int))


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """The statistics with base_failed, rule (number of the rule that rejects, 0 for none) and kept."""
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return stats.withColumns({"base_failed": failed, "rule": rules.expression()}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
