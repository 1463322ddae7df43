"""Unigram (SentencePiece) segmentation: counts, N-best lists, decoding.

The vocabulary is a list of pieces with scores.  A text is escaped (a space
becomes U+2581, one is put in front) and cut before every such mark that
follows another character; where no piece holds a mark after another character,
no segmentation crosses a cut, so segments are solved alone and remembered.

Counting keeps a score and a number of pieces for each position only.  For lists
the same pass also keeps the second-best score, which tells the few segments
whose alternatives matter; the search runs on these alone.  Matches
come from an Aho-Corasick automaton.  The tokenizer's rules hold: a character
that is no piece costs the lowest score less 10 and, with byte fallback, counts
as its UTF-8 bytes; of equally good ways to a position the one whose last piece
starts first wins.

N-best search keeps the forward scores and runs A* backwards from the end: a
partial path's score plus the forward score of where it stands is exactly its
best completion, so complete paths leave the queue in order.  Equal paths are
ordered by the starts of their pieces from the last to the first, smaller
first, which puts the tokenizer's own choice first.  A text's N best
segmentations come from its segments' lists: only the N-1 least alternatives
can take part.  Ties there go to the smaller ranks, compared from the last
segment to the first.

Scores add up in double precision.  Cases: null and empty texts have no pieces
and a score of 0, and one segmentation, the empty one.  A segment of any length
is solved whole.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionframe.llm.arrow import batched, slices
from regionframe.llm.store import modest_batches
from regionframe.llm.text import Memo

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")


@dataclass(frozen=True)
class Vocabulary:
    #: piece -> (id, score); ordinary pieces only
    pieces: dict[str, tuple[int, float]]
    unknown: int
    #: id of each byte's piece, or empty without byte fallback
    byte_ids: tuple[int, ...]

    @property
    def lowest(self) -> float:
        return min((s for _, s in self.pieces.values()), default=0.0)


def load(path: str = MODEL_PATH) -> Vocabulary:
    """The scored pieces of a SentencePiece model file, whatever it was trained as."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, by = {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            by[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
            plain[sp.id_to_piece(i)] = (i, sp.get_score(i))
    return Vocabulary(plain, sp.unk_id(), tuple(by[b] for b in range(256)) if len(by) == 256 else ())


def escaped(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def decoded(ids, pieces: list[str], byte_of: dict[int, int], unknown: int = 0) -> str:
    """The text of a segmentation; byte pieces in a row are read as UTF-8."""
    out: list[str] = []
    raw = bytearray()
    for i in ids:
        if i in byte_of:
            raw.append(byte_of[i])
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw = bytearray()
        out.append(pieces[i] if i != unknown else " ⁇ ")
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    text = "".join(out).replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


class _Path:
    """The end of a segmentation: its first piece, and the path behind that; of equal scores the smaller path goes first.

    Paths share what they have in common, so a place in the queue takes the same memory at any length.
    ``jump`` is a path further behind, such that any depth is reached in a logarithm of steps.
    """

    __slots__ = ("start", "piece", "behind", "depth", "jump")

    def __init__(self, start: int, piece: int, behind: _Path | None):
        self.start, self.piece, self.behind = start, piece, behind
        if behind is None:
            self.depth, self.jump = 0, self
        else:
            far = behind.jump
            self.depth = behind.depth + 1
            self.jump = far.jump if behind.depth - far.depth == far.depth - far.jump.depth else behind

    def at(self, depth: int) -> _Path:
        p = self
        while p.depth > depth:
            p = p.jump if p.jump.depth >= depth else p.behind
        return p

    def __lt__(self, other: _Path) -> bool:
        """Starts compared from the last piece to the first, as far as both go."""
        depth = min(self.depth, other.depth)
        a, b = self.at(depth), other.at(depth)
        if a is b:
            return self.depth < other.depth
        while a.behind is not b.behind:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.behind, b.behind)
        return a.start < b.start

    def pieces(self) -> list[tuple[int, int, int]]:
        """(start, end, id) of each piece, from the first on."""
        out, p = [], self
        while p.behind is not None:
            out.append((p.start, p.behind.start, p.piece))
            p = p.behind
        return out


class Lattice:
    """Segmentations of strings under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.unknown_score = vocabulary.lowest - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.singles = {p for p in vocabulary.pieces if len(p) == 1}
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in vocabulary.pieces)
        self.counted = Memo(self._count, 128 << 20)
        self.solved = Memo(self._solve, 192 << 20, lambda s, x: len(s) + len(x[3]) + 100)
        self.ranked: dict[int, Memo] = {}

    def segments(self, text: str | None) -> list[str]:
        whole = escaped(text or "")
        return [whole] if not self.cuttable and whole else _CUT.split(whole) if whole else []

    def _arcs(self, s: str) -> list[list[tuple[int, int, float, int]]]:
        """For each end, (start, id, score, number of ids) with the smallest start first."""
        arcs: list[list[tuple[int, int, float, int]]] = [[] for _ in range(len(s) + 1)]
        single = [False] * len(s)
        if self.v.pieces:
            for last, (n, i, score) in self.automaton.iter(s):
                arcs[last + 1].append((last + 1 - n, i, score, 1))
                if n == 1:
                    single[last] = True
        for k, has in enumerate(single):
            if not has:
                arcs[k + 1].append((k, -1, self.unknown_score, len(s[k].encode("utf-8", "surrogatepass")) if self.v.byte_ids else 1))
        for a in arcs:
            a.sort()
        return arcs

    def _forward(self, arcs) -> tuple[list[float], list[int]]:
        best, count = [0.0] * len(arcs), [0] * len(arcs)
        for end in range(1, len(arcs)):
            top = None
            for start, _, score, n in arcs[end]:
                s = best[start] + score
                if top is None or s > top:
                    top, best[end], count[end] = s, s, count[start] + n
        return best, count

    def _solve(self, s: str) -> tuple[float, float, int, bytes]:
        """Score of the best segmentation, what the second best loses on it, and the best one's ids, as number and bytes.

        One pass over the matches in the order of their ends; longer ones come
        first, so that of equal ways the one with the earlier start stays.
        """
        low = float("-inf")
        best, second, back = [0.0] + [low] * len(s), [low] * (len(s) + 1), [(0, 0)] * (len(s) + 1)
        if not self.singles.issuperset(s):
            arcs = ((end - 1, (end - start, i, score)) for end, found in enumerate(self._arcs(s)) for start, i, score, _ in found)
        else:
            arcs = self.automaton.iter(s)
        for last, (n, i, score) in arcs:
            end = last + 1
            start = end - n
            x = best[start] + score
            top = best[end]
            if x > top:
                y = second[start] + score
                second[end] = y if y > top else top
                best[end], back[end] = x, (start, i)
            elif x > second[end]:
                second[end] = x
        ids, end = [], len(s)
        while end:
            start, i = back[end]
            if i >= 0:
                ids.append(i)
            else:
                ids += reversed(self._ids(s, [(start, end, i)]))
            end = start
        ids.reverse()
        return best[-1], best[-1] - second[-1], len(ids), array("i", ids).tobytes()

    def _count(self, s: str) -> tuple[float, int]:
        """Score and number of ids of the best segmentation: the same pass with two numbers for each position."""
        if not self.singles.issuperset(s):
            best, count = self._forward(self._arcs(s))
            return best[-1], count[-1]
        low = float("-inf")
        best, count = [0.0] + [low] * len(s), [0] * (len(s) + 1)
        for last, (n, _, score) in self.automaton.iter(s):
            x = best[last + 1 - n] + score
            if x > best[last + 1]:
                best[last + 1], count[last + 1] = x, count[last + 1 - n] + 1
        return best[-1], count[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        """Number of ids and score of the best segmentation."""
        found = list(map(self.counted.__getitem__, self.segments(text)))
        return sum(n for _, n in found), float(sum(s for s, _ in found))

    def _ids(self, segment: str, cuts: list[tuple[int, int, int]]) -> list[int]:
        out: list[int] = []
        for start, end, i in cuts:
            out += [i] if i >= 0 else [self.v.byte_ids[b] for b in segment[start:end].encode("utf-8", "surrogatepass")] if self.v.byte_ids else [self.v.unknown]
        return out

    def n_best(self, segment: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best (score, ids) of one string, by backward A*."""
        arcs = self._arcs(segment)
        ahead, _ = self._forward(arcs)
        queue: list = [(-ahead[-1], _Path(len(segment), -1, None), 0.0)]
        out: list[tuple[float, list[int]]] = []
        # of the paths to one place only the first n can become one of the n best
        left = bytearray([n]) * (len(segment) + 1) if n < 256 else [n] * (len(segment) + 1)
        while queue and len(out) < n:
            rank, path, behind = heapq.heappop(queue)
            at = path.start
            if at == 0:
                out.append((-rank, self._ids(segment, path.pieces())))
                continue
            if not left[at]:
                continue
            left[at] -= 1
            for start, i, score, _ in arcs[at]:
                if left[start]:
                    total = behind + score
                    heapq.heappush(queue, (-(total + ahead[start]), _Path(start, i, path), total))
        return out

    def n_best_text(self, text: str | None, n: int) -> list[tuple[float, int, bytes]]:
        """The ``n`` best (score, number of ids, ids as int32 bytes) of a whole text."""
        if n not in self.ranked:
            self.ranked[n] = Memo(lambda s: [(score, np.array(ids, "<i4").tobytes()) for score, ids in self.n_best(s, n)], 32 << 20, lambda s, x: len(s) + sum(len(ids) + 150 for _, ids in x))
        segments = self.segments(text)
        solved = list(map(self.solved.__getitem__, segments))
        losses = [x[1] for x in solved]
        # segments without a second way lose infinitely much; of the rest the n-1 least losses matter
        near = heapq.nsmallest(n - 1, zip(losses, range(len(losses)), strict=True)) if n > 1 else []
        ranked = {k: self.ranked[n][segments[k]] for loss, k in near if loss < float("inf")}
        least = heapq.nsmallest(n - 1, ((x[0][0] - way[0], k, r) for k, x in ranked.items() for r, way in enumerate(x[1:], 1)))
        by: dict[int, list[tuple[float, int]]] = {}
        for loss, k, r in least:
            by.setdefault(k, []).append((loss, r))
        ways: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for k in sorted(by, reverse=True):
            ways = heapq.nsmallest(n, [(w + loss, (*chosen, (k, r))) for w, chosen in ways for loss, r in [(0.0, 0), *by[k]]])
        base = float(sum(x[0] for x in solved))
        parts = [x[3] for x in solved]
        out = []
        for loss, chosen in ways:
            for k, r in chosen:
                parts[k] = ranked[k][r][1]
            raw = b"".join(parts)
            out.append((base - loss, len(raw) // 4, raw))
        return out


def _held(spark: SparkSession, path: str):
    modest_batches(spark)
    return spark.sparkContext.broadcast(load(path))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


def token_counts(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score: one row for each row."""
    held = _held(docs.sparkSession, model_path)

    def run(batches):
        lattice = Lattice(held.value)
        rows = ((d, *lattice.count(t)) for b in slices(batches, 1000) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from batched(rows, _COUNTS)

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, score double")


_BEST = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def n_best(docs: DataFrame, n: int = 4, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rank (from 1), score, n_tokens, ids (little-endian int32): up to ``n`` rows for each row."""
    held = _held(docs.sparkSession, model_path)

    def run(batches):
        lattice = Lattice(held.value)
        rows = ((d, r, *x) for b in slices(batches, 200) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r, x in enumerate(lattice.n_best_text(t, n), 1))
        yield from batched(rows, _BEST, 500)

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, rank int, score double, n_tokens long, ids binary")


_TEXT = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("text", pa.string())])


def decode(segmented: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, rank, text of n_best()'s rows."""
    held = _held(segmented.sparkSession, model_path)

    def run(batches):
        v = held.value
        size = max([i for i, _ in v.pieces.values()] + list(v.byte_ids) + [v.unknown], default=0) + 1
        pieces = [""] * size
        for p, (i, _) in v.pieces.items():
            pieces[i] = p
        byte_of = {i: b for b, i in enumerate(v.byte_ids)}
        rows = ((d, r, decoded(np.frombuffer(raw, "<i4").tolist(), pieces, byte_of, v.unknown)) for b in slices(batches, 500, column=2) for d, r, raw in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from batched(rows, _TEXT, 500)

    return segmented.select("doc_id", "rank", "ids").mapInArrow(run, "doc_id long, rank int, text string")
