import itertools
import random

import numpy as np
import pytest

from regionframe.llm import unigram as u


@pytest.fixture(scope="module")
def lattice():
    return u.Lattice(u.load())


@pytest.fixture(scope="module")
def library():
    """The same pieces under the library's own unigram algorithm (its model kind is set in the file's settings)."""
    import sentencepiece

    with open(u.MODEL_PATH, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")


TEXTS = ["", " ", "Hello world", "  two  spaces ", "naïve café 東京 🙂", "a" * 40, "The quick\nbrown fox\tjumps", "ÀÉÎÕÜ ßẞ", "x" + "͸" + "y", "price: 1234.50 (ok)"]


def drawn(words, n=200):
    rng = random.Random(3)
    return [" ".join(rng.choices(words.split(), k=rng.randrange(1, 12))) for _ in range(n)]


def test_best_equals_sentencepiece_lattice(lattice, library):
    """It adds in single precision, which is exact for sums below 2**24.

    Its plain encode() takes whole words that are pieces unasked, so its lattice is what to compare with.
    """
    for t in drawn("the of and being thione streat unheard often", 60):
        score, _, raw = lattice.n_best_text(t, 1)[0]
        if abs(score) < 2**24:
            want = library.nbest_encode_as_ids(t, 3)
            total = lambda ids: sum(library.get_score(i) for i in ids)
            assert total(want[0]) == score == total(np.frombuffer(raw, "<i4").tolist()), t


def test_counts_equal_tokenizers(lattice):
    """It adds in double precision, as we do."""
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    v = lattice.v
    table = [("<unk>", 0.0)] * (max(max(i for i, _ in v.pieces.values()), *v.byte_ids) + 1)
    for p, (i, s) in v.pieces.items():
        table[i] = (p, s)
    for b, i in enumerate(v.byte_ids):
        table[i] = (f"<0x{b:02X}>", v.lowest)
    tok = Tokenizer(Unigram(table, unk_id=0, byte_fallback=True))
    for t in [*TEXTS, *drawn("the of and being thione streat unheard of Überraschung été 12 3,4 \u0378\u0379 🙂")]:
        want = tok.encode(u.escaped(t)).ids
        assert lattice.count(t)[0] == len(want), t
        assert np.frombuffer(lattice.n_best_text(t, 1)[0][2], "<i4").tolist() == want, t


def small(unknown=False):
    pieces = {"a": (1, -1.0), "b": (2, -1.5), "ab": (3, -2.0), "ba": (4, -2.5), "aba": (5, -3.0), u.MARK: (6, -1.0), u.MARK + "a": (7, -2.0)}
    return u.Lattice(u.Vocabulary(pieces, 0, ()))


def every(lat, s):
    """All segmentations of a string, best first, ties by the starts from the last piece on."""
    arcs = lat._arcs(s)

    def walk(end):
        if end == 0:
            yield 0.0, (), ()
            return
        for start, i, score, _ in arcs[end]:
            for total, starts, ids in walk(start):
                yield total + score, (start, *starts), (*ids, i)

    return sorted(((-t, st, ids) for t, st, ids in walk(len(s))), key=lambda x: (x[0], x[1]))


@pytest.mark.parametrize("s", ["a", "ab", "abab", "ababa", u.MARK + "abab", "aca", "bbaab"])
def test_n_best_is_exhaustive(s):
    lat = small()
    want = every(lat, s)
    got = lat.n_best(s, 1000)
    assert len(got) == len(want)
    for (score, ids), (loss, _, path) in zip(got, want, strict=True):
        assert score == pytest.approx(-loss)
        assert ids == [i if i >= 0 else 0 for i in path]


@pytest.mark.parametrize("text", ["ab ab", "ab aba b", "a", "", "ab  ab", "aab aab aab"])
@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_text_lists_equal_all_products(text, n):
    lat = small()
    per = [lat.n_best(s, 1000) for s in lat.segments(text)]
    ways = []
    for ranks in itertools.product(*(range(len(p)) for p in per)):
        loss = sum(p[0][0] - p[r][0] for p, r in zip(per, ranks, strict=True))
        ways.append((round(loss, 9), tuple(reversed(ranks)), sum((p[r][1] for p, r in zip(per, ranks, strict=True)), [])))
    ways.sort()
    got = lat.n_best_text(text, n)
    assert len(got) == min(n, len(ways))
    for (score, size, raw), (loss, _, ids) in zip(got, ways, strict=False):
        assert np.frombuffer(raw, "<i4").tolist() == ids and size == len(ids)
        assert score == pytest.approx(sum(p[0][0] for p in per) - loss)


def test_scores_equal_the_library_n_best(lattice, library):
    for t in ["Hello world", "unheard of", "streatly"]:
        got = lattice.n_best_text(t, 5)
        want = library.nbest_encode_as_immutable_proto(t, 5) if hasattr(library, "nbest_encode_as_immutable_proto") else None
        ids = [list(x) for x in library.nbest_encode_as_ids(t, 5)]
        assert np.frombuffer(got[0][2], "<i4").tolist() == ids[0]
        if want is not None:
            assert [round(g[0]) for g in got] == [round(p.score) for p in want.nbests]


def listed(lat, segment, n):
    """The search without shared paths: whole tuples in the queue."""
    import heapq

    arcs = lat._arcs(segment)
    ahead, _ = lat._forward(arcs)
    queue, out = [(-ahead[-1], (), len(segment), 0.0, ())], []
    while queue and len(out) < n:
        rank, starts, at, behind, path = heapq.heappop(queue)
        if at == 0:
            out.append((-rank, lat._ids(segment, list(reversed(path)))))
        for start, i, score, _ in arcs[at]:
            heapq.heappush(queue, (-(behind + score + ahead[start]), (*starts, start), start, behind + score, (*path, (start, at, i))))
    return out


def test_lists_of_unspaced_letters(lattice):
    """Ties in plenty: repeated letters, and scores that are whole numbers."""
    r = random.Random(11)
    for s in ["a" * 150, "ab" * 120, "".join(r.choices("abcdefgh", k=300)), "".join(r.choices("et", k=200)), "東京" * 30]:
        for n in (1, 4, 9):
            assert lattice.n_best(s, n) == listed(lattice, s, n), (s[:10], n)


LONG = """
import random, resource, numpy as np
from regionframe.llm import unigram as u
lat = u.Lattice(u.load())
resource.setrlimit(resource.RLIMIT_DATA, (1 << 30, 1 << 30))
for letters in ("abcdefghijklmnopqrstuvwxyz", "a"):
    text = "".join(random.Random(1).choices(letters, k=200_000))
    got = lat.n_best_text(text, 4)
    assert len({x[2] for x in got}) == 4 and [x[0] for x in got] == sorted((x[0] for x in got), reverse=True)
    assert lat.count(text) == (got[0][1], got[0][0])
    pieces = {i: p for p, (i, _) in lat.v.pieces.items()}
    assert all("".join(pieces[i] for i in np.frombuffer(x[2], "<i4").tolist()) == u.escaped(text) for x in got)
"""


def test_long_segment_in_bounded_memory():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", LONG], check=True, timeout=300)


def test_decode_round_trip(spark):
    rows = [(1, "Hello wörld"), (2, ""), (3, None), (4, "a  b 🙂"), (4, "a  b 🙂")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seg = u.n_best(df, n=3)
    back = {(r["doc_id"], r["rank"], r["text"]) for r in u.decode(seg).collect()}
    assert all(text == (dict(rows)[d] or "") for d, _, text in back)
    assert {(1, 1, "Hello wörld"), (2, 1, ""), (3, 1, ""), (4, 3, "a  b 🙂")} <= back


def test_counts_of_tables(spark):
    df = spark.createDataFrame([(None, "x"), (1, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_tokens"]) for r in u.token_counts(df).collect()}
    assert got == {(None, 1), (1, 0)}
    assert u.token_counts(df.limit(0)).count() == 0
