"""Near-copy classes against brute force."""

import random

import pytest

from regionframe.llm.components import components
from regionframe.llm.ngram_join import similarity_components


def brute(rows, num, den, width):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and x and y
            if x and y and den * len(x & y) >= num * len(x | y) or same_id:
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for j, (e, _) in enumerate(rows) if root(j) == root(i) and e is not None and sets[j]]
        out.append((d, len(sets[i]), (min(ids, default=None) if sets[i] else d)))
    return sorted(out, key=repr)


def drawn(seed):
    """Copies, near copies of many strengths in chains, short texts, shared passages."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = r.choices(words, k=30)
    rows = []
    for _ in range(6):
        base = r.choices(words, k=r.choice((8, 25, 60, 120)))
        for _ in range(r.choice((3, 12, 25))):
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
            if r.random() < 0.2:
                t = t + r.choices(words, k=r.randrange(1, 6))
            base = t if r.random() < 0.2 else base
            rows.append(" ".join(t))
    rows += [" ".join(r.choices(words, k=20) + passage) for _ in range(15)]
    rows += ["a", "A", "a b", "a  B", "a b c", "b a", "", None, " \t\n", "x y", "x y"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, num, den, width", [(1, 90, 100, 3), (2, 80, 100, 5), (3, 90, 100, 1)])
def test_equals_brute_force(spark, seed, num, den, width):
    rows = drawn(seed)
    got = similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), num=num, den=den, width=width)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, num, den, width)


def test_cases(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s"), (None, None), (9, "")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, component_id string")
    got = sorted(map(tuple, similarity_components(df).collect()), key=repr)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 1, None), (None, 0, None), (9, 0, 9)], key=repr)
    assert similarity_components(df.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    one, two = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(7, one), (7, two), (7, two), (3, one), (5, two), (8, "y z y"), (9, "y z y"), (9, ""), (None, two), (11, "only this text"), (12, "and this one")]
    got = sorted(map(tuple, similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    # as in the SQL, an id's empty text has the component of the id
    assert got == sorted([(7, 10, 3), (7, 10, 3), (7, 10, 3), (3, 10, 3), (5, 10, 3), (8, 1, 8), (9, 1, 8), (9, 0, 8), (None, 10, 3), (11, 1, 11), (12, 1, 12)], key=repr)
    r = random.Random(4)
    rows = [(r.randrange(60) if (t or "").strip() and r.random() < 0.5 else k + 100, t) for k, t in drawn(5)]
    rows += [(None, t) for _, t in rows[:10]]
    got = similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), num=90, den=100, width=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 90, 100, 3)


def test_long_text(spark):
    r = random.Random(5)
    base = [f"t{r.randrange(9000)}" for _ in range(30_000)]
    near = list(base)
    near[100] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:20_000])), (4, "x" * 200_000)]
    got = {x["doc_id"]: x["component_id"] for x in similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(1, 60)]
    star = [(1000, k) for k in range(1001, 1100)]
    got = {x["node"]: x["comp"] for x in components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 61)) and all(got[k] == 1000 for k in range(1000, 1100))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
