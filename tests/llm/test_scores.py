"""Learned operators: held-out accuracy on made-up text, and every defined case."""

import inspect
import itertools
import random

import numpy as np
import pytest

from regionframe.llm import langid, quality, toxicity

ALPHABETS = {"aa": "abcdeilno", "bb": "zrtuskwv", "cc": "gmhopfjy"}


def sentence(r, lang, n):
    return " ".join("".join(r.choices(ALPHABETS[lang], k=r.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(k, sentence(r, lang, 40), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)]
    return langid.fit(spark.createDataFrame([*rows, (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string"))


def test_languages(spark, model):
    r = random.Random(2)
    rows = [(k, sentence(r, lang, 30), lang, 1.5) for k, lang in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(100, None, None, 0.0), (101, "", None, 0.0), (102, "12 345 !", None, 0.0), (None, "abc dei", None, 0.0), (None, "abc dei", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string, score double")
    got = langid.predict(df, model, carry=("want",)).collect()
    assert len(got) == len(rows)
    assert all(x["lang_pred"] == x["want"] and 0 <= x["score"] <= 1 for x in got if x["want"])
    assert all(x["lang_pred"] == "und" and x["score"] == 0 and x["langs"] == [] for x in got if x["doc_id"] in (100, 101, 102))
    assert len({str(x) for x in got if x["doc_id"] is None}) == 1
    assert langid.predict(df.limit(0).drop("score"), model).count() == 0


def test_mixtures(model):
    r = random.Random(3)
    text = sentence(r, "aa", 90) + " " + sentence(r, "cc", 30)
    share = langid.shares([text, sentence(r, "bb", 5), None], model, 3.0, 30)
    assert share[0, 1] == 0 and abs(share[0, 0] - 0.75) < 0.08 and share[0].sum() == pytest.approx(1)
    assert share[1].tolist() == [0, 1, 0] and share[2].tolist() == [0, 0, 0]


def test_selection_is_exhaustive_for_two(model):
    """With two languages all sets are tried, so the chosen one is the best by penalised likelihood."""
    two = langid.LanguageModel(model.langs[:2], model.logp[:2])
    r = random.Random(4)
    for n in (0, 2, 10, 40):
        text = sentence(r, "aa", 40) + " " + sentence(r, "bb", n) if n else sentence(r, "aa", 40)
        _, gram = langid._grams([text])
        p = np.exp(two.logp[:, gram])
        pi = np.array([0.5, 0.5])
        for _ in range(500):
            w = pi[:, None] * p
            pi = (w / w.sum(0)).mean(1)
        both = np.log((pi[:, None] * p).sum(0)).sum() - 3.0 * np.log(len(gram))
        alone = np.log(p).sum(1)
        share = langid.shares([text], two, 3.0, 500)[0]
        assert ((share > 0).sum() == 2) == (both > alone.max())


def best_set(text, model, penalty):
    """Of all sets of languages the one of the highest penalised likelihood: value and shares."""
    _, gram = langid._grams([text])
    p, out = np.exp(model.logp[:, gram]), (-np.inf, None)
    for size in range(1, len(p) + 1):
        for held in map(list, itertools.combinations(range(len(p)), size)):
            pi = np.full(size, 1 / size)
            for _ in range(1 if size == 1 else 3000):
                old, w = pi, pi[:, None] * p[held]
                pi = (w / w.sum(0)).mean(1)
                if np.abs(pi - old).max() < 1e-9:
                    break
            v = np.log((pi[:, None] * p[held]).sum(0)).sum() - penalty * np.log(len(gram)) * (size - 1)
            if v > out[0]:
                out = v, np.zeros(len(p))
                out[1][held] = pi
    return out


def many_languages(k, r, alike=0.0):
    """Models over trigrams of random words, and a maker of words of each language."""
    ends = [["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(60)] for _ in range(k)]
    ends = [[x if r.random() >= alike else ends[0][i] for i, x in enumerate(e)] for e in ends]
    word = lambda lang: "".join(r.choices(ends[lang], k=r.randrange(1, 4)))
    n = np.full((k, 1 << langid.BITS), 0.05)
    for lang in range(k):
        _, gram = langid._grams([" ".join(word(lang) for _ in range(4000))])
        np.add.at(n[lang], gram, 1)
    return langid.LanguageModel(tuple(f"l{c}" for c in range(k)), np.log(n / n.sum(1, keepdims=True))), word


def test_selection_against_all_sets():
    """Small shares of a second and a third language among five, with the query's own penalty and rounds."""
    r = random.Random(8)
    five, word = many_languages(5, r, 0.5)
    cases = [[word(0) for _ in range(n)] + [word(1) for _ in range(m)] + [word(2) for _ in range(m2)] for n in (15, 40) for m in (0, 1, 2, 4, 8, 12) for m2 in (0, 3, 10)]
    texts = [" ".join(c) for c in cases]
    defaults = inspect.signature(langid.predict).parameters
    got = langid.shares(texts, five, defaults["penalty"].default, defaults["rounds"].default)
    sizes = set()
    for text, share in zip(texts, got, strict=True):
        _, want = best_set(text, five, defaults["penalty"].default)
        assert ((share > 0) == (want > 0)).all() and share == pytest.approx(want, abs=0.01)
        sizes.add((share > 0).sum())
    assert sizes >= {1, 2, 3}


def test_shares_are_maximal_and_do_not_follow_the_slice():
    """Languages that resemble each other, with the query's own penalty and rounds."""
    r = random.Random(9)
    four, word = many_languages(4, r, 0.85)
    texts = [" ".join(word(lang) for lang in (0, 1) for _ in range(n * (3 - 2 * lang))) for n in (10, 40, 150, 400)] + ["", "ab"]
    defaults = inspect.signature(langid.predict).parameters
    penalty, rounds = defaults["penalty"].default, defaults["rounds"].default
    together = langid.shares(texts, four, penalty, rounds)
    assert np.array_equal(together, np.concatenate([langid.shares([t], four, penalty, rounds) for t in texts]))
    for text, share in zip(texts[:4], together, strict=False):
        assert share == pytest.approx(best_set(text, four, penalty)[1], abs=0.02)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    m = langid.fit(df)
    assert m.langs == () and langid.predict(df, m).first()["lang_pred"] == "und"


def kernel(v, w):
    """The definition, letter by letter."""

    def phi(x):
        out = {}
        for a in range(len(x)):
            for b in range(a + 1, len(x)):
                for c in range(b + 1, min(len(x), a + toxicity.SPAN)):
                    key = x[a] + x[b] + x[c]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (c - a - 2)
        return out

    x, y = phi(v), phi(w)
    return sum(x[k] * y.get(k, 0) for k in x) / max(1e-9, sum(a * a for a in x.values()) * sum(b * b for b in y.values())) ** 0.5


def test_kernel_equals_its_definition():
    words = ["idiot", "idxiot", "nananana", "abc", "ab", "banana", "tititit", "abcdefghijklmn"]
    marks = toxicity.Landmarks(["idiot", "banana", "nananana"])
    got = marks.kernel(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks.words):
            assert got[i, j] == pytest.approx(kernel(w, m), abs=1e-5)
    weights = np.array([1.0, -0.5, 2.0])
    assert marks.linear(words, weights) == pytest.approx(got @ weights, abs=1e-4)


def test_units():
    assert toxicity.units("i.d.i.o.t") == ["idiot"] and toxicity.units("1d10t") != [] and toxicity.units("!?") == []
    assert toxicity.units("id1ot,") == ["idiot"] and toxicity.units("Été") == ["ete"] and "idiot" in toxicity.units("id-iot")
    assert toxicity.spelled("you i d i o t x".split()) == ["idiotx"] and all(len(u) <= toxicity.WINDOW for u in toxicity.units("x" * 100))


def test_long_tokens_with_signs():
    """What signs set apart is read whole, in windows past 14 letters."""
    covers = lambda token, word: any(word in u for u in toxicity.units(token))
    for word in ("stupid", "idiot", "moron"):
        for n in (0, 1, 3, 8, 9, 10, 14, 15, 30):
            for sign in ".-,_*":
                token = sign.join("t" * n + word + "h" * n)
                assert covers(token, word) and all(len(u) <= toxicity.WINDOW for u in toxicity.units(token)), token
    assert covers("y.o.u.s.t.u.p.i.d.i.d.i.o.t.s", "stupid") and covers("y.o.u.s.t.u.p.i.d.i.d.i.o.t.s", "idiot")
    assert covers("you,i.d.i.o.t,get-lost", "idiot") and {"you", "get", "lost"} <= set(toxicity.units("you,i.d.i.o.t,get-lost"))


def texts(n, seed):
    r = random.Random(seed)
    bad = ("idiot", "moron", "stupid")
    out = []
    for k in range(n):
        w = ["".join(r.choices("aehnorst", k=r.randrange(2, 7))) for _ in range(40)]
        if k % 3 == 0:
            w[r.randrange(40)] = r.choice(bad)
        out.append((k, " ".join(w), int(k % 3 == 0)))
    return out


def test_toxicity_is_held_out(spark):
    m = toxicity.fit(spark.createDataFrame(texts(450, 1), "doc_id long, text string, toxic int"))
    test = texts(200, 2) + [(1000, "the i.d.i.o.t here", 1), (1001, "an idxiot there", 1), (1002, None, 0), (1003, "", 0), (None, "aero shot", 0), (None, "aero shot", 0)]
    got = toxicity.score(spark.createDataFrame(test, "doc_id long, text string, label int"), m, carry=("label",)).collect()
    right = sum((x["score"] >= 0.5) == bool(x["label"]) for x in got)
    assert right >= 0.97 * len(got) and all(0 <= x["score"] <= 1 for x in got)
    by = {x["doc_id"]: x["score"] for x in got}
    assert by[1002] == by[1003] and len({x["score"] for x in got if x["doc_id"] is None}) == 1
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), m).count() == 0


def plain_score(text, m):
    """The score by its definition: kernel values letter by letter, whitened, and the logistic fit."""
    import math

    def margin(word):
        return float(np.array([kernel(word, w) for w in m.words]) @ m.whiten @ m.weight) + m.bias

    tokens = (text or "").split()
    margins = [max((margin(u) for u in toxicity.units(t)), default=m.bias) for t in set(tokens)]
    if sum(len(t) <= 3 for t in tokens) >= 3:
        margins += [margin(u) for u in toxicity.spelled(tokens)]
    top = sorted((max(x, m.bias) for x in margins), reverse=True)[:3]
    z = np.array([*top, *[m.bias] * (3 - len(top)), math.log1p(len(tokens)), 1.0]) @ m.fit
    return 1 / (1 + math.exp(-min(40, max(-40, z))))


def test_score_equals_its_definition():
    m = toxicity.train([(t, y) for _, t, y in texts(90, 3)], landmarks=12)
    cases = [t for _, t, _ in texts(8, 4)] + ["you i d i o t there", "the i.d.i.o.t", "an idxiot", "x" * 40, "", None, "nananana " * 5]
    assert toxicity.Scorer(m).score(cases) == pytest.approx([plain_score(t, m) for t in cases], abs=1e-3)


def test_labelled_texts_are_read_whole(spark):
    """The only insults stand behind thousands of letters."""
    r = random.Random(12)
    plain = lambda n: " ".join("".join(r.choices("aehnorst", k=r.randrange(2, 7))) for _ in range(n))
    rows = [(k, plain(2500) + (" you absolute idiot" if k % 2 else ""), k % 2) for k in range(60)]
    assert min(len(t) for _, t, _ in rows) > 10_000
    m = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    got = toxicity.Scorer(m).score([plain(2500) + " what an idiot", plain(2500)])
    assert got[0] > 0.5 > got[1]


def test_learning_starts_no_other_python_workers(spark, monkeypatch):
    """Rows sent through the RDD interface start a second daemon with workers of its own on every executor."""
    df = spark.createDataFrame([(k, t, y) for k, (_, t, y) in enumerate(texts(60, 3))], "doc_id long, text string, toxic int")
    want = toxicity.fit(df)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("a Python RDD"))
    assert toxicity.fit(df).words == want.words


def test_tokens_are_forgotten_within_bounds():
    m = toxicity.train([(t, y) for _, t, y in texts(60, 3)], landmarks=12)
    s = toxicity.Scorer(m)
    s.LIMIT = 20_000
    r = random.Random(5)
    for _ in range(50):
        s.score(["".join(r.choices("abcde", k=9)) for _ in range(30)])
        assert s.used <= 17_000 and len(s.known) + len(s.older) <= 140  # a half of the limit and one call, twice
    fresh = toxicity.Scorer(m)
    assert s.score(["you idiot", "aero"]) == pytest.approx(fresh.score(["you idiot", "aero"]))


def test_names_that_carry_cannot_have(spark):
    df = spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, score double")
    m = toxicity.train([])
    with pytest.raises(ValueError):
        toxicity.score(df, m, carry=("score",))
    with pytest.raises(ValueError):
        langid.predict(df, langid.LanguageModel((), np.zeros((0, 1 << langid.BITS))), carry=("score",))


def test_scores_do_not_follow_the_sample(spark):
    """One text in ten is toxic, and half of those have no insult: the others' scores show the true share at every bound."""
    r = random.Random(6)
    rows = []
    for k in range(900):
        w = ["".join(r.choices("aehnorst", k=r.randrange(2, 7))) for _ in range(30)]
        if k % 20 == 0:
            w[3] = r.choice(("idiot", "moron", "stupid"))
        rows.append((k, " ".join(w), int(k % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    plain = [text for k, text, _ in rows if k % 20]
    mean = [toxicity.Scorer(toxicity.fit(df, max_rows=n)).score(plain).mean() for n in (90, 200, 900)]
    assert max(mean) < 0.12 and max(mean) - min(mean) < 0.05, mean


def test_toxicity_without_labels(spark):
    none = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert none.words == [] and toxicity.Scorer(none).score(["a", None])[0] == pytest.approx(0, abs=1e-6)
    one = toxicity.fit(spark.createDataFrame([(1, "a", 1), (2, "b", None), (None, "c", 0)], "doc_id long, text string, toxic int"))
    assert toxicity.Scorer(one).score(["a"])[0] == pytest.approx(1, abs=1e-6)


def plain_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_counts_equal_plain_ones():
    r = random.Random(7)
    cases = [None, "", " \n ", "a", "a b a b a b", "x y z x y z", "é ü ß", "a\x0bb\x0cc\x1cd", "l\nl\n l\n\n\n", "#*$ %& |<>"]
    cases += ["".join(r.choices("ab \n#é\t", k=r.randrange(1, 80))) for _ in range(300)]
    for t in cases:
        assert quality.counts(t) == plain_counts(t), t


def test_rules_learn_and_agree_with_spark(spark):
    r = np.random.default_rng(1)
    x = np.c_[r.integers(10, 900, 900), r.uniform(3, 9, 900), r.uniform(0, 1, 900), r.integers(0, 5, 900), r.uniform(0, 0.01, 900), r.uniform(0, 1, 900)]
    y = (~((x[:, 2] > 0.6) | (x[:, 5] > 0.7) & (x[:, 1] < 5))).astype(int)
    rules = quality.learn(x[:600], y[:600])
    assert rules.rules and ((rules.first(x[600:]) == 0) == (y[600:] == 1)).mean() > 0.95
    df = spark.createDataFrame([(k, 100, 100 * (k % 9), k % 300, k % 5, k % 100) for k in range(500)], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    from pyspark.sql import functions as F

    got = df.select(*[F.expr(e).cast("double").alias(n) for n, e in quality.FEATURES.items()], rules.expression().alias("rule")).toPandas()
    assert (rules.first(got[list(quality.FEATURES)].to_numpy(float)) == got["rule"].to_numpy()).all()


def test_first_test_has_the_highest_gain():
    """Against every threshold between two values, of every statistic, in both directions."""
    import math

    for seed in range(6):
        r = np.random.default_rng(seed)
        x = r.integers(0, 12, (80, len(quality.FEATURES))).astype(float)
        y = (x[:, seed % 6] > 7) ^ (r.random(80) < 0.2)
        (name, above, limit), *_ = quality._grown(x, y, 1, 64)

        def gain(j, limit, above):
            hit = x[:, j] >= limit if above else x[:, j] < limit
            p, n = y[hit].sum(), hit.sum()
            return p * (math.log2(p / n) - math.log2(y.mean())) if p else 0.0

        every = [gain(j, v + 0.5, above) for j in range(x.shape[1]) for v in range(12) for above in (True, False)]
        assert gain(list(quality.FEATURES).index(name), limit, above) == pytest.approx(max(every))


def plain_learn(x, y, precision=0.8, least=4, longest=4, rules=12, limits=64):
    """Sequential covering row by row: masks over all rows instead of shrinking tables."""
    n = len(x)
    grow, prune, left, out = np.arange(n) % 3 != 2, np.arange(n) % 3 == 2, np.ones(n, bool), []
    bad = y == 0
    while len(out) < rules:
        g = grow & left
        if bad[g].sum() < least or bad[g].all() or not (tests := quality._grown(x[g], bad[g], longest, limits)):
            break
        best = None
        while True:
            hit = [k for k in range(n) if prune[k] and left[k] and quality.Rule(tuple(tests)).covers(x[k : k + 1])[0]]
            right = sum(bad[k] for k in hit)
            value = (2 * right - len(hit)) / len(hit) if hit else -1.0
            if best is None or value >= best[0]:
                best = value, list(tests), hit
            else:
                break
            if len(tests) == 1:
                break
            tests = tests[:-1]
        rule = quality.Rule(tuple(best[1]))
        covered = [k for k in range(n) if left[k] and rule.covers(x[k : k + 1])[0]]
        right, held = sum(bad[k] for k in covered), [k for k in covered if prune[k]]
        if len(covered) < least or right < precision * len(covered) or held and sum(bad[k] for k in held) < precision * len(held):
            break
        out.append(rule)
        left[covered] = False
    return tuple(out)


def test_learned_list_equals_a_plain_one():
    for seed in range(5):
        r = np.random.default_rng(seed)
        x = np.c_[r.integers(0, 40, (240, 3)), r.random((240, 3)).round(2)].astype(float)
        y = (~((x[:, 0] > 28) | (x[:, 4] > 0.8) & (x[:, 1] < 20)) ^ (r.random(240) < 0.05)).astype(int)
        assert quality.learn(x, y).rules == plain_learn(x, y)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, "w " * 60, 5), (2, None, 5), (None, "a b c", 5), (2, None, 5)], "doc_id long, text string, n_words long")
    stats = quality.statistics(docs)
    rules = quality.fit(stats, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int"))
    assert rules.rules == ()
    got = quality.judged(stats, rules).collect()
    assert len(got) == 4 and [x["base_failed"] for x in sorted(got, key=lambda x: -x["n_words"])] == [True] * 4
    assert quality.judged(quality.statistics(docs.limit(0)), rules).count() == 0
