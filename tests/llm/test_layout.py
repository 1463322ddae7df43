"""Search, packing, shards, pseudonyms and the pipeline."""

import os
import random
import re
import string
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionframe.llm import mtree, packing, pii, shards, tokens
from regionframe.llm.arrow import tidy

SF = "/root/testdata/sf0.001"


def brute_top(vectors, k, is_query):
    out = []
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in vectors if v and None not in v and np.isfinite(v).all() and i is not None}
    for q in sorted(x):
        if is_query(q):
            best = sorted((-int(x[q] @ x[c]), c) for c in x if c != q and len(x[c]) == len(x[q]))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("seed, dims, n", [(1, 3, 400), (2, 16, 300), (3, 2, 5)])
def test_top_k(spark, seed, dims, n, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE_ROWS", 128)
    monkeypatch.setattr(mtree, "BLOCK", 32)
    r = np.random.default_rng(seed)
    rows = [(int(i), r.normal(size=dims).round(1).tolist()) for i in range(n)]
    rows += [(n + 1, None), (n + 2, [1.0] * (dims - 1) + [None]), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] * dims), (n + 5, []), (10 * n, [0.5] * dims), (10 * n + 1, [0.5] * dims), (None, [0.5] * dims), (3, rows[3][1])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = sorted(map(tuple, mtree.top_k(df, F.col("id") % 5 == 0).collect()))
    assert got == brute_top(dict(reversed(rows)).items(), 5, lambda q: q % 5 == 0)


def test_top_k_empty_and_large(spark):
    df = spark.createDataFrame([(0, [3e6, 2e6]), (1, [3e6, 2e6 + 1]), (2, [-3e6, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, mtree.top_k(df, F.col("id") == 0).collect())) == brute_top([(0, [3e6, 2e6]), (1, [3e6, 2e6 + 1]), (2, [-3e6, 0.0])], 5, lambda q: q == 0)
    assert mtree.top_k(df.limit(0), F.col("id") == 0).count() == 0


def test_search_equals_a_scan():
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(3000, 8)) * 40)
    x[:50] = x[0]
    tree = mtree.build(x, np.arange(3000))
    for q in r.normal(size=(20, 8)).round(1) * 40:
        got = mtree.search(tree, np.round(q), -1, 7)
        s = x @ np.round(q)
        assert got == [(int(s[i]), int(i)) for i in np.lexsort((np.arange(3000), -s))[:7]]


def test_packing(spark):
    r = random.Random(1)
    rows = [(k, "word " * r.choice((0, 1, 30, 400, 1500))) for k in range(120)] + [(None, "a b"), (5, None), (9, "word " * 9000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, bin int")
    out = packing.pack(df, capacities=(128, 512, 2048), group_items=40).toPandas()
    bpe = tokens.Bpe(open(tokens.RANKS_PATH, "rb").read())
    assert out["n_tokens"].sum() == sum(bpe.count(t) for _, t in rows)
    assert len(out) == sum(max(1, -(-bpe.count(t) // 2048)) for _, t in rows)
    full = out[out.n_tokens > 0]
    assert out[out.n_tokens == 0][["bin", "capacity", "offset"]].isna().all().all() and not full.bin.isna().any()
    assert (out.start == out.piece * 2048).all()
    for _, b in full.groupby("bin"):
        b = b.sort_values("offset")
        cap = b.capacity.iloc[0]
        used = b.n_tokens.sum()
        assert b.offset.tolist() == [0, *b.n_tokens.cumsum().tolist()[:-1]] and used <= cap and cap == min(c for c in (128, 512, 2048) if c >= used)
    assert packing.pack(df.limit(0)).count() == 0


def slow_packed(lengths, sizes, opened):
    """Best fit by looking at every bin, and at every piece to come when one is opened."""
    bins = []
    least = lambda n: min(c for c in sizes if c >= n)
    for at, n in enumerate(lengths):
        fits = [cap - used for cap, used in bins if cap - used >= n]
        if fits:
            k = max(j for j, (cap, used) in enumerate(bins) if cap - used == min(fits))
        else:
            options = []
            for c in sorted(opened):
                if c >= n:
                    held = n
                    for x in lengths[at + 1 :]:
                        held += x if held + x <= c else 0
                    options.append((Fraction(packing.cost(least(held)), held), c))
            bins.append((min(options)[1] if options else least(n), 0))
            k = len(bins) - 1
        bins[k] = (bins[k][0], bins[k][1] + n)
    return [least(used) for _, used in bins]


def test_best_fit_opens_the_least_cost_size():
    r = random.Random(3)
    gained = 0
    for _ in range(60):
        lengths = sorted((r.randrange(1, 65) for _ in range(r.randrange(1, 60))), reverse=True)
        costs = {}
        for opened in [(16,), (32,), (64,), (16, 32), (16, 64), (32, 64), (16, 32, 64)]:
            bins, offsets, caps = packing.packed(lengths, (16, 32, 64), opened)
            assert sorted(caps) == sorted(slow_packed(lengths, (16, 32, 64), opened))
            assert all(sum(n for n, b in zip(lengths, bins, strict=True) if b == k) <= cap for k, cap in enumerate(caps))
            costs[opened] = sum(map(packing.cost, caps))
        best = packing.best(lengths, (16, 32, 64))
        assert sum(map(packing.cost, best[2])) == min(costs.values())
        gained += min(costs.values()) < min(c for s, c in costs.items() if len(s) == 1)
    assert gained  # mixed sizes are of use


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(n):
    a = shards.permuted(np.arange(n), n, "k")
    assert sorted(a.tolist()) == list(range(n))
    assert n < 64 or a.tolist() != shards.permuted(np.arange(n), n, "other").tolist()


def test_shards_round_trip(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, " ".join(r.choices(("alpha", "beta", "\n", "été", "🙂"), k=r.randrange(0, 90)))) for k in range(60)] + [(None, "no id"), (3, "again"), (4, None), (5, "")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, slot int").repartition(3)
    path, n = shards.materialise(df, f"{tmp_path}/s", length=16, per_shard=10)
    got = shards.records(spark, path, length=16, per_shard=10).collect()
    assert sorted(x["slot"] for x in got) == list(range(n))
    bpe = tokens.Bpe(open(tokens.RANKS_PATH, "rb").read())
    want = []
    for d, t in rows:
        ids = np.frombuffer(bpe.encode(t), "<u2").tolist()
        want += [(d, k // 16, ids[k : k + 16]) for k in range(0, len(ids), 16)]
    assert sorted(((x["doc_id"], x["seq"], x["ids"]) for x in got), key=repr) == sorted(want, key=repr)
    sizes = [os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]
    assert len(sizes) == -(-n // 10) and sorted(sizes)[-1] == 10 * shards.stride(16) and sum(sizes) == n * shards.stride(16)
    rest = shards.records(spark, path, length=16, per_shard=10, first_slot=25).collect()
    assert sorted(x["slot"] for x in rest) == list(range(25, n))
    for d, _, fs in os.walk(path):
        for f in fs:
            if f.startswith("part-"):
                raw, shard = open(f"{d}/{f}", "rb").read(), int(d.rpartition("=")[2])
                assert [int.from_bytes(raw[k : k + 8], "little") for k in range(0, len(raw), shards.stride(16))] == list(range(shard * 10, min(n, shard * 10 + 10)))
    assert shards.records(spark, path, length=16, per_shard=10, first_slot=n).count() == 0
    again, _ = shards.materialise(df, f"{tmp_path}/t", length=16, per_shard=10)
    assert shards.records(spark, again, length=16, per_shard=10).count() == n


def test_no_sequences(spark, tmp_path):
    path, n = shards.materialise(spark.createDataFrame([(1, None)], "doc_id long, text string"), f"{tmp_path}/e")
    assert n == 0 and shards.records(spark, path).count() == 0


@pytest.mark.parametrize("first", [0, 7, 9, 10, 99, 130, 899, 1999])
def test_globs_of_shard_numbers(first):
    """Every alternative as a regular expression, against comparison."""
    parts = shards._at_least(first)[1:-1].split(",")
    assert [k for k in range(3000) if any(re.fullmatch(p, str(k)) for p in parts)] == list(range(first, 3000))


def test_broken_shard(spark, tmp_path):
    path, n = shards.materialise(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), f"{tmp_path}/b")
    part = next(f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.startswith("part-"))
    whole = open(part, "rb").read()
    os.remove(f"{os.path.dirname(part)}/.{os.path.basename(part)}.crc")
    with open(part, "wb") as f:
        f.write(whole[:-5])
    with pytest.raises(Exception):
        shards.records(spark, path).collect()


PII = [
    "call +1 (415) 555-2671 or (212) 555-0100!! x", "card 4111111111111111 bad 4111111111111112 and 4111 1111 1111 1111.", "ip 152.143.123.131!! 300.1.1.1 1.2.3", "born 1990-02-28, 31/12/1999, 2001-02-30; 05.06.1970",
    "mail thwhhe.99@mail9.example.com###", "ssn 123-45-6789 666-12-1234", "iban DE89370400440532013000 x", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "4111111111111111 and again 4111111111111111", None, "", "plain", "x" * 300_000,
]


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    rows = [(k, t, 1) for k, t in enumerate(PII)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, _pii int")
    out = pii.pseudonymise(df, "k", found_col="f").orderBy("doc_id").collect()
    text = {x["doc_id"]: x["text"] for x in out}
    found = [(m["k"], m["v"], m["w"]) for x in out for m in x["f"] or []]
    by = {v: w for _, v, w in found}
    assert out[0] == out[1] and out[0]["_pii"] == 1
    assert (text[9], text[10], text[11], text[12]) == (None, "", "plain", "x" * 300_000)
    kinds = {k for k, _, w in found if w}
    assert kinds == set(pii.KINDS)
    for k, v, w in found:
        if w is None:
            assert v in ("4111111111111112", "300.1.1.1", "2001-02-30", "666-12-1234")
            continue
        assert w != v
        if k not in ("email", "secret", "ipv4"):
            assert re.sub("[0-9]", "9", w) == re.sub("[0-9]", "9", v)
        if k == "card":
            assert luhn(re.sub("[^0-9]", "", w))
        if k == "iban":
            assert int("".join(str(int(c, 36)) for c in w[4:] + w[:4])) % 97 == 1
        if k == "ipv4":
            assert all(int(o) < 256 and str(int(o)) == o for o in w.split("."))
    assert re.sub("[^0-9]", "", by["4111 1111 1111 1111"]) == by["4111111111111111"]
    assert text[8] == f"{by['4111111111111111']} and again {by['4111111111111111']}"
    for k, t in enumerate(PII[:9]):
        for v, w in by.items():
            t = t.replace(v, w or v)
        assert text[k] == t


def plain_emails(text):
    """Letter by letter: from every @, the local part to its left and the longest domain to its right."""
    out, done = [], 0
    local, domain = set(string.ascii_letters + string.digits + "._%+-"), set(string.ascii_letters + string.digits + ".-")
    for at in (k for k, c in enumerate(text) if c == "@"):
        a = z = at
        while a > done and text[a - 1] in local:
            a -= 1
        while z + 1 < len(text) and text[z + 1] in domain:
            z += 1
        for end in range(z + 1, at, -1):
            *labels, top = text[at + 1 : end].split(".")
            if 1 <= len(labels) <= 8 and all(1 <= len(x) <= 63 for x in labels) and 2 <= len(top) <= 24 and top.isalpha() and 1 <= at - a <= 64 and (a == 0 or text[a - 1] not in local):
                out.append(text[a:end])
                done = end
                break
    return out


def test_emails_before_signs(spark):
    ends = ["", ".", ". Thanks", "...", "... more", ")", ").", ",", "!", ".\n", "..", ".2", ".x y", "-", ".-"]
    mails = ["bob@example.com", "bob@mail.example.com", "a.b+c@x-1.co.uk", "..b@a.bc"]
    texts = [f"{start}{mail}{end}" for mail in mails for end in ends for start in ("", "to (", "x ")]
    r = random.Random(5)
    texts += ["".join(r.choices(["ab", "c", "@", ".", "-", " ", "1", "com", "d" * 24, "e" * 63], weights=[9, 6, 5, 9, 2, 2, 2, 4, 1, 1], k=r.randrange(3, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in pii.pseudonymise(df, "k", found_col="f").collect()}
    for k, text in enumerate(texts):
        assert [m["v"] for m in got[k]["f"] if m["k"] == "email"] == plain_emails(text), text
    assert all(mail.split("@")[0] + "@" not in got[k]["text"] for k, mail in enumerate(m for m in mails for _ in range(3 * len(ends))))
    assert got[6]["text"].endswith("@example.com. Thanks")


def test_printed_forms(spark):
    whole = ["+33 12 34 56 78 90", "+33 1 23 45 67 89", "+1 415 555 2671", "+4915112345678", "+49 (0) 1", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 01"]
    texts = [*(f"at {v}, x" for v in whole), "at 2021-03-04T10:00:00Z", "2021-03-04Tx", "2021-03-04", "+33 12 34 56 78 90 2021-03-04", "+" + "1" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[(m["k"], m["v"], m["w"]) for m in x["f"]] for x in pii.pseudonymise(df, "k", found_col="f").orderBy("doc_id").collect()]
    for k in (0, 1, 2, 3, 5, 6, 7, 8):
        ((kind, v, w),) = got[k]
        assert v == whole[k] and kind == ("phone" if k < 4 else "iban") and re.sub("[0-9]", "9", w) == re.sub("[0-9]", "9", v) and w != v
        plain = w.replace(" ", "")
        assert kind == "phone" or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[5][0][2].replace(" ", "") == got[6][0][2] and got[9][0][2] is None and got[4] == []
    assert got[10] == got[12] and got[10][0][:2] == ("date", "2021-03-04") and got[11] == []
    assert [m[:2] for m in got[13]] == [("phone", "+33 12 34 56 78 90"), ("date", "2021-03-04")] and got[14] == []


def test_more_forms(spark):
    """Written dates, month before day, other groupings; what is walked on stays in its form and valid."""
    whole = ["12/31/1980", "Jan 5, 1980", "January 15, 1980", "5 May 1980", "05 May 1980", "3782 822463 10005", "3782-822463-10005", "078 05 1120", "4111-1111-1111-1111"]
    left = ["13/13/1999", "May 40, 1990", "3782 822463 10006", "123-00-6789", "123-45-0000", "666 45 1234"]
    df = spark.createDataFrame([(k, f"at {v}; x") for k, v in enumerate(whole + left)], "doc_id long, text string")
    got = [x["text"][3:-3] for x in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    assert got[len(whole) :] == left
    for v, w in zip(whole, got, strict=False):
        assert w != v and re.sub("[0-9]", "9", re.sub("[A-Z][a-z]+", "M", w)) == re.sub("[0-9]", "9", re.sub("[A-Z][a-z]+", "M", v))
    assert int(got[0][3:5]) > 12 and luhn(re.sub("[^0-9]", "", got[5])) and got[5].replace(" ", "") == got[6].replace("-", "")
    days = spark.sql("SELECT id AS doc_id, date_format(date_add(DATE'1980-01-01', CAST(id AS INT)), IF(id % 2 = 0, 'MM/dd/yyyy', 'MMMM d, yyyy')) AS text FROM range(4000)")
    texts = [x["text"] for x in pii.pseudonymise(days, "k").collect()]
    assert len(set(texts)) == 4000
    ssn = spark.sql("SELECT id AS doc_id, concat('123-', lpad(id DIV 9999 + 1, 2, '0'), '-', lpad(id % 9999 + 1, 4, '0')) AS text FROM range(0, 989901, 97)")
    texts = [x["text"] for x in pii.pseudonymise(ssn, "k").collect()]
    assert len(set(texts)) == len(texts) and not any(x[4:6] == "00" or x[7:] == "0000" for x in texts)


def test_the_key_is_not_in_the_plan(spark):
    import hashlib

    run = pii.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "a-key")._jdf.queryExecution()
    for plan in (run.logical(), run.analyzed(), run.optimizedPlan(), run.executedPlan()):
        assert "a-key" not in plan.toString() and hashlib.sha256(b"a-key").hexdigest() not in plan.toString()


def test_dates_and_numbers_are_permuted(spark):
    """Different values stay different, and dates stay dates."""
    dates = spark.sql("SELECT id AS doc_id, date_format(date_add(DATE'1990-01-01', CAST(id AS INT)), 'yyyy-MM-dd') AS text FROM range(3000)")
    got = [x["text"] for x in pii.pseudonymise(dates, "k").collect()]
    assert len(set(got)) == 3000 and all("1800-01-01" <= d <= "2199-12-31" for d in got)
    ips = spark.sql("SELECT id AS doc_id, concat('10.0.', id DIV 256, '.', id % 256) AS text FROM range(3000)")
    assert len({x["text"] for x in pii.pseudonymise(ips, "k").collect()}) == 3000
    assert pii.pseudonymise(ips, "k").collect() != pii.pseudonymise(ips, "other").collect()


def test_feistel_is_plain_arithmetic(spark):
    import hashlib

    def number(kind, value):
        return int(hashlib.sha256(f"key|{kind}|{value}".encode()).hexdigest()[:12], 16)

    got = spark.sql(f"SELECT {pii._feistel(chr(39) + 'key' + chr(39), 'date', '100', '200', '189', '773')} AS p").first()["p"]
    a, b = 100, 200
    for r in range(1, pii.ROUNDS + 1):
        if r % 2 == 0:
            a = (a + number("date", f"{r}:189:773:{b}")) % 189
        else:
            b = (b + number("date", f"{r}:189:773:{a}")) % 773
    assert (got["a"], got["b"]) == (a, b)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.pseudonymise(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {x["doc_id"] for x in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(p.COLUMNS), name
        kept = [x["doc_id"] for x in out.select("doc_id").collect()]
        assert len(set(kept)) == len(kept) and set(kept) <= ids and len(kept) > 0.5 * len(ids), name
        docs, ids = spark.createDataFrame(out.collect(), out.schema), set(kept)
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert {x["doc_id"] for x in packed.collect()} == ids


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline_stages_against_plain_ones(spark):
    """What each stage keeps and returns, decided text by text or by looking at all pairs."""
    import corpus_pipeline as p
    from test_joins import brute
    from test_scores import best_set, plain_score

    from regionframe.llm import langid, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(x) for x in docs.select(*p.COLUMNS).collect()]
    got = {x["doc_id"] for x in p.language(spark, docs, SF).collect()}
    model = langid.fit(docs.filter(langid.fold(F.col("doc_id"), 5) != 0))
    for d, text, *_ in rows[::9]:
        letters = any(c.isalpha() for c in text or "")
        assert (d in got) == (letters and best_set(text, model, 3.0)[1].max() >= p.LEAST_SHARE), d

    got = {x["doc_id"] for x in p.toxic(spark, docs, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.filter(langid.fold(F.col("doc_id"), 3) != 1).join(labels, "doc_id"))
    short = [x for x in rows if len(x[1] or "") < 1500]
    assert len(short) > 20
    for d, text, *_ in short[::5]:
        assert (d in got) == (plain_score(text, model) < p.TOXIC), d

    got = sorted(x["doc_id"] for x in p.near_copies(spark, docs, SF).collect())
    assert got == sorted(d for d, _, c in brute([x[:2] for x in rows], 80, 100, 5) if c == d)

    found = {x["doc_id"]: x["text"] for x in p.pseudonyms(spark, docs, SF).collect()}
    assert len(found) == len(rows)
    for d, text, *_ in rows:
        if not re.search("[0-9@]|[0-9a-f]{32}", text or ""):
            assert found[d] == text

    bpe = tokens.Bpe(open(tokens.RANKS_PATH, "rb").read())
    placed = {}
    for x in p.packed(spark, docs, SF).collect():
        placed.setdefault(x["doc_id"], []).append(x["n_tokens"])
    assert {d: sum(n) for d, n in placed.items()} == {d: bpe.count(text) for d, text, *_ in rows}


def test_pipeline_cases(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(1, None, None, None, None), (None, "ab cd", "en", "s", 5), (2, "ab cd", "en", "s", 5), (2, "ab cd", "en", "s", 5), (3, "", "en", None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        out = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted((x["doc_id"] for x in out), key=repr) == ([2, None] if rows else [])


def test_near_copies_keep_unlike_texts_of_an_id(spark):
    import corpus_pipeline as p

    rows = [(2, "ab cd ef gh ij kl", "en", "s", 1), (2, "mn op qr st uv wx", "en", "s", 1), (2, "mn op qr st uv wx", "en", "t", 1), (3, "mn op qr st uv wx", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((x["doc_id"], x["text"]) for x in p.near_copies(spark, docs, "").collect())
    assert got == [(2, rows[0][1]), (2, rows[1][1])]


def test_pipeline_batches_are_small(spark):
    """Also where an operator was used before that allows larger ones."""
    import corpus_pipeline as p

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "ab cd", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(name)
    try:
        for stage in (p.language, p.near_copies, p.packed):
            spark.conf.set(name, str(4 << 20))
            stage(spark, docs, "")
            assert int(spark.conf.get(name)) <= 1 << 20
    finally:
        spark.conf.set(name, before)


def test_workers_drop_an_unused_tokenizer():
    with open(tokens.RANKS_PATH, "rb") as f:
        tokens.Bpe(f.read())
    assert list(tidy(iter, tokenizer=True)([1])) == [1] and tokens._coder.cache_info().currsize
    assert list(tidy(iter)([1])) == [1] and not tokens._coder.cache_info().currsize


def test_packing_needs_no_pandas(spark):
    """Its import would stay in every worker."""
    df = packing.pack(spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string"))
    assert "Pandas" not in df._jdf.queryExecution().executedPlan().toString()
