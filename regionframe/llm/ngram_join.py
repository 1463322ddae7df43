"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every text is the set of its distinct word shingles.  Two documents link when
``den * |x & y| >= num * |x | y|``.  With ``o(x, y)`` the smallest sufficient
intersection, linked sets share at least ``l`` of their first ``|x| - o + l``
and ``|y| - o + l`` shingles under any one global order (``l = 1`` is the usual
prefix filter).  Each document picks its own ``l`` from the estimated cost of
its candidates; a pair has to share ``min(l_x, l_y)`` prefix shingles.

Steps, each linear in its input:

1. equal sets fall into one class (partial aggregation by a 128-bit digest);
2. a fixed-size histogram of hashed shingles over all documents gives the
   global order, rarest first (order only steers cost, never the result);
3. prefix shingles that no other class has are dropped.  Their number bounds
   the intersections a document can still reach, and so its partners' sizes;
4. hot groups collapse first: each shared shingle names one pivot, the most
   central document that has it; verified links to pivots form components
   (parities of 256 hash classes bound the difference of two sets beforehand);
5. the exact join runs between components only: one posting for each shingle
   and component, so that a family of near copies never meets itself.  Component
   pairs that can still hold a link are opened and their members counted,
   then verified on whole sets.

Nothing is capped: pairs inside a component need no link of their own, every
pair across components passes the exact filters of step 5.

Cases: null or empty text, or text without a word, has an empty set, links with
nothing and is its own component.  A null id takes no part in links; its
component is the smallest id of documents with the same set, else null.
Repeated rows get equal results, one for each row.  An id that carries several
texts counts as one document with the links of each; where there is one, rows
are joined first, and components that share an id after that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.llm.arrow import batched, slices, tidy
from regionframe.llm.components import components
from regionframe.llm.store import modest_batches, small_or_shuffled, written
from regionframe.llm.text import shingle_set, word_hashes

#: 2**SKETCH_BITS buckets of the shingle histogram; one byte each when broadcast.
SKETCH_BITS = 21
BLOCK = 1 << 16
#: Highest number of shared prefix shingles that a document may ask for.
LEVELS = 8
#: Cost of verifying a candidate, in postings scanned.
VERIFY_COST = 60.0
#: A class with more than this part of all rows is large.
LARGE = 1000

_SEEN = "doc_id long, n long, d1 long, d2 long, block int, counts binary"
_PREFIX = "doc_id long, n long, d1 long, d2 long, toks array<long>, b0 long, b1 long, b2 long, b3 long"
_SETS = "doc_id long, toks array<long>"


def _digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits over the sorted set."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _rows(batches):
    for b in slices(batches, 1000):
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


_I = pa.int64()
_SEEN_A = pa.schema([("doc_id", _I), ("n", _I), ("d1", _I), ("d2", _I), ("block", pa.int32()), ("counts", pa.binary())])
_PREFIX_A = pa.schema([("doc_id", _I), ("n", _I), ("d1", _I), ("d2", _I), ("toks", pa.list_(_I)), ("b0", _I), ("b1", _I), ("b2", _I), ("b3", _I)])
_SETS_A = pa.schema([("doc_id", _I), ("toks", pa.list_(_I))])


def _seen(width: int):
    def run(batches):
        counts, hashes = np.zeros(1 << SKETCH_BITS, np.uint32), word_hashes()

        def rows():
            for doc, text in _rows(batches):
                h = shingle_set(text, width, hashes)
                np.add.at(counts, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                yield (doc, len(h), *_digest(h), None, None)
            for k in range(0, len(counts), BLOCK):
                if counts[k : k + BLOCK].any():
                    yield None, None, None, None, k // BLOCK, _sparse(counts[k : k + BLOCK])

        yield from batched(rows(), _SEEN_A)

    return run


def _added(last: bool):
    """Adds up the counts of each block, one row after the other: a task holds one sum for each of its blocks."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = counts.as_buffer()
                kind = np.dtype(np.int64 if raw.size % 2 else np.uint32)
                n = raw.size // (2 + kind.itemsize)
                sums = total.setdefault(block, np.zeros(BLOCK, np.int64))
                sums[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw, kind, n, 2 * n).astype(np.int64)
        for block, sums in total.items():
            out = np.minimum(255, np.round(5 * np.log2(1 + sums))).astype(np.uint8).tobytes() if last else _sparse(sums)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out], pa.binary())], names=["block", "counts"])

    return run


def _sparse(counts: np.ndarray) -> bytes:
    """Places and counts, of four bytes each, or of eight where one needs it: the length is odd then."""
    at = np.flatnonzero(counts)
    large = len(at) and int(counts[at].max()) >> 32
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.int64 if large else np.uint32).tobytes() + (b"\0" if large else b"")


def _levels(seen: DataFrame) -> bytes:
    """The histogram's logarithms.  Counts of more than 256 partitions are added in two steps, so that no task reads those of all."""
    blocks = (1 << SKETCH_BITS) // BLOCK
    counts = seen.filter("block IS NOT NULL").select("block", "counts", F.expr("spark_partition_id() DIV 256").alias("part"))
    some = counts.repartition("block", "part").select("block", "counts").mapInArrow(_added(False), "block int, counts binary")
    sketch = bytearray(1 << SKETCH_BITS)
    for r in some.repartition(blocks, "block").mapInArrow(_added(True), "block int, counts binary").collect():
        sketch[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["counts"]
    return bytes(sketch)


def _prefixes(width: int, num: int, den: int, sketch):
    def run(batches):
        level, hashes = np.frombuffer(sketch.value, np.uint8), word_hashes()

        def rows():
            for doc, text in _rows(batches):
                h = shingle_set(text, width, hashes)
                n = len(h)
                if not n:
                    continue
                keep = min(n, n - -(-num * n // den) + LEVELS)
                rank = level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                # rarest first, then by hash; the set is sorted, so a stable sort is enough
                first = np.argsort(rank, kind="stable")[:keep]
                odd = np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1
                yield (doc, n, *_digest(h), h[first].view(np.int64).tolist(), *np.packbits(odd).view(np.int64).tolist())

        yield from batched(rows(), _PREFIX_A)

    return run


def _sets(width: int):
    def run(batches):
        hashes = word_hashes()
        yield from batched(((doc, shingle_set(text, width, hashes).view(np.int64).tolist()) for doc, text in _rows(batches)), _SETS_A, 128)

    return run


def _verified(pairs: DataFrame, src: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, on whole sets, made anew for the documents concerned."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids", 2 * pairs.count())
    texts = src.join(small_or_shuffled(ids, ids.count(), 16), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(tidy(_sets(width)), _SETS).dropDuplicates(["doc_id"]), "sets")
    x = sets.select(F.col("doc_id").alias("a"), F.col("toks").alias("tx"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("toks").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    return written(pairs.join(x, "a").join(y, "b").filter(both * (num + den) >= num * (F.size("tx") + F.size("ty"))).select("a", "b"), "links")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 90, den: int = 100, width: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (see the module's text)."""
    spark = docs.sparkSession
    modest_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    seen = written(src.mapInArrow(tidy(_seen(width)), _SEEN), "seen")
    rows = seen.filter("block IS NULL").select("doc_id", "n", "d1", "d2")
    differ = F.min(F.struct("d1", "d2")) != F.max(F.struct("d1", "d2"))
    if rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(differ.alias("several")).filter("several").limit(1).count():
        return _of_several(src, num, den, width)
    total = rows.count()
    classes = written(rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), "classes", total)
    held = spark.sparkContext.broadcast(_levels(seen))

    found = src.mapInArrow(tidy(_prefixes(width, num, den, held)), _PREFIX)
    reps = classes.select(F.col("rep").alias("doc_id"), "d1", "d2").filter("doc_id IS NOT NULL")
    prefix = written(found.join(reps, ["doc_id", "d1", "d2"], "left_semi").drop("d1", "d2").dropDuplicates(["doc_id", "n"]), "prefix")

    posted = prefix.select("doc_id", "n", F.posexplode("toks").alias("i", "tok"))
    shared = posted.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    items = posted.join(shared, "tok").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("i", "tok", "df"))).alias("items"))
    posts = written(_chosen(items, num, den).join(prefix.select("doc_id", "n", "b0", "b1", "b2", "b3"), ["doc_id", "n"]), "posts")

    links = _verified(_pivot_pairs(posts, num, den), src, width, num, den)
    stars = components(links, links.count())
    posts = written(posts.join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "posts")
    across = _verified(_across(posts, num, den), src, width, num, den)
    links = across.join(stars.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(stars.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(links, across.count())
    # no full join: Spark splits the left side of this one where a component is large; a component's own id is one of its nodes
    tops = merged.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    starred = stars.join(tops, "comp", "left").select(F.col("node").alias("rep"), F.coalesce("top", "comp").alias("comp"))
    final = starred.union(merged.select(F.col("node").alias("rep"), "comp")).distinct()
    named = written(classes.join(final, "rep", "left").select("d1", "d2", "rows", F.coalesce("comp", "rep").alias("component_id")), "named", total)
    # rows of the few largest classes, of which there are less than LARGE, find theirs without a shuffle; so no class meets in one task
    large = named.filter(F.col("rows") * LARGE > total).select("d1", "d2", F.struct("component_id").alias("hit"))
    near = rows.filter("n > 0").join(F.broadcast(large), ["d1", "d2"], "left")
    alike = near.filter("hit IS NOT NULL").select("doc_id", "n", "hit.component_id")
    other = near.filter("hit IS NULL").join(named.filter(F.col("rows") * LARGE <= total), ["d1", "d2"]).select("doc_id", "n", "component_id")
    empty = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return alike.unionByName(other).unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _of_several(src: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """similarity_components where ids carry several texts: of single rows first, then the rows' components that share an id are one."""
    held = written(src.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("node"), "text"), "held")
    found = written(similarity_components(held, "node", "text", num, den, width), "found")
    # rows without an id keep their row's component, if any
    named = written(found.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "node").join(held.select("node", F.col("doc_id").alias("id")), "node").select("id", "n_shingles", F.col("component_id").alias("comp")), "named")
    first = named.groupBy("id").agg(F.min("comp").alias("a"))
    merged = components(named.join(first, "id").filter("comp != a").select("a", F.col("comp").alias("b")).distinct())
    tops = merged.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    ids = named.join(tops, "comp", "left").withColumn("top", F.coalesce("top", "comp"))
    least = written(ids.groupBy("top").agg(F.min("id").alias("component_id")), "least")
    nameless = found.filter("doc_id IS NULL").select(F.col("doc_id").alias("id"), "n_shingles", F.col("component_id").alias("comp"))
    every = named.unionByName(nameless).join(tops, "comp", "left").withColumn("top", F.coalesce("top", "comp"))
    return every.join(least, "top", "left").select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def _chosen(items: DataFrame, num: int, den: int) -> DataFrame:
    """Postings (doc_id, n, lo, hi, u, l, tok, ti, tp) under the number of matches each document asks for.

    ``u`` emitted prefix shingles are in no other emitted prefix.  A partner that
    is not larger then holds at most ``n - u`` of the set's shingles: one that it
    holds past its own prefix is preceded there by as many that the set lacks.
    So a partner's size is at least ``lo`` and, if not above ``n``, at most ``hi``.
    ``tp`` (``ti``) is the least ``l`` whose probing (indexed) prefix holds the
    shingle; the smaller set of a pair needs the indexed one only.  With S(l)
    the postings met under ``l``, about S(l) / l candidates reach ``l`` matches;
    the cheapest ``l`` wins.
    """
    c = num + den
    out = items.withColumn("lo", F.expr(f"(n * {num} + {den - 1}) DIV {den}")).withColumn("ci", F.expr(f"(n * {2 * num} + {c - 1}) DIV {c}"))
    out = out.withColumn("u", F.expr(f"least(n, n - lo + {LEVELS}) - size(items)"))
    out = out.withColumn("hi", F.expr(f"({c} * (n - u) - {num} * n) DIV {num}"))
    out = out.withColumn("items", F.expr("transform(items, x -> named_struct('tok', x.tok, 'df', x.df, 'ti', greatest(1L, x.i - (n - ci) + 1), 'tp', greatest(1L, x.i - (n - lo) + 1)))"))
    cost = lambda l: f"aggregate(filter(items, x -> x.tp <= {l}), 0D, (s, x) -> s + x.df - 1) * (1 + {VERIFY_COST} / {l})"
    costs = ", ".join(f"named_struct('cost', CASE WHEN lo >= {l} OR {l} = 1 THEN {cost(l)} ELSE double('infinity') END, 'l', {l}L)" for l in range(1, LEVELS + 1))
    out = out.withColumn("l", F.expr(f"array_min(array({costs})).l"))
    out = out.select("doc_id", "n", "lo", "hi", "u", "l", F.explode("items").alias("x"))
    return out.select("doc_id", "n", "lo", "hi", "u", "l", "x.tok", "x.ti", "x.tp").filter("tp <= l")


#: The sizes, and the prefixes on either side, that a pair's filters allow; s and g stand for the two sides.
_SIZES = "CASE WHEN s.n < g.n THEN s.n BETWEEN g.lo AND g.hi WHEN s.n > g.n THEN g.n BETWEEN s.lo AND s.hi ELSE s.n <= least(s.hi, g.hi) END"
_TIERS = "CASE WHEN s.n <= g.n THEN s.ti <= least(s.l, g.l) AND g.tp <= least(s.l, g.l) ELSE g.ti <= least(s.l, g.l) AND s.tp <= least(s.l, g.l) END"


#: Sets differ at least in the bits in which the parities of their hashed shingles differ.
_PARITY = " + ".join(f"bit_count(s.b{k} ^ g.b{k})" for k in range(4))


def _pair(x: str, y: str, num: int, den: int) -> str:
    """SQL: what a linked pair of documents satisfies wherever they share a prefix shingle."""
    differ = f"({_PARITY}) <= s.n + g.n - 2 * (({num} * (s.n + g.n) + {num + den - 1}) DIV {num + den})"
    return f"({_SIZES}) AND ({_TIERS}) AND ({differ})".replace("s.", f"{x}.").replace("g.", f"{y}.")


def _counted(met: DataFrame) -> DataFrame:
    """Pairs with as many shared prefix shingles as both sides ask for, with that number."""
    pairs = met.groupBy(F.col("x.doc_id").alias("x"), F.col("y.doc_id").alias("y")).agg(F.count(F.lit(1)).alias("k"), F.max(F.least("x.l", "y.l")).alias("need"))
    return pairs.filter("k >= need")


_ONE = ("doc_id", "n", "lo", "hi", "l", "ti", "tp", "b0", "b1", "b2", "b3")


def _pivot_pairs(posts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): each document with the two pivots it shares most prefix shingles with; a < b.

    A shingle's pivot is the document, of those that have it, with the fewest shingles of its own.
    """
    pivots = posts.groupBy("tok").agg(F.min(F.struct("u", *_ONE)).alias("y"))
    met = posts.select("tok", F.struct(*_ONE).alias("x")).join(pivots, "tok").filter("x.doc_id != y.doc_id").filter(_pair("x", "y", num, den))
    best = _counted(met).groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "y")), asc=False), 1, 2).alias("best"))
    return best.select("x", F.explode("best.y").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _across(posts: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (a, b) of documents in different components that pass every filter."""
    # m stands for a component's one member; what is true of members decides where there are more
    by = posts.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*_ONE)).alias("m"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    side = lambda s: by.select("tok", *[F.col(c).alias(f"{s}_{c}") for c in ("comp", "c", "m", "n0", "n1", "lo", "hi")])
    alone = f"CASE WHEN x_c = 1 AND y_c = 1 THEN {_pair('x_m', 'y_m', num, den)} ELSE (x_n0 <= y_hi AND x_n1 >= y_lo) OR (y_n0 <= x_hi AND y_n1 >= x_lo) END"
    met = side("x").join(side("y"), "tok").filter(f"x_comp < y_comp AND {alone}")
    one = lambda s: posts.select("tok", F.col("comp").alias(f"{s}_comp"), F.struct(*_ONE).alias(s))
    half = f"CASE WHEN y_c = 1 THEN {_pair('x', 'y_m', num, den)} ELSE (x.n <= y_hi AND x.n >= y_lo) OR (y_n0 <= x.hi AND y_n1 >= x.lo) END"
    opened = met.join(one("x"), ["tok", "x_comp"]).filter(half).select("tok", "y_comp", "x").join(one("y"), ["tok", "y_comp"]).filter(_pair("x", "y", num, den))
    return _counted(opened).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
