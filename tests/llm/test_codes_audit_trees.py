"""Vector codes, the filter audit and Merkle fingerprints against plain versions of them."""

import math
import os
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from cases import documents
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nichemap.llm import audit, codes, merkle, queries

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("q", T.StringType()), T.StructField("code", T.StringType()), T.StructField("a.b", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "x", "y", "z") for i, v, label in rows], VECTORS)


def plain_codes(rows, parts, entries, rounds):
    """In Python's own whole numbers, every round over all rows."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    lengths = Counter(len(x) for _, x, _ in kept)
    size = max(lengths, key=lambda n: (lengths[n], n))
    kept = sorted((r for r in kept if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i2").tobytes()))
    width = size // parts
    cut = lambda x, k: x[k * width : (k + 1) * width]
    books = [[cut(x, k) for _, x, _ in kept[:entries]] for k in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    find = lambda x, k: min((far(cut(x, k), e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        own = [defaultdict(list) for _ in range(parts)]
        for _, x, _ in kept:
            for k in range(parts):
                own[k][find(x, k)[1]].append(cut(x, k))
        for k in range(parts):
            for j, xs in own[k].items():
                books[k][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by = [], Counter()
    for i, x, label in kept:
        found = [find(x, k) for k in range(parts)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
        by[label] += out[-1][3]
    return [(*r, by[r[1]]) for r in out], books


def made(n, dims, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims)) * spread
    return [(int(i), (centres[i % 7] + rng.normal(size=dims) * spread / 4).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]


AWKWARD = [
    *made(60, 8, 1), (None, [0.1] * 8, 1), (None, [-0.1] * 8, None), (3, [0.5] * 8, 2), (3, [0.5] * 8, 2), (70, None, 1), (71, [0.0] * 7 + [None], 1), (72, [math.nan] * 8, 1), (73, [math.inf] + [0.0] * 7, 1), (74, [1.0] * 4, 1), (75, [], 1), (76, [0.0] * 8, 1), (77, [-0.0] * 8, 1),
]


@pytest.mark.parametrize(("rows", "parts", "entries", "rounds"), [(made(400, 8, 2), 4, 16, 4), (AWKWARD, 4, 5, 4), (AWKWARD, 2, 256, 3), (AWKWARD[:3], 4, 256, 4), ([], 4, 256, 4), (AWKWARD, 4, 5, 0), ([(1, [], 1), (2, [], None)], 4, 8, 2)])
def test_codes(spark, rows, parts, entries, rounds):
    coded, books = codes.compress(vectors(spark, rows).repartition(3), parts, entries, rounds)
    wanted, plain = plain_codes(rows, parts, entries, rounds)
    out = codes.with_label_errors(coded)
    assert Counter(tuple(r) for r in out.select("vec_id", "label", "code", "error", "label_error").collect()) == Counter(wanted)
    if plain:
        assert books.tolist() == plain


def test_codes_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    wanted, books = plain_codes(rows, 4, 256, 4)
    text = ",".join(str(x) for part in books for entry in part for x in entry)
    out = queries.op11_vector_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(tuple(r) for r in out.collect()) == Counter((i, c, e, s, sha256(text.encode()).hexdigest()) for i, _, c, e, s in wanted)


def test_rounds_shuffle_only_what_moved(spark):
    """The second round's shuffle has rows of entries that parts have left or joined, and none of others."""
    state = codes.stored(codes.quantised(vectors(spark, made(300, 8, 5)).select("vec_id", "label", F.col("embedding").alias("v")), "v", 1024))
    books = codes.integers([bytes(r["q"]) for r in state.rows.orderBy("vec_id").limit(9).collect()], 8).reshape(9, 2, 4).transpose(1, 0, 2).copy()
    one = codes.stored(codes.assigned(state.rows, books))
    assert codes.moved(one.rows, 2, 9, 4).agg(F.sum("n")).first()[0] == 600
    same = codes.stored(codes.assigned(one.rows, books))
    assert codes.moved(same.rows, 2, 9, 4).count() == 0
    books[0, 3] += 10_000  # entry 3 of part 0 loses all its parts, to entries of part 0
    two = codes.stored(codes.assigned(same.rows, books))
    change = codes.moved(two.rows, 2, 9, 4).collect()
    assert {r["part"] for r in change} == {0} and sum(r["n"] for r in change) == 0 and [r["n"] < 0 for r in change if r["entry"] == 3] == [True]
    for t in (state, one, same, two):
        assert os.path.isdir(t.path)
        t.forget()
        assert not os.path.exists(t.path)


def test_nearest_takes_large_numbers():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-(2**24), 2**24, (50, 16)), rng.integers(-(2**24), 2**24, (20, 16))
    at, far = codes.nearest(x, book)
    plain = [min((sum((int(p) - int(q)) ** 2 for p, q in zip(a, b, strict=True)), j) for j, b in enumerate(book)) for a in x]
    assert list(zip(far.tolist(), at.tolist(), strict=True)) == plain


def test_codes_restore(spark):
    """Vectors come back to about a step where every vector has an entry, and nearer than the centre of all elsewhere."""
    rows = made(300, 8, 3)
    for entries, least in ((256, 0.97), (16, 0.6)):
        coded, books = codes.compress(vectors(spark, rows), 4, entries)
        got = {r["vec_id"]: r["vector"] for r in codes.restored(coded, books).collect()}
        x, y = np.array([v for _, v, _ in rows]), np.array([got[i] for i, _, _ in rows])
        assert 1 - ((x - y) ** 2).sum() / ((x - x.mean(axis=0)) ** 2).sum() > least


def test_codes_refuse(spark):
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(vectors(spark, [(1, [0.0] * 6, 1)]))
    with pytest.raises(Exception, match="beyond"):
        codes.compress(vectors(spark, [(1, [1e9] * 8, 1)]))


def plain_audit(docs, labels):
    """docs: (doc_id, text, part)."""
    words = "\t\n\x0b\x0c\r "
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}  # a null is no id
    own = []
    for i, text, part in docs:
        t = text or ""
        w = [x for x in "".join(" " if c in words else c for c in t).split(" ") if x]
        fails = {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        fails |= {"E"} if any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in docs) else set()
        own.append((part or "", fails, i in good, i in toxic))
    out = []
    for part in {p for p, _, _, _ in own}:
        rows = [r for r in own if r[0] == part]
        made, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                made.append(("".join(order), step + 1, len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(part, *m[:-1], shapley[m[-1]]) for m in made]
    return out


NAMES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()), T.StructField("part", T.StringType()), T.StructField("_least", T.StringType())])


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("held", [500, 1])
def test_audit(spark, monkeypatch, empty, held):
    monkeypatch.setattr(audit, "HELD", held)
    docs = documents(spark, [] if empty else None).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s0").when(F.col("doc_id") % 3 == 1, "s1"))
    docs = docs.withColumns({"print": F.lit("x"), "fails": F.lit(1), "a.b": F.lit(2), "_id": F.lit(3)})
    labels = [] if empty else [(1, 1, 0), (2, 0, 1), (2, 0, 1), (4, 1, 1), (5, None, 1), (None, 1, 1), (6, 0, 0), (6, 1, 0), (99, 1, 1), (10, 1, None)]
    given = spark.createDataFrame([(*x, "p", "q") for x in labels], NAMES)
    out = audit.audit(docs.repartition(3), given, F.col("source"))
    plain = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], labels)
    assert Counter(tuple(r) for r in out.collect()) == Counter(plain)
    assert empty or len(plain) == 3 * 600


def test_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120)
    for bits in range(32):
        for j, order in enumerate(audit.ORDERS):
            failed = [k for k, f in enumerate(order) if bits >> "ABCDE".index(f) & 1]
            assert table[bits, j] == (failed[0] if failed else 5)


def plain_edits(docs):
    """(doc_id, n_chars, hash of the edited text) and the texts: own, edited, next."""
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, t, edited, after))
    return out


@pytest.fixture(params=["made", "sf", "empty", "one"])
def texts(request, spark, sf):
    if request.param == "sf":
        return spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    return documents(spark, {"empty": [], "one": [(5, "A text. Of two sentences.")]}.get(request.param)).withColumns({"_at": F.lit(1), "_range": F.lit(2), "next": F.lit(3), "a.b": F.lit(4), "leaves": F.lit(5)})


@pytest.mark.parametrize("least", [64, 1])
def test_trees(spark, texts, least, monkeypatch):
    monkeypatch.setattr(merkle, "LEAST", least)
    plain = plain_edits([(r["doc_id"], r["text"] or "") for r in texts.select("doc_id", "text").collect()])
    out = merkle.against_edits(texts).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == Counter((i, len(t), sha256(e.encode()).hexdigest()) for i, t, e, _ in plain)
    prints = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in out}
    by_text, by_print = {}, {}
    for i, t, e, after in plain:
        r = prints[i, len(t), sha256(e.encode()).hexdigest()]
        assert (r["near_edited"] == 1) == (t == e) and (r["near_next"] == 1) == (t == after)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for text, fp in ((t, r["fingerprint"]), (e, r["edited_fingerprint"])):
            assert by_text.setdefault(text, fp) == fp and by_print.setdefault(fp, text) == text
    if len(plain) == 1000:  # half of a text is left, and next documents are others
        share = {(i, len(t)): 2 * (len(t) - len(t) // 2) / (len(t) + len(e)) for i, t, e, _ in plain}
        long = [r for r in out if r["n_chars"] > 1000 and r["near_next"] < 0.1]
        assert len(long) > 500 and np.mean([abs(r["near_edited"] - share[r["doc_id"], r["n_chars"]]) < 0.15 for r in long]) > 0.9
        assert np.mean([r["near_next"] < 0.1 for r in out]) > 0.97


def test_trees_locate_edits(spark):
    """One word changed in one of many paragraphs: the paragraph is found, by its place, and sections elsewhere are the same."""
    lines = [f"Line {k} has words {k * k} of its own and ends.\n" for k in range(200)]
    at = 77
    other = "".join([*lines[:at], lines[at].replace("words", "other words"), *lines[at + 1 :]])
    gone = "".join(lines[:at] + lines[at + 1 :])
    df = spark.createDataFrame([(1, "".join(lines)), (2, other), (3, gone), (4, "".join(lines))], "doc_id long, text string")
    fp = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(df).collect()}
    assert fp[1] == fp[4] and len({fp[1], fp[2], fp[3]}) == 3
    pairs = spark.createDataFrame([("changed", fp[1], fp[2]), ("gone", fp[1], fp[3]), ("same", fp[1], fp[4])], "what string, one string, other string")
    found = {r["what"]: r for r in merkle.edits(pairs, "one", "other").withColumn("near", merkle.likeness(F.col("one"), F.col("other"))).collect()}
    sizes = [(len(s) - 9) // 8 for s in fp[1][33:].split("-")]
    assert sum(sizes) == 200
    for what in ("changed", "gone"):
        places = [sum(sizes[: e["section"]]) + p for e in found[what]["edited"] for p in e["paragraphs"]]
        assert places == [at] and 0.98 < found[what]["near"] < 1
    assert found["same"]["edited"] == [] and found["same"]["near"] == 1


def test_ranges_deal_evenly(spark):
    """Ids in clumps: ranges keep their order, and none has much more than its share."""
    ids = spark.range(20_000).select(F.when(F.col("id") < 15_000, F.col("id")).otherwise(F.col("id") * 1_000_003).alias("_id"))
    of, n = merkle.ranges(ids, 40)
    seen = sorted((r["_id"], r["of"]) for r in ids.select("_id", of.alias("of")).collect())
    assert [r for _, r in seen] == sorted(r for _, r in seen)
    assert max(Counter(r for _, r in seen).values()) < 2 * 20_000 / 40 and max(r for _, r in seen) < n
