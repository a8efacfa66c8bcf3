"""Each operator against a plain version of it, on the small tables and on hand-made awkward rows."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
import xxhash
from cases import documents

from nichemap.llm import bpe, packing, pii, quality, queries, repeats, secrets, simhash, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ("made", "sf", "empty")


@pytest.fixture(params=TABLES)
def docs(request, spark, sf):
    if request.param == "sf":
        return spark.read.parquet(f"{sf}/documents.parquet").repartition(4)
    return documents(spark, [] if request.param == "empty" else None)


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(df, wanted):
    got = Counter(tuple(r) for r in df.collect())
    assert got == Counter(wanted), list((got - Counter(wanted)).items())[:3] + list((Counter(wanted) - got).items())[:3]


def written(found, order):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], order.index(x[0]))))


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]{1,500}@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]{1,500}(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii(docs):
    wanted = []
    for i, t in rows(docs):
        own = plain_pii(t or "")
        n = Counter(k for k, _, _ in own)
        more = pii.find(t or "")[1]
        wanted.append((i, *(n[k] for k in pii.KINDS), sha256(written(own, pii.KINDS).encode()).hexdigest(), written(own + more, pii.KINDS)))
    same(spans.digest(docs, pii.find, pii.KINDS, pii.KINDS), wanted)


@pytest.mark.parametrize(("text", "found"), [
    ("mail jo.do (at) exa-mple [dot] com now", [("email", "jo.do (at) exa-mple [dot] com")]),
    ("jo at example dot co dot uk", [("email", "jo at example dot co dot uk")]),
    ("plus four four seven one two three four five six seven eight nine", [("phone", "plus four four seven one two three four five six seven eight nine")]),
    ("x＠ｙ．com, 192․168.0.1 аb@сd.org", [("email", "x＠ｙ．com"), ("email", "аb@сd.org"), ("ip", "192․168.0.1")]),
    ("a​b@c​d.org", [("email", "a​b@c​d.org")]),
    ("jane dot doe at mail dot example dot com!", [("email", "jane dot doe at mail dot example dot com")]),
    ("jane.doe at example.com, look at example.com", [("email", "jane.doe at example.com")]),
    ("a&#64;b&#46;com", [("email", "a&#64;b&#46;com")]),
    ("so at the dot of it; one two, three", []),
    ("a dot " * 20_000 + " at " + "b dot " * 20_000 + "(" * 20_000 + " " * 20_000 + "[at", []),
])
def test_pii_disguised(text, found):
    base, more = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in more if (k, a, b) not in base] == found


def test_redact(spark):
    got = spans.redact(documents(spark, [(1, "a b@c.de f"), (2, None)]), pii.find).select("text", "spans").collect()
    assert [tuple(x) for x in got] == [("a [EMAIL] f", "clash"), (None, "clash")]


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


def test_secrets(docs):
    wanted = []
    for i, t in rows(docs):
        own = plain_secrets(t or "")
        n = Counter(k for k, _, _ in own)
        wanted.append((i, *(n[k] for k in secrets.BASE), sha256(written(own, secrets.BASE).encode()).hexdigest(), written(own + secrets.find(t or "")[1], secrets.KINDS)))
    same(spans.digest(docs, secrets.find, secrets.KINDS, secrets.BASE), wanted)


def test_secret_models_tell_random_from_ordinary():
    model = secrets.default_model()
    held = secrets.default_samples(2000, seed=99)
    assert sum(model.score(s) > model.threshold for s, y in held if y and len(s) >= 20) > 0.95 * sum(y for s, y in held if len(s) >= 20)
    assert sum(model.score(s) > model.threshold for s, y in held if not y) <= 2
    base, more = secrets.find("key Zx8Qp2Lm9Rt4Wv7Yb3Nc but not configurationManagerFactory")
    assert not base and [k for k, *_ in more] == ["random"]


FILLER = "the report says that all of it went as it should, in time and as planned; see page 7 of the annex. ".split()


def in_text(rng, token):
    words = [rng.choice(FILLER) for _ in range(rng.randint(5, 40))]
    at = rng.randrange(len(words) + 1)
    before = " ".join(words[:at])
    return before + " " * bool(before) + token + " " + " ".join(words[at:]), len(before) + bool(before)


def test_pii_finds_planted_disguises():
    """Recall and false alarms of the method's own spans, on identifiers disguised in ways that its rules are about."""
    import random

    rng = random.Random(12)
    name = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 8)))
    spelled = [[w for w, d in pii.SPELLED.items() if d == k] for k in range(10)]
    hit = exact = 0
    for k in range(600):
        kind, address = "email", (f"{name()}.{name()}", f"{name()}", rng.choice(["com", "org", "de", "es"]))
        form = k % 8
        if form == 0:
            token = f"{address[0]} (at) {address[1]}.{address[2]}"
        elif form == 1:
            token = f"{address[0]}[at]{address[1]}[dot]{address[2]}"
        elif form == 2:
            token = f"{address[0]} at {address[1]} dot {address[2]}"
        elif form == 3:
            token = f"{address[0]}@{address[1]}.{address[2]}".replace("a", "а").replace("o", "о").replace("e", "е").replace("@", "＠")
        elif form == 4:
            token = f"{address[0]} arroba {address[1]} punto {address[2]}"
        elif form == 5:
            token = f"{address[0]}&#64;{address[1]}.{address[2]}"
        elif form == 6:
            kind, token = "phone", "plus " + " ".join(rng.choice(spelled[rng.randrange(1, 10)]) for _ in range(11))
        else:
            kind, token = "ip", ".".join(str(rng.randrange(1, 256)) for _ in range(4)).replace(".", "․")
        text, at = in_text(rng, token)
        found = [x for x in pii.find(text)[1] if x[0] == kind]
        hit += any(a < at + len(token) and at < b for _, a, b in found)
        exact += (kind, at, at + len(token)) in found
    assert hit >= 0.95 * 600 and exact >= 0.9 * 600
    assert not any(pii.find(in_text(rng, rng.choice(["meet at noon.", "look at example", "one two many", "dot your i", "a plus b", "at 7 (at most)"]))[0])[1] for _ in range(400))


def test_pii_finds_nothing_more_in_plain_documents(spark, sf):
    """False alarms of the method's own spans over documents without disguises."""
    docs = [t for _, t in rows(spark.read.parquet(f"{sf}/documents.parquet"))]
    assert sum(bool(pii.find(t or "")[1]) for t in docs) <= 0.002 * len(docs)
    assert sum(bool(secrets.find(t or "")[1]) for t in docs) <= 0.002 * len(docs)


@pytest.mark.parametrize("own", [False, True])
def test_secrets_finds_planted_tokens(spark, sf, own):
    """Recall and false alarms of the chains, on random strings and ordinary names in text; with the corpus's strings and without."""
    import random

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = secrets.labelled(docs, 500) if own else []
    assert all(sum(y == k for _, y in more) <= 500 for k in (0, 1)) and (not own or {y for _, y in more} == {0, 1})
    model = secrets.train(more=more)
    if own:
        assert sum(bool(secrets.find(t or "", model)[1]) for _, t in rows(docs)) <= 2
        assert secrets.labelled(docs.limit(0)) == []
    rng = random.Random(13)
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    exact = 0
    for _ in range(600):
        token = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(22, 44)))
        text, at = in_text(rng, token)
        exact += ("random", at, at + len(token)) in secrets.find(text, model)[1]
    assert exact >= 0.95 * 600
    words = [w for w in secrets.WORDS.split() if w.isascii() and len(w) > 4]
    forms = (lambda own: "_".join(own), lambda own: "".join(x.title() for x in own), lambda own: "/".join(own), lambda own: "-".join(own) + "-2024", lambda own: "_".join(own).upper())
    alarms = sum(bool(secrets.find(in_text(rng, rng.choice(forms)(rng.sample(words, rng.randint(3, 6))))[0], model)[1]) for _ in range(1000))
    assert alarms <= 10


def test_finds_are_looked_up_in_sorted_spans():
    """Twenty thousand base spans and as many finds of the method take well under a second or two."""
    import time

    began = time.process_time()
    base, more = pii.find("a@b.co 10.0.0.1 x (at) y.com " * 20_000)
    assert len(base) == 40_000 and len(more) == 20_000
    base, more = secrets.find("password=abcdefgh Zx8Qp2Lm9Rt4Wv7Yb3Nc " * 20_000)
    assert len(base) == len(more) == 20_000 and time.process_time() - began < 10


def test_cover():
    cover = spans.Cover([(5, 8), (1, 3), (2, 4), (8, 9)])
    assert [(a, b) for a in range(10) for b in range(a + 1, 11) if cover.touches(a, b) != any(a < y and x < b for x, y in ((1, 4), (5, 9)))] == []
    assert cover.holds(1, 4) and cover.holds(5, 9) and not cover.holds(3, 6) and cover.edges(2, 6) and not cover.edges(0, 9)


def test_packing(docs):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORD_BPE)  # as it is
    out = packing.pack_documents(docs.select("doc_id", "text"), queries.WORD_BPE)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    wanted = []
    for i, t in rows(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            wanted.append((i, p, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())))
    same(out.select("doc_id", "piece", "start", "length", "ids_crc32"), wanted)
    held = defaultdict(list)
    for r in out.collect():
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(x[3] for x in wanted) // 4096)
    assert len(held) <= 1.05 * least + 1


def test_plan_takes_any_counts():
    import random

    random.seed(5)
    for _ in range(200):
        cap = random.choice([10, 20, 50, 4096])
        counts = {random.randint(1, cap): random.randint(1, 40) for _ in range(random.randint(1, min(cap, 40)))}
        plan = packing.Plan(counts, cap)
        held, ranks = Counter(), defaultdict(set)
        for length, rank, n, per, first, offset in plan.runs:
            for q in range(n):
                held[first + q // per] += length
                ranks[length].add(rank + q)
                assert offset + (q % per + 1) * length <= cap
        assert {k: set(range(n)) for k, n in counts.items()} == ranks and max(held.values()) <= cap and len(held) == plan.sequences


def least_sequences(lengths, cap):
    """The fewest sequences that hold the lengths, by trying them all."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= lengths[k]}):
            left = list(rooms)
            left.remove(r)
            place(k + 1, [*left, r - lengths[k]])
        place(k + 1, [*rooms, cap - lengths[k]])

    place(0, [])
    return best


def test_plan_against_the_best_there_is():
    """The reduction never costs a sequence, and best fit after it seldom does."""
    import random

    random.seed(11)
    over = 0
    for _ in range(250):
        cap = random.choice([10, 17, 30])
        lengths = sorted((random.randint(1, cap) for _ in range(random.randint(1, 9))), reverse=True)
        plan = packing.Plan(Counter(lengths), cap)
        best = least_sequences(lengths, cap)
        fixed = Counter()
        for length, _, n, per, first, _ in plan.runs:
            for q in range(n):
                fixed[length] += first + q // per < plan.fixed
        rest = sorted((Counter(lengths) - fixed).elements(), reverse=True)
        assert plan.fixed + least_sequences(rest, cap) == best, (lengths, cap)
        assert plan.sequences <= best + 1
        over += plan.sequences > best
    assert over <= 5


def test_packing_spreads_rows_that_are_alike(spark):
    """Rows without an id and with one text have ranks of their own, from many buckets."""
    packing_bucket = packing.BUCKET
    try:
        packing.BUCKET = 50
        out = packing.pack_documents(documents(spark, [(None, "same words")] * 1000), queries.WORD_BPE).collect()
    finally:
        packing.BUCKET = packing_bucket
    assert len(out) == len({(r["sequence_id"], r["offset"]) for r in out}) == 1000


def test_reduction_fixes_perfect_pairs():
    plan = packing.Plan({7: 5, 3: 5, 6: 1, 2: 2}, 10)
    assert plan.sequences == 6 and plan.fixed >= 5


CL100K = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""
P50K = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, CL100K, P50K, r"[\p{L}_]+|\s|[^\s]", r"\p{Lu}+|\P{L}|."])
def test_splitter_takes_any_pattern(pattern):
    """As the library for public patterns, properties inside classes among them, on random texts, plain and odd."""
    import random

    import regex

    rng, find = random.Random(5), bpe.splitter(pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    odd = "aZéß漢9٣ \n\t_-'.🙂ſ"
    for k in range(10_000):
        text = "".join(rng.choices("abcXYZ 0123\n  '_-.,!?" if k % 2 else odd, k=rng.randrange(25)))
        assert find(text) == regex.findall(pattern, text), text
        if k % 10 == 0:
            assert "".join(find(text)) == bytes(own.encode_ordinary(text)).decode(), text
    assert find("Hello, wor-ld 12345 it's (fine)") == regex.findall(pattern, "Hello, wor-ld 12345 it's (fine)")


def test_bpe(docs):
    ranks = bpe.ranks(queries.BYTE_BPE)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    wanted = []
    for i, t in rows(docs):
        ids = theirs.encode_ordinary(t or "")
        wanted.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    same(bpe.roundtrip(docs, queries.BYTE_BPE, public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256")), wanted)
    out = bpe.roundtrip(docs, queries.BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert all(bpe.decode(r["ids"], queries.BYTE_BPE) == bytes(r["decoded"]) for r in out[:50])


@pytest.mark.parametrize("text", ["a" * 5000, "abc" * 3000, "ჿ0 \U0001fae9 ꟜᲉ x", "ß'll've", "   \n\n  x  "])
def test_bpe_as_the_library(text):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(queries.BYTE_BPE).rank, special_tokens={})
    assert bpe.encode(text, queries.BYTE_BPE, public_tokenizers.PATTERN) == theirs.encode_ordinary(text)


def plain_repeats(pairs, window=20):
    first = {}
    words = [(-(1 << 63) if i is None else i, i, WORD.findall(t or "")) for i, t in pairs]
    for key, _, w in words:
        for s in range(len(w) - window + 1):
            own = tuple(w[s : s + window])
            first[own] = min(first.get(own, (key, s)), (key, s))
    for key, i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (key, s):
                gone |= set(range(s, s + window))
        yield i, w, gone


@pytest.mark.parametrize("small", [False, True])
def test_repeats(docs, small, monkeypatch):
    if small:
        monkeypatch.setattr(repeats, "CHUNK", 100_000)
        monkeypatch.setattr(repeats, "BUCKET", 200_000)
    wanted = [(i, len(w), len(gone), sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()) for i, w, gone in plain_repeats(rows(docs))]
    same(repeats.dedup(docs, ("n_words", "n_removed", "kept_sha256")), wanted)


def test_repeats_keep_columns(spark):
    df = documents(spark)
    out = repeats.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert {r["spans"] for r in out.collect()} == {"clash"}


def plain_quality(t):
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    seen = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            seen |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(seen)


def test_quality(docs):
    out = quality.judge(docs)
    wanted = []
    for i, t in rows(docs):
        n, chars, symbols, dup, rep = plain_quality(t or "")
        wanted.append((i, n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n))
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), wanted)
    assert not out.filter("base_failed and kept").count() and out.columns == ["doc_id", *quality.REPORTED, "base_failed", "kept"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in quality.keep(docs).select("doc_id", "text").collect()) == sorted((i or 0, t) for i, t in rows(docs.join(out.filter("kept").select("doc_id").distinct(), docs["doc_id"].eqNullSafe(out["doc_id"]), "left_semi")))


def test_quality_keeps_what_is_labelled_good(spark, sf):
    labelled = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    good, bad = (labelled.filter(f"quality = {q}") for q in (1, 0))
    assert good.filter("kept").count() >= 0.99 * good.count() and bad.filter("not kept").count() >= 0.95 * bad.count()


def plain_fingerprint(t):
    w = [m.encode() for m in WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t))]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(pairs):
    fps = defaultdict(list)
    for i, t in pairs:
        fps[plain_fingerprint(t or "")].append(i)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    own = list(fps)
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for f, ids in fps.items():
        least[find(f)] += [i for i in ids if i is not None]
    return [(i, f"{f:016x}", min(least[find(f)], default=None)) for f, ids in fps.items() for i in ids]


def digest(df):
    from pyspark.sql import functions as F

    return simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def test_simhash(docs):
    same(digest(docs), plain_components(rows(docs)))


def test_simhash_large_groups(spark, monkeypatch):
    """Many near copies in one key, through every way of walking a group."""
    import numpy as np

    rng = np.random.default_rng(4)
    start = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([start, *((f ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for f in start)]))

    def groups(pairs):
        root = {int(f): int(f) for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in pairs:
            root[find(int(a))] = find(int(b))
        return Counter(Counter(find(int(f)) for f in fps).values())

    every = groups((a, b) for k, a in enumerate(fps) for b in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ a) <= 3])
    assert groups((a, b) for x, y in simhash.forest(fps) for a, b in zip(x, y, strict=True)) == every
    monkeypatch.setattr(simhash, "WALK", 50)
    assert groups((a, b) for x, y in simhash.forest(fps) for a, b in zip(x, y, strict=True)) == every
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    linked = simhash.links(df).collect()
    assert groups((np.int64(a).view(np.uint64), np.int64(b).view(np.uint64)) for a, b in linked) == every
    roots = Counter(r["root"] for r in simhash.components(simhash.links(df)).collect())
    assert Counter(roots.values()) + Counter({1: every[1]}) == every


def test_golay_keys_meet():
    import numpy as np

    rng = np.random.default_rng(6)
    f = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    g = f.copy()
    for i in range(len(g)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            g[i] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for x in (f, g):
        own = [set() for _ in x]
        for r, k in zip(*simhash.keys(x), strict=True):
            own[r].add(int(k))
        sets.append(own)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_keep_first(docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    wanted = {(i, c) for i, _, c in plain_components(rows(docs)) if i == c}
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.collect()) == sorted((i is not None, i) for i, _ in wanted)


def test_keep_first_by_component(spark):
    """Null ids, and ids that several texts share: one row of each component stays, whatever other rows have its id."""
    text = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(12)]
    made = [(None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (1, text[3]), (1, text[4]), (2, text[3]), (None, text[3]), (1, text[5]), (3, text[6]), (3, text[6]), (3, text[7]), (0, text[7]), (4, text[8]), (None, text[8])]
    assert len({c for _, c, _ in plain_components([(k, t) for k, t in enumerate(text)])}) == len(text)
    got = simhash.keep_first(documents(spark, made))
    assert got.columns == documents(spark).columns
    assert Counter(rows(got)) == Counter([(None, text[0]), (None, text[1]), (None, text[2]), (1, text[3]), (1, text[4]), (1, text[5]), (3, text[6]), (0, text[7]), (4, text[8])])


def test_repeats_send_a_window_once(monkeypatch):
    """A text with 10,000 copies in each of many chunks is one entry of a chunk for each of its windows."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "CHUNK", 1)
    words = [f"w{k}" for k in range(25)]
    text = " ".join(words).encode()
    chunks = [pa.table({"_id": pa.array(range(n * 10_000, (n + 1) * 10_000), pa.int64()), "_text": pa.array([text] * 10_000, pa.binary()), "_chunk": pa.array([n] * 10_000, pa.int64())}) for n in range(10)]
    probes = [repeats._probe(40, 0, 20, 10)(c) for c in chunks]
    assert all(len(repeats.unpacked(x, "u1")[0]) == 16 for t in probes for x in t.column("_blob").to_pylist())
    anchors = repeats._anchors(pa.concat_tables(probes))
    reply = lambda t, n: t.filter(pa.compute.equal(t.column("_chunk"), n))
    windows = [repeats._extend(40, 0, 20, 10)(c, reply(anchors, n)) for n, c in enumerate(chunks)]
    assert all(len(repeats.unpacked(x, "<u4", "<u4")[0]) == 6 for t in windows for x in t.column("_blob").to_pylist())
    later = repeats._first(pa.concat_tables(windows))
    out = [repeats._remove(("n_removed",), ["_id"], 20)(c, reply(later, n)).to_pylist() for n, c in enumerate(chunks)]
    assert [r["n_removed"] for t in out for r in t] == [0] + [25] * 99_999


def test_repeats_take_any_names(spark):
    from pyspark.sql import functions as F

    df = documents(spark).select("doc_id", "text", *(F.lit(k).alias(n) for k, n in enumerate(("_gone", "_left", "gone", "c0", "_id", "_text", "_chunk", "a.b", "n_chars"))))
    out = repeats.without_repeats(df)
    assert out.columns == df.columns
    left = {r["doc_id"]: (r["text"], r["n_chars"], r["_gone"], r["a.b"]) for r in out.collect()}
    assert left[5] == ("", 0, 0, 7) and left[1] == (None, 8, 0, 7) and left[3][0] == " \n\t "


def test_cascade_order_follows_costs_and_rejections(spark):
    """Planted costs: of rules that reject alike the cheap one goes first, one that rejects nothing and costs much last; and
    one whose rejections another has taken already falls behind one that adds some."""
    from pyspark.sql import functions as F

    work = lambda s, n: F.aggregate(F.sequence(F.lit(0), s["n_words"] * 0 + n), F.lit(0).cast("long"), lambda a, x: a + x % 7)
    dear = quality.Rule("dear", lambda s: (work(s, 4000) >= 0) & (s["n_words"] < 500))
    cheap = quality.Rule("cheap", lambda s: s["n_words"] < 500)
    useless = quality.Rule("useless", lambda s: work(s, 4000) < 0)
    other = quality.Rule("other", lambda s: (work(s, 400) >= 0) & (s["n_words"] > 900))
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 1000 + 1).cast("int")).alias("text"))
    df = df.union(df.select(F.col("doc_id") + 1000, F.repeat(F.lit("x "), 950)))
    for rules in ((dear, useless, other, cheap), (cheap, dear, other, useless)):
        names = [r.name for r in quality.ordered(df, rules)]
        assert names[:2] == ["cheap", "other"] and names.index("dear") >= 2


def test_cascade_order_is_the_same_every_time(spark, sf):
    """Costs are least times by row, and near gains are ties, so that runs agree; base rules have gone before."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    orders = {tuple(r.name for r in quality.ordered(docs)) for _ in range(10)}
    assert len(orders) == 1
    assert next(iter(orders)).index("few words") < next(iter(orders)).index("repeated windows")


def test_cascade_order_of_rows_that_are_alike(spark):
    """Rows that are all alike have one hash, and are a sample nonetheless; base rules' rejections are no gain to others."""
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("one two three").alias("text"))
    assert quality.sampled(df).count() >= 100
    never, always = quality.Rule("never", lambda s: s["n_words"] > 9), quality.Rule("always", lambda s: s["n_words"] < 9)
    assert [r.name for r in quality.ordered(df, (never, always))] == ["always", "never"]
    assert [r.name for r in quality.ordered(df, (never, always), given=always)] == ["never", "always"]


def test_cascade_skips_what_a_rule_has_rejected(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(1, "good text"), (2, "bad text")])
    first = quality.Rule("first", lambda s: s["n_words"] < 3)
    fails = quality.Rule("fails", lambda s: F.raise_error("looked at").cast("boolean"))
    stats = quality.statistics(F.col("text"))
    assert [r[0] for r in docs.select(quality.cascade([first, fails], stats)).collect()] == [False, False]
    with pytest.raises(Exception, match="looked at"):
        docs.select(quality.cascade([fails, first], stats)).collect()
