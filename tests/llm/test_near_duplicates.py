import collections
import re

import xxhash
from clicklake.llm import line_dedup, simhash
from clicklake.llm.common import Scratch, connected_components
from pyspark.sql import functions as F


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=2):
    u = Union()
    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        u.find(a)
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                u.join(a, b)
    return u


def test_components_of_graphs(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (None, 3), (300, 299)], "a long, b long")
    got = dict(map(tuple, connected_components(spark, Scratch(spark, "t"), edges).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert connected_components(spark, Scratch(spark, "t"), edges.limit(0)).count() == 0


def test_simhash_documents(spark, documents):
    texts = dict(documents.select("doc_id", "text").collect())
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    u, least = brute_components(fps.values()), {}
    for d, f in sorted(fps.items()):
        least.setdefault(u.find(f), d)
    rows = simhash.query(spark, "/root/testdata/sf0.001").collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(d, f"{f:016x}", least[u.find(f)]) for d, f in fps.items()}


def test_links_of_hot_segments(spark, monkeypatch):
    """With a bound of two, nearly all goes through the masked variants; the components stay exact."""
    import random

    random.seed(5)
    base = [random.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << p for p in random.sample(range(64), random.randrange(5))) for b in base for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bound in (2, 10_000):
        monkeypatch.setattr(simhash, "DIRECT", bound)
        u = Union()
        for a, b in simhash.links(spark, Scratch(spark, "t"), df).collect():
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
            u.join(a, b)
        want = brute_components(fps)
        groups = lambda uf, xs: {frozenset(g) for g in _groups(uf, xs)}
        assert groups(u, signed) == {frozenset(x - (1 << 64) if x >> 63 else x for x in g) for g in _groups(want, fps)}


def _groups(u, xs):
    out = collections.defaultdict(set)
    for x in xs:
        out[u.find(x)].add(x)
    return out.values()


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(spark, odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {2}
    assert simhash.near_duplicates(spark, empty).count() == 0
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 5, 6, 7]
    assert simhash.keep_one(spark, empty).count() == 0


def near_copy_texts(n=60):
    """Texts of many lengths, each with an edited copy; some groups of equal texts."""
    import random

    draw, out = random.Random(9), []
    vocabulary = [f"word{i}" for i in range(3000)]
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([4, 8, 30, 120, 400, 1500]))]
        out.append(" ".join(words))
        for rate in (0.0, 0.004, 0.01, 0.02, 0.03):
            edited = [draw.choice(vocabulary) if draw.random() < rate else w for w in words]
            out.append(" ".join(edited))
    return out


def test_near_copies_equal_brute_force_jaccard(spark):
    """Links at a similarity of 0.8 or more, against all pairs: nearly all are found, and no others."""
    texts = near_copy_texts()
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    want = [(i, j) for i in range(len(texts)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    u, every = Union(), [(i, t) for i, t in enumerate(texts)]
    for i, j in want:
        u.join(i, j)
    docs = spark.createDataFrame(every, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(spark, docs).collect()}
    least = {min(g) for g in _groups(u, range(len(texts)))}
    for i in range(len(texts)):
        u.find(i)
    least = {min(g) for g in _groups(u, range(len(texts)))}
    assert least <= kept, "a text without a similar one went"
    assert len(kept - least) <= 0.05 * (len(texts) - len(least))


def test_near_copies_in_large_buckets(spark, monkeypatch):
    """One large group of near copies and of copies: stars and blocks keep one of it."""
    import random

    monkeypatch.setattr(simhash, "PAIRWISE", 8)
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 16)
    draw, base = random.Random(3), [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = base[:]
        if i % 3:
            words[draw.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, f"another text {i} of its own words a{i} b{i} c{i}") for i in range(20)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, *range(1000, 1020)}


def brute_lines(docs):
    """Kept text by position in `docs`, the first line of each component staying."""
    norm = lambda line: re.sub(r"\s+", " ", line.lower()).strip(" ")
    sets, u = {}, Union()
    for _, text in docs:
        for line in (text or "").split("\n"):
            if n := norm(line):
                sets[n] = {n[i : i + 8] for i in range(max(1, len(n) - 7))}
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                u.join(a, b)
    seen, out = set(), [None] * len(docs)
    for i in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i)):
        kept = []
        for line in (docs[i][1] or "").split("\n"):
            n = norm(line)
            if not n or u.find(n) not in seen:
                kept.append(line)
            if n:
                seen.add(u.find(n))
        out[i] = None if docs[i][1] is None else "\n".join(kept)
    return out


def test_lines_of_documents(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    rows = {r["doc_id"]: r for r in line_dedup.query(spark, "/root/testdata/sf0.001").collect()}
    assert [rows[d]["text"] for d, _ in docs] == brute_lines(docs)
    assert all(r["n_lines"] >= r["n_removed"] for r in rows.values())


def test_lines_of_large_buckets(spark, monkeypatch):
    """Near copies of one line, more than are compared pair by pair: stars and blocks give the same components."""
    import random

    monkeypatch.setattr(line_dedup, "DIRECT", 8)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 16)
    random.seed(2)
    base = [f"word{i}" for i in range(30)]
    docs = []
    for i in range(80):
        words = base[:]
        for _ in range(random.randrange(4)):
            words[random.randrange(30)] = f"w{random.randrange(1000)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark, df).collect()}
    want = brute_lines(docs)
    # Banding finds a pair with a chance of over 0.999; groups this dense come out whole.
    assert sum(got[i] != want[i] for i in range(80)) <= 1


def test_lines_odd_rows(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = line_dedup.dedup_lines(spark, odd)
    assert out.columns == odd.columns
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)
    assert got == sorted(((d, t) for (d, _), t in zip(docs, brute_lines(docs))), key=key)
    assert line_dedup.dedup_lines(spark, empty, counts=True).count() == 0
    plain = spark.createDataFrame([(1, "a\na")], "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.dedup_lines(spark, plain, counts=True).select("text", "n_lines", "n_removed").collect()] == [("a", 2, 1)]
    assert out.filter(F.col("text").isNull()).count() == 2
