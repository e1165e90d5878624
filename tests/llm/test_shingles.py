"""The pipeline's near-dedup stage against brute force over all pairs."""

import numpy as np

from docweave.llm import shingles


def test_near_dedup_keeps_one_of_each_similarity_group(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(7)
    texts = ["", None, "one two", "One  two", "the very common line " * 20]
    for n in (40, 60, 200, 900):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts.append(" ".join(words))
            for changed in (1, 2, n // 90 + 1, n // 40 + 1, n // 20 + 1):
                other = list(words)
                for at in rng.integers(0, n, changed):
                    other[at] = f"x{rng.integers(0, 10**9)}"
                texts.append(" ".join(other))
    for i in range(200):  # a large group of near copies
        texts.append(" ".join(f"g{k}" if k != i else "odd" for k in range(300)))

    def brute(text):
        found = (text or "").lower().split()
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    sets = [brute(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and (len(a & sets[j]) / len(a | sets[j]) if a or sets[j] else 1.0) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.near_dedup(spark, df, "").collect()} == set(root)
    assert len(set(root)) < len(texts) - 220
    own = df.select("doc_id", "text")
    for block in (5, 40):  # groups in many blocks: the same classes
        assert {r.doc_id: r.component_id for r in shingles.near_copies(own, id_col="doc_id", block=block).collect()} == dict(enumerate(root))
    assert p.near_dedup(spark, df.limit(0), "").count() == 0


def test_links_of_a_group_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(120)]
    sets += [np.unique(np.concatenate([s[:-2], rng.integers(100, 200, 2).astype(np.uint64)])) for s in sets[:60]]
    root, got = list(range(len(sets))), list(range(len(sets)))
    for r, pairs in ((root, [(i, j) for i in range(len(sets)) for j in range(i) if shingles.similarity(sets[i], sets[j]) >= 0.8]), (got, shingles.linked(sets))):
        for i, j in pairs:
            old, new = max(r[i], r[j]), min(r[i], r[j])
            r[:] = [new if x == old else x for x in r]
    assert root == got


def bits_apart(a, b):
    return (int.from_bytes(shingles.fingerprint(a), "little") ^ int.from_bytes(shingles.fingerprint(b), "little")).bit_count()


def test_fingerprint_counts_bits_of_mixed_hashes():
    def mixed(h, k):
        m = (1 << 64) - 1
        x = (h + k * 0x9E3779B97F4A7C15) & m
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        return x ^ x >> 31

    for text in (None, "one two", "a b c d e f g h", " ".join(f"w{i}" for i in range(shingles.SLICE * 2 + 9))):
        hashes = [int(h) for h in shingles.shingles(text)]
        words = [sum(1 << b for b in range(64) if 2 * sum(mixed(h, k) >> b & 1 for h in hashes) > len(hashes)) for k in range(1, 5)]
        assert shingles.fingerprint(shingles.shingles(text)) == b"".join(w.to_bytes(8, "little") for w in words)


def test_radius_reaches_the_similarity():
    """Pairs of similarity 0.8 or a little more are within the radius, whatever their sizes; sets without a common shingle aren't."""
    rng = np.random.default_rng(5)
    far = []
    for both, a, b in ((4, 1, 0), (8, 1, 1), (12, 3, 0), (12, 1, 2), (40, 5, 5), (400, 50, 50), (400, 100, 0)):
        for _ in range(400 if both < 100 else 60):
            h = rng.integers(0, 1 << 63, both + a + b, dtype=np.uint64) * np.uint64(2)
            x, y = np.sort(h[: both + a]), np.sort(np.concatenate([h[:both], h[both + a :]]))
            assert shingles.similarity(x, y) >= 0.8 and bits_apart(x, y) <= shingles.RADIUS
            far.append(bits_apart(x, rng.integers(0, 1 << 63, both, dtype=np.uint64)))
    assert min(far) > shingles.RADIUS


def test_links_come_from_trees_of_fingerprints(spark):
    """What the trees don't find isn't linked: at any radius the links are those of fingerprints within it that pass the exact check."""
    rng = np.random.default_rng(11)
    texts = []
    for n in (30, 80, 300):
        for _ in range(5):
            words = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts.append(" ".join(words))
            for k in (1, n // 60 + 1, n // 30 + 1):
                other = list(words)
                other[n // 3 : n // 3 + k] = [f"x{rng.integers(0, 10**9)}" for _ in range(k)]
                texts.append(" ".join(other))
    for i in range(40):  # a group for many shards
        texts.append(" ".join(f"g{k}" if k // 4 != i else "odd" for k in range(160)))
    sets = [shingles.shingles(t) for t in texts]
    apart = {(i, j): bits_apart(sets[i], sets[j]) for i in range(len(sets)) for j in range(i) if shingles.similarity(sets[i], sets[j]) >= 0.8}
    near = sorted(apart.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = set()
    for radius in (-1, near[len(near) // 8], near[len(near) // 2], shingles.RADIUS):
        root, got = list(range(len(sets))), list(range(len(sets)))
        for r, pairs in ((root, [p for p, d in apart.items() if d <= radius]), (got, shingles.linked(sets, radius=radius))):
            for i, j in pairs:
                old, new = max(r[i], r[j]), min(r[i], r[j])
                r[:] = [new if x == old else x for x in r]
        assert got == root
        groups.add(len(set(root)))
        if radius in (-1, near[len(near) // 2]):
            assert {r.doc_id: r.component_id for r in shingles.near_copies(df, id_col="doc_id", block=7, radius=radius).collect()} == dict(enumerate(root))
    assert len(groups) >= 3
