import random

import numpy as np

from sievelake.llm import near_dedup

WORDS = [f"w{i}" for i in range(400)]


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def test_classes_equal_brute_force(spark):
    r = random.Random(4)
    docs = [" ".join(r.choices(WORDS, k=r.randint(30, 150))) for _ in range(60)]
    passage = " ".join(r.choices(WORDS, k=60))
    docs += [passage + " " + " ".join(r.choices(WORDS, k=90)) for _ in range(40)]
    docs += [edited(r, r.choice(docs), r.randint(1, 4)) for _ in range(80)]
    docs += [docs[0]] * 5
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == brute_force(docs)
    assert 20 < len(set(got.values())) < len(docs) - 40


def sequence(text):
    """Five-word shingles with their occurrence numbers."""
    w = text.split()
    out, seen = [], {}
    for i in range(max(1, len(w) - 4)):
        g = tuple(w[i : i + 5])
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out


def aligned(a, b):
    """The longest common subsequence, whose elements occur once in each, by dynamic programming over the common elements."""
    place = {g: k for k, g in enumerate(b)}
    at = [place[g] for g in a if g in place]
    best = []
    for k, p in enumerate(at):
        best.append(1 + max((best[m] for m in range(k) if at[m] < p), default=0))
    return max(best, default=0)


def brute_force(docs):
    seqs = [sequence(d) for d in docs]
    sets = [set(x) for x in seqs]
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if root(i) != root(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (n := aligned(seqs[i], seqs[j])) >= 0.8 * (len(seqs[i]) + len(seqs[j]) - n):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: root(i) for i in range(len(docs))}


def test_template_family_equals_brute_force(spark):
    r = random.Random(8)
    base = r.choices(WORDS, k=90)
    docs = []
    for n in range(500):
        w = list(base)
        for k in r.sample(range(90), 2):
            w[k] = f"x{n}y{k}"
        docs.append(" ".join(w))
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == brute_force(docs)


def test_blocks_leave_out_only_what_the_bound_excludes(spark):
    r = random.Random(9)
    docs = [" ".join(r.choices(WORDS, k=r.randint(40, 60))) for _ in range(8)]
    docs += [edited(r, r.choice(docs), r.randint(1, 3)) for _ in range(60)]
    x = [near_dedup.labelled(near_dedup.shingles(d.encode())) for d in docs]
    texts = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(x)], "node long, s binary")
    shared = spark.createDataFrame([(i, k) for i in range(len(docs)) for k in (1, 2)], "node long, key long")
    labels = spark.createDataFrame([(i, i % 5) for i in range(len(docs))], "node long, label long")
    want = {(i, j) for j in range(len(docs)) for i in range(j) if i % 5 != j % 5 and near_dedup.alike(x[i], x[j])}
    for block in (1024, 10):
        got = {(p["a"], p["b"]) for p in near_dedup.open_pairs(shared, labels, texts, 0.8, block).collect()}
        assert want <= got and len(got) < len(docs) ** 2 / 4 and all(i < j and i % 5 != j % 5 for i, j in got)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "..."), (5, "two words"), (6, "Two words!"), (7, "long " * 30000), (8, "long " * 30000 + "x"), (9, "alone in the world of all texts"), (9, "alone in the world of all texts"), (None, "no id at all")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, class_id int")
    got = near_dedup.near_duplicates(df)
    rows = [(x["doc_id"], x["class_id"], x["class_size"]) for x in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 2), (6, 5, 2), (7, 7, 2), (8, 7, 2), (9, 9, 2), (9, 9, 2), (None, None, 1)]))
    kept = near_dedup.first_of_classes(df, got)
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["1", "3", "5", "7", "9", "None"] and kept.columns == df.columns
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment_is_banded_and_ordered():
    x = np.arange(1000, dtype=np.uint64)
    assert near_dedup.alike(x, x[50:]) and not near_dedup.alike(x, x[300:])
    many = near_dedup.labelled(np.repeat(x[:10], 100))
    assert len(np.unique(many)) == 1000
    assert near_dedup.alike(many, near_dedup.labelled(np.repeat(x[:10], 100)[:950]))
    assert not near_dedup.alike(x, np.concatenate((x[500:], x[:500])))  # halves swapped
    assert not near_dedup.alike(x, x.reshape(10, 100)[::-1].ravel())  # blocks reversed
    moved = np.concatenate((x[:10], x[60:110], x[10:60], x[110:]))
    assert near_dedup.alike(x, moved) and not near_dedup.alike(x, moved, 0.96)


def test_sketches_do_not_depend_on_chunks():
    x = np.random.default_rng(2).integers(1, 1 << 60, 500, dtype=np.uint64)
    assert near_dedup.sketch(x, chunk=7).tolist() == near_dedup.sketch(x).tolist() and len(set(near_dedup.sketch(x).tolist())) == near_dedup.SKETCHES
    assert near_dedup.sketch(x[:1]).shape == (near_dedup.SKETCHES,)
    back = near_dedup.sketch(x[::-1].copy())
    assert not set(back.tolist()) & set(near_dedup.sketch(x).tolist())  # the order counts


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(50), r.randrange(50)) for _ in range(30)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {x["node"]: x["label"] for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    assert got == parent
