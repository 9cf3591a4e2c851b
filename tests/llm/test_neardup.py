import random
import re

import pyarrow as pa
import pytest

from shelfwise.llm import neardup
from shelfwise.llm.components import connected_components
from shelfwise.llm.shared import work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def groups(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def brute(rows, share=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[:k] if x and y and 100 * len(x & y) >= share * len(x | y)]
    return groups({i for i, _ in sets}, links)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    shared = " ".join(rng.choices(words, k=60))
    for _ in range(n):
        base = rng.choices(words, k=rng.randrange(1, 400))
        for _ in range(rng.choice([1, 1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy)
            texts.append(rng.choice([text, text, text.upper(), text.replace(" ", "\n\t", 3), f"{shared} {text}"]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = list(enumerate(corpus(seed, 120)))
    base = "of one text there are many copies that differ a little in some places but not in most of them " * 3
    rng = random.Random(seed)
    for i in range(150):  # a crowded region
        words = [w + str(k) for k, w in enumerate((base * 4).split())]
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = str(rng.random())
        rows.append((2000 + i, " ".join(words)))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "a b c"), (3004, "A b\tc"), (3005, "a b c d e"), (3006, "a b c d e"), (3007, "long " * 40_000)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, component_id string, n int")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t)) and got[i].kept == (want[i] == i) for i, t in rows)


def template_corpus(pairs, seed=3):
    """Texts on one template, 0.8 alike, in pairs that are 0.9 alike; and the smaller id of each text's pair."""
    rng = random.Random(seed)
    template, ids = [f"t{i}" for i in range(404)], list(range(2 * pairs))
    rng.shuffle(ids)
    rows, want = [], {}
    for k in range(pairs):
        twins = ids[2 * k : 2 * k + 2]
        for j, i in enumerate(twins):
            rows.append((i, " ".join(template + [f"p{k}x{m}" for m in range(25)] + [f"d{k}y{j}x{m}" for m in range(25)])))
            want[i] = min(twins)
    return rows, want


def test_all_links_of_a_crowded_region(spark):
    rows, want = template_corpus(400)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_a_large_component_hides_no_link(spark):
    template = [f"t{i}" for i in range(404)]
    near = [template + [f"d{k}x{m}" for m in range(30)] for k in range(600)]  # 0.87 alike
    rows = [(2 * k, " ".join(x)) for k, x in enumerate(near)]
    rows += [(2 * k + 1, " ".join(x + [f"e{k}x{m}" for m in range(20)])) for k, x in enumerate(near[:60])]  # 0.96 to one only
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def forest_rows(rng, n):
    """Rows of one tree: labels of few values, a large component, and many small ones."""
    rows = []
    for i in range(n):
        label = b"".join(int(rng.random() < 0.3).to_bytes(4, "big") for _ in range(neardup.DEPTH))
        rows.append((0, i, 100, 0 if rng.random() < 0.97 else i, label, bytes(128)))
    return rows


def test_candidates_do_not_depend_on_partitions(spark):
    rows = forest_rows(random.Random(1), 3000)
    df = spark.createDataFrame(rows, "tree int, doc_id long, n long, of long, label binary, sketch binary")
    found = {}
    for parts in ("1", "4", "8", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found[parts] = {(r.a, r.b) for r in neardup.candidate_pairs(df, 85, f"{work_dir(spark)}/x", False)[0].collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found["1"] == found["4"] == found["8"] == found["64"] and len(found["1"]) > 3000
    order = sorted(rows, key=lambda r: (r[4], r[1]))
    want = set()
    for i, row in enumerate(order):  # by the definition, however far the others are
        others = [r for r in order[:i] if r[3] != row[3] and r[4][:4] == row[4][:4]]
        for depth in range(1, neardup.DEPTH + 1):
            near = [r for r in others if r[4][: 4 * depth] == row[4][: 4 * depth]]
            if len(near) <= neardup.LOOK_BACK:
                break
        want |= {(max(row[1], r[1]), min(row[1], r[1])) for r in near[-neardup.LOOK_BACK :]}
    assert found["1"] == want


def test_blocks_count_exactly():
    import numpy as np

    rng = random.Random(5)
    docs = []
    for i in range(60):
        x = np.array(sorted(rng.sample(range(9000), 6000) if i % 3 else docs[-1][2].tolist()[: rng.randrange(4900, 6000)]) if i else range(0, 9000, 2), np.uint64)
        docs.append((i, i, x))
    want = {(a[0], b[0]) for a in docs for b in docs if b[0] < a[0] and 100 * len(np.intersect1d(a[2], b[2])) >= 85 * len(np.union1d(a[2], b[2]))}
    assert want and set(neardup.block_links(docs, [], 85)) == want
    across = neardup.block_links(docs[::2], docs[1::2], 85)
    assert set(across) == {(a, b) for a, b in want if (a - b) % 2}
    assert neardup.block_links([(i, 0, x) for i, _, x in docs], [], 85) == []


def test_words_whose_polynomial_hashes_meet(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, a), (2, a.translate(str.maketrans("ab", "ba"))), (3, " ".join([a] * 5)), (4, " ".join([a.translate(str.maketrans("ab", "ba"))] * 5))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.kept for r in got) and len(got) == 4


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(map(str, range(50)))
    rows = [(5, text), (5, text), (5, "something else of six words here"), (2, text + " 50"), (None, text), (9, "something else of six words here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False), (9, 2, False)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_regions_are_searched_deeper():
    import numpy as np

    labels = np.zeros((100, 3), np.uint64)
    labels[60:, 1] = 1
    labels[90:, 2] = 1
    assert neardup.least_depth(labels[:10], 9) == (0, 1)
    assert neardup.least_depth(labels, 70) == (60, 2)
    assert neardup.least_depth(labels, 99) == (90, 3)
    assert neardup.least_depth(labels, 89) == (89 - neardup.LOOK_BACK, 3)


@pytest.mark.parametrize("links", [[], [(1, 0)], [(i + 1, i) for i in range(60)], [(100, i) for i in range(50)] + [(200, 199)], [(i * 7 % 50, i * 3 % 50) for i in range(1, 40)]])
def test_components(spark, links):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), work_dir(spark)).collect()}
    assert got == {x: r for x, r in groups({x for l in links if l[0] != l[1] for x in l}, [l for l in links if l[0] != l[1]]).items()}


def test_sets_do_not_depend_on_their_block():
    texts = pa.array(["a b c d e f", None, "x", "A B C D E F"])
    (_, hashes, bounds), *_ = neardup.shingle_sets(texts)
    assert bounds.tolist() == [0, 2, 2, 3, 5] and hashes[:2].tolist() == hashes[3:].tolist()
