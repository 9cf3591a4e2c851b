import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from shelfwise.llm import trie
from tests.llm.helpers import against_sql, frame

SCHEMA = "conv_id long, turn long, role string, text string, shard int, pos string"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    """Nodes by walking every prefix of every conversation."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, key(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100 if c >= 0 else c + (-c) % 100, [])[:h] + ts[h:])
    nodes = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if built[c] == p)
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), sum(not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in nodes) for q in below),
            sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(map(repr, out))


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def talk(rng, ids, longest, words):
    return [(c, t, rng.choice(["user", "bot"]), "é" * rng.randrange(3) + rng.choice(words), 0, "x") for c in ids for t in range(rng.randrange(longest))]


@pytest.mark.parametrize("shard, band", [(20_000, 64), (30, 2)])
def test_equals_brute_force_and_sql(spark, monkeypatch, shard, band):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "BAND", band)
    rng = random.Random(shard)
    rows = talk(rng, [*range(0, 60), *range(95, 130), 205, 307, 1000, 1001, 1002], 9, ["a", "b"])
    rows += [(500 + k, 0, "user", "hello", 1, None) for k in range(40)]  # copies, some left without turns
    rows += [(None, 0, "user", "no id", 0, "x"), (7, None, None, None, 0, "x"), (7, None, "user", None, 0, "x"), (8, 1, "bot", "tie", 0, "x"), (8, 1, "bot", "tie", 0, "x"), (8, 1, "user", "tie", 0, "x"), (-150, 0, "user", "below", 0, "x"), (-100, 0, "user", "zero", 0, "x")]
    rng.shuffle(rows)
    df, twin = frame(spark, SCHEMA, rows)
    result = trie.prefix_trie(df)
    assert found(result) == brute(rows)
    got, want = against_sql(result, trie.ORACLE, conversations=twin)
    assert got == want


def test_a_long_conversation_a_long_text_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", 100)
    rows = [(0, t, "user", str(t), 0, "x") for t in range(400)] + [(c, 0, "user", "y" * 200_000, 0, "x") for c in range(1, 8)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x", 0, "y")], SCHEMA))) == []
