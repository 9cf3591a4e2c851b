import random

import pyarrow as pa

from shelfwise.llm.units import unit_codes
from shelfwise.llm.words import words_of


def test_units_cover_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\t\n 日") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "   ", "x" * 300]
    seen = 0
    for i, first, codes, distinct in unit_codes(pa.array(texts)):
        for k in range(len(first) - 1):
            own = [distinct[c] for c in codes[first[k] : first[k + 1]]]
            assert b"".join(own) == (texts[i + k] or "").encode()
            assert [u.strip() for u in own if u.strip()] == (texts[i + k] or "").encode().split()
            seen += 1
    assert seen == len(texts)
    assert list(unit_codes(pa.array([], pa.string()))) == []


def test_units_may_end_before_marks():
    texts = ["ab, ab. ab,c !ab é, a|b a", "", None, ",", "a,"]
    for i, first, codes, distinct in unit_codes(pa.array(texts), b",."):
        got = [[distinct[c] for c in codes[first[k] : first[k + 1]]] for k in range(len(texts))]
    assert got == [[x.encode() for x in ("ab", ",", " ab", ".", " ab", ",c", " !ab", " é,", " a|b", " a")], [], [], [b","], [b"a", b","]]


def test_word_hashes_follow_the_bytes_alone():
    words = ["a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 64, "a" * 65, "a" * 64 + "b", "é", "e" * 16, "e" * 15 + "f"]
    together = [h for _, w in words_of(pa.array([" ".join(words)])) for h in w.hashes.tolist()]
    apart = [h for x in words for _, w in words_of(pa.array([f"\n{x} "])) for h in w.hashes.tolist()]
    assert together == apart and len(set(apart)) == len(words)
