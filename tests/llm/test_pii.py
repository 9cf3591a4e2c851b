import hashlib
import random
import re

import numpy as np

from shelfwise.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def brute(text):
    """The fixed spans straight from their patterns."""
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p, holds in PATTERNS for m in re.finditer(p, text or "") if holds(m[0])]


def test_fixed_spans_equal_their_patterns():
    rng = random.Random(3)
    parts = ["a", "@", ".", "b-", "1", "255", "256", "0012", "+4", " ", "-", "(", ")", "4000000000000002", "4", "é", "%", "x@y.z", "1.2.3.4", "+1 (212) 555-0100", "_", "ß", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text)] == brute(text), text


def test_very_long_texts_take_linear_time():
    for part in ("a", "1", "@", "a@", "1.", "+1 ", "(", "1 ", "= ", "AB12", "[at] "):
        text = part * 200_000
        pii.candidates(text, pii.base_spans(text))


def test_digests_and_added_spans(spark):
    rng = random.Random(1)
    prose = "der wind und das meer: irgendwohin schaut http://example.org/a/b/c/defghijk immer, page 2020-11-12 on".split()
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows, planted = [], {}
    for i in range(300):
        words = [rng.choice(prose) for _ in range(40)]
        text = " ".join(words)
        if i % 5 == 0:
            value = secret()
            text = f'{text} token = "{value}" {text}'
            planted[i] = [f"secret:{text.index(value)}:{text.index(value) + 40}"]
        elif i % 5 == 1:
            text = f"é {text} call tel: (0171) 555-77130 or mail jo.doe [at] example [dot] org, IBAN DE89 3704 0044 0532 0130 00 now"
            planted[i] = [f"{k}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in (("iban", "DE89 3704 0044 0532 0130 00"), ("contact", "jo.doe [at] example [dot] org"), ("number", "(0171) 555-77130"))]
        elif i % 5 == 2:
            text += " mail a.b@c.example.org from 10.0.0.1, card 4000-0000-0000-0002, +1 (212) 555-0100"
        rows.append((i, text, "x", "y"))
    rows += [(900, None, "x", "y"), (901, "", "x", "y"), (None, "a@b.c", "x", "y"), (8, "a@b.c", None, "y"), (8, "a@b.c", None, "y"), (902, "1" * 3_000 + "a" * 3_000 + "@" + " ." * 1_000, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, candidates string")
    got = {}
    for r in pii.personal_data_digests(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        want = brute(text)
        for r in [r for r in got[i] if i != 8 or r.n_email == text.count("@")]:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in pii.BASE)
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert r.spans == ",".join(want + planted.get(i, [])) and r.n_added == len(planted.get(i, []))
    assert pii.personal_data_digests(df.limit(0)).count() == 0


def test_reliabilities_are_found_without_labels():
    rng = np.random.default_rng(0)
    true = rng.random(20_000) < 0.3
    right = np.array([0.9, 0.8, 0.7, 0.95, 0.6])
    votes = np.where(rng.random((20_000, 5)) < right, true[:, None], ~true[:, None]) * 2
    codes, counts = np.unique((votes * 3 ** np.arange(5)).sum(axis=1), return_counts=True)
    model = pii.reliabilities(codes, counts.astype(float))
    assert abs(model.prior - 0.3) < 0.03
    assert np.abs(model.votes[1, :, 2] - right).max() < 0.04 and np.abs(model.votes[0, :, 0] - right).max() < 0.04


def test_masked_texts(spark):
    df = spark.createDataFrame([(1, "é a@b.c und 10.0.0.1!"), (2, None), (None, "a@b.c"), (3, "plain")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.masked(df).collect()} == {1: "é [email] und [ip]!", 2: None, None: "a@b.c", 3: "plain"}
