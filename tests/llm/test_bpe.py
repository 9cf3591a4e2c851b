import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from shelfwise.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def words(rng, n):
    return "".join(rng.choice(["a", "b", "the", "ing", "é", "日本", "  ", "\n", "1", "!!", "zz", "ö", " ", "\t", "\x1c", "\x85", "\xa0", "\u3000", "'s", "\u2028"]) for _ in range(n))


def test_encoding_equals_the_library(library):
    codec, rng = bpe.Codec(PATH, public_tokenizers.PATTERN), random.Random(1)
    texts = [words(rng, rng.randrange(1, 80)) for _ in range(300)] + ["", "a" * 5000, " " * 300, "<|endoftext|>"]
    for text, ids in zip(texts, codec.encode_all(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_other_patterns_and_small_stores(library, monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(1, 80)) for _ in range(100)] + [None, ""]
    for pattern in (public_tokenizers.PATTERN, r"\S+\s*|\s+"):
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
        codec = bpe.Codec(PATH, pattern)
        if codec._units:
            codec._units.units = 3
        for i in range(0, len(texts), 10):
            got = [x.tolist() for x in codec.encode_all(pa.array(texts[i : i + 10], pa.string()))]
            assert got == [own.encode_ordinary(x or "") for x in texts[i : i + 10]]


def test_many_pieces_at_once_equal_the_merges():
    v, rng = bpe.Vocabulary(bpe.load_ranks(PATH)), random.Random(5)
    batch = bpe.BatchEncoder(v)
    for _ in range(3):
        pieces = ["".join(rng.choice("abcdetinghs éß日!1") for _ in range(rng.randrange(1, 40))).encode() for _ in range(400)]
        assert batch.encode(pieces) == [v.merge(x) for x in pieces]
        last = batch.last_tokens(np.frombuffer(pieces[0], np.uint8), np.array([0, len(pieces[0])]))
        assert last[1:].tolist() == bpe.PrefixTable(v, pieces[0]).last[1:]
    assert batch.encode([]) == []


def test_appends_and_edits_equal_encoding_anew():
    v, rng = bpe.Vocabulary(bpe.load_ranks(PATH)), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("abcdetinghs") for _ in range(300)).encode()
        prefixes = bpe.PrefixTable(v, text[:100])
        prefixes.append(text[100:])
        assert prefixes.ids() == v.merge(text) == bpe.encode_piece(v, text)
        start = rng.randrange(280)
        stop, new = start + rng.randrange(10), text[: rng.randrange(6)]
        anew = prefixes.edit(start, stop, new)
        assert prefixes.ids() == v.merge(text[:start] + new + text[stop:])
        assert anew <= 300


def test_query_on_nulls_empty_long_and_repeated_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the thing " * 20000, "x"), (4, "the", None), (4, "the", None), (None, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    want = set()
    for i, text, _ in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        want.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN).count() == len(rows)
