import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
zstandard = pytest.importorskip("zstandard")

from shelfwise.llm import tokenfiles
from shelfwise.llm.shared import work_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


ODD = ["", None, "The THE the", "a b c", "Å é ́x", "ΣΑΣ ΣΑΣ. İstanbul", "<|endoftext|> <|startoftext|>", "x <|startoftext|> y<|endoftext|>z <|STARTOFTEXT|>", "don't I'LL we've", "1234 12a", "a,b a.'s x!'s n't. o'clock' (it's) a=\u0338 a,\u0338b e\u0301, A\u030a. ǅ,b", "t|> startoftext|> a<|startoftext|>, b.<|endoftext|>.", "日本語 テスト　x", "\x1c\x1dq\x85z", "word " * 30000, "x" * 70000]


def test_query_equals_the_library(spark, library):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["the", "Ing", "the,", "ing'", "the's", "a.b", "e,\u0301", "é!", "zz..", "Ünder", "it's", "\n"]) for _ in range(rng.randrange(200))) for _ in range(120)]
    rows = [(3 * i - 20, text, "x") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.token_files_round_trip(docs, PATH, 1).collect()}
    start = 0
    for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = library(text)
        assert got[doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    assert len(got) == len(rows)


def test_single_documents_and_damage(spark, library, tmp_path):
    docs = spark.createDataFrame([(i, f"word number {i} " * 900) for i in range(200)], "doc_id long, text string").coalesce(1)
    files = [r.file for r in tokenfiles.write_token_files(docs, work_dir(spark), PATH, 1).collect()]
    found = 0
    for file in files:
        reader = tokenfiles.TokenFile(file)
        for doc_id in reader.entries["doc_id"][:3].tolist() + reader.entries["doc_id"][-3:].tolist():
            assert reader.get(doc_id).tolist() == library(f"word number {doc_id} " * 900)
            found += 1
        raw = open(file.removeprefix("file://"), "rb").read()
        bad = tmp_path / "bad.zst"
        bad.write_bytes(raw[:20] + bytes([raw[20] ^ 1]) + raw[21:])
        with pytest.raises(Exception):
            list(tokenfiles.TokenFile(str(bad)).documents())
    assert found and len(files) > 1


def test_repeated_rows_null_ids_and_no_rows(spark, library):
    docs = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (None, "n")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfiles.token_files_round_trip(docs, PATH, 1).collect())
    assert got == [(0, None, 2), (2, 5, 2), (4, 5, 2), (6, 5, 2)]
    assert tokenfiles.token_files_round_trip(docs.limit(0), PATH, 1).count() == 0


def test_files_are_closed_at_their_size(spark, library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 5)
    docs = spark.createDataFrame([(i, "a b c") for i in range(7)], "doc_id long, text string").coalesce(1)
    folder = work_dir(spark)
    writer = tokenfiles.FileWriter(f"{folder}/x.zst", 2)
    writer.add(1, b"ab")
    writer.close()
    assert [(d, ids.tolist()) for d, ids in tokenfiles.TokenFile(f"{folder}/x.zst").documents()] == [(1, [25185])]
    manifest = tokenfiles.write_token_files(docs, folder + "/t", PATH, 1)
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in tokenfiles.read_token_files(manifest).collect())
    assert got == [(i, 4 * i, 4) for i in range(7)]


@pytest.mark.parametrize("name, want", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_other_vocabularies_are_used_on_whole_texts(name, want):
    path = public_tokenizers.path(name)
    assert tokenfiles.by_units(path) == want
    texts = ["a  b\nc", "The the", None, "x\x85 y  "]
    t = tokenizers.Tokenizer.from_file(path)
    enc = tokenfiles.TextEncoder(path)
    got = [np.frombuffer(x, f"<u{enc.width}").tolist() for x in enc.encode(pa.array(texts))]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
