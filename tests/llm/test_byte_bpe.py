"""Byte-level BPE against tiktoken: pre-tokens, merges, characters of newer Unicode, long texts; exact round trips."""

import hashlib
import random

import pytest
import tiktoken

from evidark.llm import byte_bpe, registry

#: Kept with the edge rows of the document queries.
EDGES = [None, "", " ", "\n\n  x", "it's we'll I'd 'S", "tab\t\tend\t", "  　x\x1c\x85y", "é ß 😀 ՘\U0003134b 中文 ٣ⅷ", "a" * 100_000, "ab cd " * 60_000, "▁x<|endoftext|>", "same", "same"]


@pytest.fixture(scope="module")
def code():
    return byte_bpe.codec(byte_bpe.ranks_path(), byte_bpe.split_pattern())


@pytest.fixture(scope="module")
def theirs():
    ranks = byte_bpe.read_ranks(byte_bpe.ranks_path())
    return tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_every_token_is_its_own_encoding(code):
    ranks = byte_bpe.read_ranks(byte_bpe.ranks_path())
    texts = {t.decode(): r for t, r in ranks.items() if t.decode(errors="ignore").encode() == t}
    for text, rank in list(texts.items())[::7]:
        parts = [p for w in code.pre_tokens(text) for p in w]
        assert len(parts) > 1 or code.encode([text]) == [[rank]]


def test_random_texts(code, theirs):
    rng = random.Random(5)
    some = "ab 1!\n\t\r'  é中　 \x1c\x85😀՘‍'sllveSDΩ٣ⅷ\U0003134b"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice((rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)))) for _ in range(50)) for _ in range(400)]
    ids = code.encode(texts)
    assert ids == [theirs.encode_ordinary(t) for t in texts]
    assert [code.decode(x) for x in ids] == [t.encode() for t in texts]


def test_a_small_store_and_small_windows_change_nothing(code, theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 3000)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 40)
    monkeypatch.setattr(byte_bpe, "WINDOW", 7)
    monkeypatch.setattr(byte_bpe, "BULK", 3)
    small = byte_bpe.Codec(byte_bpe.ranks_path(), byte_bpe.split_pattern())
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 40))) for _ in range(300)]
    assert small.encode(texts) == [theirs.encode_ordinary(t) for t in texts]
    assert 2 * small.held <= 3000


def test_tokens_that_merges_do_not_reach(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"de": 257}  # no pair leads to abc
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    own = tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    code = byte_bpe.Codec(str(path), byte_bpe.split_pattern())
    texts = ["abc", "abcd", "de abc", "abcde", "abc1abc"]
    assert code.encode(texts) == [own.encode_ordinary(t) for t in texts] and code.encode(["abc"]) == [[256]]


def test_digests_of_edge_rows(spark, theirs, tmp_path):
    rows = [(i, t, 7, "x") for i, t in enumerate(EDGES)] + [(None, "no id", None, None), (3, "\n\n  x", 1, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, ids long, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t, *_ in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((d, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_tables_of_ids_and_back(spark):
    rows = [(i, t) for i, t in enumerate(EDGES) if t is None or len(t) < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = byte_bpe.decoded(byte_bpe.encoded(docs)).collect()
    assert sorted((r.doc_id, bytes(r.text).decode()) for r in back) == [(i, t or "") for i, t in rows]
    assert byte_bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<long>")).collect()[0].text is None


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["op13_byte_bpe"](spark, str(tmp_path)).count() == 0
