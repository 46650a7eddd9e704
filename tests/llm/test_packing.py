"""Packing: exact ids, whole coverage, gapless sequences, few of them."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from evidark.llm import packing

TEXTS = ["", None, "THE Cat H\u0331 \u1e96 A\u030a <|STARTOFTEXT|>", "THE\u00c9 End", "the cat\tsat\x0bon", "it's 12 o'clock ΣΑΣ <|endoftext|> x y", "a b c " * 2000, "same", "same", "  \n ", "é ́ ü"]


def docs(spark, texts):
    return spark.createDataFrame([(i % 7 or None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string")


def test_rows_match_whole_text_encoding(spark):
    got = packing.pack(spark, docs(spark, TEXTS)).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((i % 7 or None, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))


def test_sequences_are_gapless_and_few(spark):
    rng = np.random.default_rng(1)
    texts = ["w " * int(n) for n in rng.integers(0, 3000, 400)]
    got = packing.pack(spark, docs(spark, texts)).toPandas().sort_values(["sequence_id", "offset"])
    for _, s in got.groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    room: list[int] = []  # first fit decreasing, for comparison
    for n in sorted(got.length, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(2048 - n)
        else:
            room[at] -= n
    assert got.sequence_id.nunique() <= len(room)


def test_long_texts_and_a_full_store(monkeypatch):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    monkeypatch.setattr(packing, "TOGETHER", 40)
    monkeypatch.setattr(packing, "KEPT_BYTES", 4000)
    encode = packing.Encoder(packing.tokenizer_path())
    texts = [" ".join(f"word{i} it's <|endoftext|>\té{i % 7}" for i in range(200)), "x" * 300, None, "", "a b", "a\x0bb " * 50] * 2
    got = list(encode([t if t is None else t.encode() for t in texts]))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encode.held <= 4000 and 2 * len(encode.before) * packing.ENTRY_BYTES < 3 * 4000 + 2 * 60 * 300


def test_empty_table(spark):
    assert packing.pack(spark, docs(spark, TEXTS).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_best_subset(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6))}
    reach = {0}
    for n, c in counts.items():
        reach = {a + n * k for a in reach for k in range(c + 1) if a + n * k <= 60}
    used = packing.fullest(sorted(counts, reverse=True), counts, 60)
    assert sum(n * k for n, k in used.items()) == max(reach) and all(k <= counts[n] for n, k in used.items())
