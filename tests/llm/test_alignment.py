"""Alignment of two tokenizers against a plain reading of the contract on whole texts."""

import hashlib
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer, pre_tokenizers

from evidark.llm import alignment, registry


class Plain:
    """Whole texts through both tokenizers, every pair of tokens compared."""

    def __init__(self):
        a, b = alignment.tokenizer_paths()
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte = {}
        for c in map(chr, [*range(0xD800), *range(0x10000, 0x110000, 0x1000)]):
            self.byte |= dict(zip(level.pre_tokenize_str(c)[0][0], c.encode()))

    def tokens(self, text):
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        in_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        in_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        return (a, in_a, b, in_b) if b"".join(in_a) == b"".join(in_b) == (" " + text).encode() else None

    def groups(self, text):
        """((A ids, A bytes), (B ids, B bytes)) of each group."""
        found = self.tokens(text) if text else None
        if not found:
            return []
        a, in_a, b, in_b = found
        out, i, j = [], 0, 0
        while i < len(a):
            m, n, x, y = i + 1, j + 1, len(in_a[i]), len(in_b[j])
            while x != y:
                if x < y:
                    x, m = x + len(in_a[m]), m + 1
                else:
                    y, n = y + len(in_b[n]), n + 1
            out.append(((a[i:m], in_a[i:m]), (b[j:n], in_b[j:n])))
            i, j = m, n
        return out


def links(group):
    (a, in_a), (b, in_b) = group
    out, at = [], 0
    for i, x in zip(a, in_a):
        to = 0
        for j, y in zip(b, in_b):
            if at < to + len(y) and to < at + len(x):
                out.append((i, j))
            to += len(y)
        at += len(x)
    return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def wanted(plain, rows):
    every = [(d, plain.groups(t)) for d, t in rows]
    count: dict = {}
    for _, groups in every:
        for p in {p for g in groups for p in links(g)}:
            count[p] = count.get(p, 0) + 1
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for d, groups in every:
        pairs = [p for g in groups for p in links(g)]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for (a, _), (b, _) in groups)
        out.append((d, sum(len(g[0][0]) for g in groups), sum(len(g[1][0]) for g in groups), len(groups), len(pairs), sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(told.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


EDGES = [None, "", " ", "\n", "x", "x\n\n", "\t\t", " two  spaces ", "a\tb\r\nc \r d;\r\ne", "▁x and ▁", "one ▁two three", "<|endoftext|> <s> <unk> <0x41>", "é ß 中😀 　 x\xa0y \x1c z\x85", "it's we'll 3.14159", "same words here", "same words here", "x" * 3000, "ab cde " * 500, "\x00\x01 nul"]


def texts(seed, n):
    rng = random.Random(seed)
    some = ["the", "tokenization", "Ünïcode", "12345", "don't", "foo_bar(baz)", "\n", "\n\n", " ", "\t", "\r\n", "😀", "中中", "é", "x" * 30, "...", "\xa0"]
    return ["".join(rng.choice(some) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def run(spark, path, rows, parts=3):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pair long, key string").repartition(parts).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, registry.QUERIES["op12_group_dictionary"](spark, str(path)).collect()), key=repr)


def test_edges_and_random_texts(spark, tmp_path, plain):
    rows = list(enumerate(EDGES + texts(3, 150))) + [(None, "no id"), (None, "no id"), (3, "x again")]
    assert run(spark, tmp_path, rows) == wanted(plain, rows)


def test_small_parts_change_nothing(plain, monkeypatch):
    """Windows, bulks and a store that is begun anew; one process, without Spark."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "TOGETHER", 50)
    monkeypatch.setattr(alignment, "WINDOW", 5)
    monkeypatch.setattr(alignment, "BULK", 3)
    monkeypatch.setattr(alignment, "KEPT_BYTES", 20_000)
    paths, rows, stores = alignment.tokenizer_paths(), list(enumerate(EDGES[:16] + texts(4, 120))), set()
    alignment._STORES.clear()
    want = wanted(plain, rows)
    got = []
    for at in range(0, len(rows), 10):
        kept = alignment.store(*paths)
        stores.add(id(kept))
        some = rows[at : at + 10]
        b = alignment.block(kept, at, pa.array([d for d, _ in some], pa.int64()), [None if t is None else t.encode() for _, t in some]).to_pylist()[0]
        got += list(zip(b["doc_id"], b["n_a"], b["n_b"], b["n_groups"], b["n_links"], b["told"]))
    alignment._STORES.clear()
    assert sorted(got, key=repr) == sorted(((*r[:5], r[7]) for r in want), key=repr)


def test_repeated_pairs_count_a_document_once(spark, tmp_path, plain):
    rows = [(1, "the the the"), (2, "the"), (3, "The the")]
    assert run(spark, tmp_path, rows, 1) == wanted(plain, rows)


def test_empty_table_and_texts_without_tokens(spark, tmp_path):
    assert run(spark, tmp_path / "none", []) == []
    assert run(spark, tmp_path / "empty", [(1, None), (2, ""), (3, "▁")]) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_overlaps():
    import numpy as np

    a, b = alignment.overlaps(np.array([2, 3, 6]), np.array([1, 4, 6]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)]
