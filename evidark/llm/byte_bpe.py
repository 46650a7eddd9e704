"""Byte-level BPE by a sentencepiece model that is serialised from a rank file.

Every rank becomes a piece: its bytes, each written as the character U+0100 + byte, scored by the negative rank, so that
sentencepiece merges in the order of the ranks. The model's normalisation is the identity. A text is cut into pre-tokens;
those not seen lately go to the model in one string, apart by spaces, which no piece holds and which so come back as the
unknown id. A pre-token that is itself in the vocabulary is that id, as in the library that the file was written for.
Decoding is the inverse mapping: the pieces' bytes, joined.

Null and empty texts have no ids. Ids and bytes of a long text are hashed window by window; what a task holds of it, beside
the text itself, is a window's pre-tokens. Null doc_ids, repeated rows and further columns are kept apart by row. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.llm.common import as_bytes, table

#: Bytes that a worker process keeps of ids by pre-token, in two generations; longer pre-tokens are not kept.
KEPT_BYTES, KEPT_LENGTH = 96 << 20, 64
#: Of an entry, beside its characters and ids: the two objects and a dict's slot.
ENTRY_BYTES = 240
#: Texts of up to so many characters are split at once; longer ones by so many pre-tokens.
TOGETHER, WINDOW = 256 << 10, 1 << 16
#: Pre-tokens that the model gets at once.
BULK = 4096
BYTE = 0x100
#: Code points below this have had their class in every version of Unicode that the libraries use; this one is in none.
SETTLED, UNASSIGNED = 0x530, 0x378


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def letters(data: bytes) -> str:
    """Bytes as the model's characters."""
    return data.decode("latin-1").translate(LETTERS)


#: 0xFF is in no UTF-8 text, so it can stand between pre-tokens.
LETTERS, APART = {b: BYTE + b for b in range(256)}, b"\xff"
LETTERS_APART = LETTERS | {APART[0]: " "}


def serialised(tokens: Iterable[bytes]) -> bytes:
    """A sentencepiece model of the tokens, given by rank; the last piece is the unknown one."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=letters(token), score=-rank, type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    train, normal = model.trainer_spec, model.normalizer_spec
    train.model_type, train.vocab_size, train.unk_id = pb.TrainerSpec.BPE, len(model.pieces), len(model.pieces) - 1
    train.bos_id = train.eos_id = train.pad_id = -1
    normal.name, normal.add_dummy_prefix, normal.remove_extra_whitespaces, normal.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


def settled_pattern(pattern: str) -> re.Pattern:
    r"""The pattern for texts of settled characters alone, with \p{L}, \p{N} and \s spelt out, for the faster ``re``."""
    import regex

    def ranges(kind: str) -> str:
        found: list[list[int]] = []
        for c in map(ord, regex.findall(kind, "".join(map(chr, range(SETTLED))))):
            if found and found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in found)

    spelt = {kind: ranges(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = "", False
    for part in regex.findall(r"\\p\{\w\}|\\.|.", pattern):
        inside = (inside or part == "[") and part != "]"
        if part == r"\S" and not inside:
            part = f"[^{spelt[chr(92) + 's']}]"
        elif part in spelt:
            part = spelt[part] if inside else f"[{spelt[part]}]"
        out += part
    return re.compile(out)


class Codec:
    """Ids of texts, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        order = sorted(ranks, key=ranks.get)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(order))
        self.pattern, self.unknown = pattern, len(order)
        self.ids = np.array([ranks[t] for t in order] + [0], "<u4")  # of the model's pieces
        size = max(ranks.values(), default=-1) + 1
        self.token: list[bytes | None] = [None] * size
        self.decimal: list[bytes | None] = [None] * size
        for t, rank in ranks.items():
            self.token[rank], self.decimal[rank] = t, b"%d" % rank
        #: Tokens that merging does not lead to; as whole pre-tokens they are ids all the same.
        whole = [t for t, found in zip(order, self.model.encode([letters(t) for t in order])) if len(found) > 1]
        self.whole = {t.decode(): ranks[t].to_bytes(4, "little") for t in whole if t.decode(errors="ignore").encode() == t}
        self.cut, self.cut_settled = regex.compile(pattern), settled_pattern(pattern)
        self.unsettled = re.compile(f"[{chr(SETTLED)}-\U0010ffff]").search
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0  # bytes of ``now``

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """Windows of a text's pre-tokens."""
        cut, plain = (self.cut, text.translate(newer_characters(self.pattern))) if self.unsettled(text) else (self.cut_settled, text)
        if len(text) <= TOGETHER and plain == text:
            yield cut.findall(text)
            return
        matches = cut.finditer(plain)
        while some := [text[m.start() : m.end()] for m in islice(matches, WINDOW)]:
            yield some

    def learn(self, missing: set[str]) -> None:
        """Ids of pre-tokens not seen lately."""
        before = self.before
        known = {p: x for p in missing if (x := before.get(p)) is not None}
        new = [p for p in missing if p not in known]
        self.now |= known
        for at in range(0, len(new), BULK):
            some = new[at : at + BULK]
            said = APART.join(map(str.encode, some)).decode("latin-1").translate(LETTERS_APART)
            found = np.array(self.model.encode(said), np.int64)
            ends = np.flatnonzero(found == self.unknown)
            if len(ends) != len(some) - 1:
                raise ValueError("a byte is not in the vocabulary")
            data, ends = self.ids[found].tobytes(), (4 * ends).tolist()
            self.now.update(zip(some, [data[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(data)])]))
        for p in self.whole.keys() & missing:
            self.now[p] = self.whole[p]
        self.held += sum(map(len, missing)) + sum(map(len, map(self.now.__getitem__, missing))) + ENTRY_BYTES * len(missing)

    def ids_of(self, parts: list[str], ends: list[int]) -> Iterator[np.ndarray]:
        """Ids of pre-tokens, cut after those that ``ends`` counts."""
        missing = set(parts).difference(self.now)
        if missing:
            self.learn(missing)
        found = list(map(self.now.__getitem__, parts))
        for p in missing:
            if len(p) > KEPT_LENGTH:
                self.held -= ENTRY_BYTES + len(p) + len(self.now.pop(p))
        if 2 * self.held > KEPT_BYTES:
            self.now, self.before, self.held = {}, self.now, 0
        return (np.frombuffer(b"".join(found[a:b]), "<u4") for a, b in zip([0, *ends], ends))

    def windows(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """Places of the texts and their ids, in order; short texts are looked up together, long ones window by window."""
        places: list[int] = []
        parts: list[str] = []
        ends: list[int] = []
        for at, text in enumerate(texts):
            for window in self.pre_tokens(text):
                places.append(at)
                parts += window
                ends.append(len(parts))
                if len(parts) > WINDOW:
                    yield from zip(places, self.ids_of(parts, ends))
                    places, parts, ends = [], [], []
        yield from zip(places, self.ids_of(parts, ends))

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at, ids in self.windows(texts):
            if at == len(out):
                out.append([])
            out[at] += ids.tolist()
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for a worker process: its store serves all tasks there."""
    return Codec(path, pattern)


@cache
def newer_characters(pattern: str) -> dict[int, int]:
    """What ``regex`` takes for a letter or digit and tiktoken does not, asked of tiktoken itself by a vocabulary of pairs.

    Both libraries have Unicode tables of their own, and pre-tokens are to be tiktoken's. Each such character becomes one
    that is unassigned in both, as it is to tiktoken, before a text is split.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(SETTLED, 0xD800), *range(0xE000, 0x110000)]))
    pairs = [(first + c, ord(c)) for first, kind in (("a", "L"), ("1", "N")) for c in regex.findall(rf"\p{{{kind}}}", every)]
    ranks = {bytes([b]): b for b in range(256)} | {p.encode(): 256 + i for i, (p, _) in enumerate(pairs)}
    asked = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return {c: UNASSIGNED for p, c in pairs if len(asked.encode_ordinary(p)) > 1}


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of long) of each text."""
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in batches:
            ids = code.encode((t or b"").decode() for t in as_bytes(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<long>")


def decoded(ids: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text (binary) of a table of doc_id and ids; null ids give null, an id without a token raises."""
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in batches:
            data = [None if x is None else code.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>")).mapInArrow(run, "doc_id long, text binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Of each text the number of its ids, and the sha256 of the ids in decimals and of the bytes they decode to."""
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in batches:
            told, back, n = ([f() for _ in range(batch.num_rows)] for f in (hashlib.sha256, hashlib.sha256, int))
            for at, window in code.windows((t or b"").decode() for t in as_bytes(batch.column(1))):
                ids = window.tolist()
                if ids:
                    told[at].update((b" " if n[at] else b"") + b" ".join(map(code.decimal.__getitem__, ids)))
                    back[at].update(code.decode(ids))
                    n[at] += len(ids)
            digest = [pa.array([h.hexdigest() for h in x], pa.string()) for x in (told, back)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *digest], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGESTS)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
