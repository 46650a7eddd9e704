"""Best-fit packing by minimum bin slack.

Every document becomes token ids and an end id, cut into pieces of at most ``size`` tokens. Pieces of one length are
interchangeable, so the plan is made on the histogram of lengths (at most ``size`` numbers, whatever the corpus): each
step takes the longest length left, finds with a bitset subset-sum the fullest sequence that holds it, and uses that
combination as often as the histogram allows. A piece then finds its sequence from its length and its rank among the
pieces of that length; ranks come from counts per task and length, so no length is ever gathered in one task.

Null text is the empty text (its end id alone); null ids, repeated rows and further columns are kept apart by row.
An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidark.llm.common import as_bytes, table, written

SIZE = 2048
END = 0
#: Bytes that a worker process keeps of token ids by pre-token, in two generations; longer pre-tokens are not kept.
KEPT_BYTES, KEPT_LENGTH = 64 << 20, 48
#: Bytes of text that are split at a time.
TOGETHER = 256 << 10
#: Of an entry, beside its characters and ids: the two objects and a dict's slot.
ENTRY_BYTES = 240

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACES = "\\x20\\x09-\\x0d"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, equal to the tokenizer's for the whole text.

    The vocabulary's pre-tokens never hold white space, so ids of a text are ids of its pre-tokens in a row. Text of
    plain characters (to U+017F, where lower case and composition are simple) is split into pre-tokens here by the
    tokenizer file's own pattern, written for these characters; those not seen lately go to the tokenizer's model
    together, and the model marks the last token of each. Words with other characters go through the whole tokenizer.
    """

    PLAIN = f"[{SPACES}\\x21-\\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]*"
    SPLIT = f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = re.compile(self.PLAIN).fullmatch
        self.split = re.compile(self.SPLIT).findall
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({chr(c): byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x180) if self.plain(chr(c))})
        self.last = np.zeros(self.whole.get_vocab_size(), bool)
        self.last[[i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0  # bytes of ``now``

    def whole_ids(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def model_ids(self, parts: list[str]) -> list[bytes]:
        joined = " ".join(parts).translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(parts):  # a character that the model does not know
            return [self.whole_ids(p) for p in parts]
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def parts(self, text: bytes) -> list[str]:
        """Pre-tokens; a word that is not plain is one part, behind a zero."""
        said = text.decode()
        if "<|" not in said and self.plain(said):
            return self.split(said.lower())
        out: list[str] = []
        for word in text.split():
            said = word.decode()
            if "<|" not in said and self.plain(said):
                out += self.split(said.lower())
            else:
                out.append("\0" + said)
        return out

    def learn(self, missing: set[str]) -> None:
        now, before, new = self.now, self.before, []
        for p in missing:
            known = before.get(p)
            if known is not None:
                now[p] = known
            elif p[0] == "\0":
                now[p] = self.whole_ids(p[1:])
            else:
                new.append(p)
        for at in range(0, len(new), 4096):
            now.update(zip(new[at : at + 4096], self.model_ids(new[at : at + 4096])))
        self.held += sum(ENTRY_BYTES + len(p) + len(now[p]) for p in missing)

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text. About ``TOGETHER`` bytes are split at a time; longer texts in parts that end at white space."""
        some: list[bytes | None] = []
        size = 0
        for text in texts:
            if text and len(text) > TOGETHER:
                yield from self.some(some)
                yield b"".join(x for part in parts_of(text, TOGETHER) for x in self.some([part]))
                some, size = [], 0
                continue
            some.append(text)
            size += len(text or b"")
            if size > TOGETHER:
                yield from self.some(some)
                some, size = [], 0
        yield from self.some(some)

    def some(self, texts: list[bytes | None]) -> list[bytes]:
        get, found, holes, missing = self.now.get, [], [], set()
        for text in texts:
            parts = self.parts(text) if text else []
            ids = list(map(get, parts))
            if None in ids:
                open_ = [(i, p) for i, (p, x) in enumerate(zip(parts, ids)) if x is None]
                missing.update([p for _, p in open_])
                holes.append((ids, open_))
            found.append(ids)
        if missing:
            self.learn(missing)
            for ids, open_ in holes:
                for i, p in open_:
                    ids[i] = self.now[p]
        out = list(map(b"".join, found))
        for p in missing:
            if len(p) > KEPT_LENGTH:
                self.held -= ENTRY_BYTES + len(p) + len(self.now.pop(p))
        if 2 * self.held > KEPT_BYTES:
            self.now, self.before, self.held = {}, self.now, 0
        return out


WHITE = re.compile(rb"[\x20\x09-\x0d]")


def parts_of(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end at white space, or where the text ends."""
    at = 0
    while at < len(text):
        white = WHITE.search(text, at + size)
        to = white.end() if white else len(text)
        yield text[at:to]
        at = to


@cache
def encoder(path: str) -> Encoder:
    """One for a worker process: its store serves all tasks there."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """One row for each piece, with its length's rank in the task that made it."""
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), encode(as_bytes(batch.column(1)))):
                ids += last
                view = memoryview(ids)
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = view[at : at + 4 * size]
                    n = len(part) // 4
                    for column, x in zip(out, (doc, k, at // 4, n, zlib.crc32(part), int(seen[n]))):
                        column.append(x)
                    seen[n] += 1
            doc, k, start, n, crc, nth = out
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(n), pa.int32()), pa.array(nth, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``: bitset subset-sum, longest first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        left, k = min(counts[n], room // n), 1
        while left > 0:  # binary splitting of the copies
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    rest, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> rest & 1:
            rest, used[n] = rest - n * k, used.get(n, 0) + k
    return used


Slots = list[tuple[int, int, int, int, int, int]]


def plan(histogram: dict[int, int], size: int = SIZE) -> Slots:
    """Rows (length, first rank, last rank + 1, copies in a sequence, first sequence, offset of the first copy).

    Each step uses up at least one length, or leaves fewer of one than a sequence of its kind takes; so the rows depend
    on ``size`` alone, not on how many pieces there are. The whole room by subset sum wastes short pieces when most are
    of middling length, so plans that first take the longest that fit, and sum the last part only, are tried as well.
    """
    best: tuple[int, Slots] | None = None
    least = -(-sum(n * c for n, c in histogram.items()) // size)
    for summed in (size, size // 2, size // 4, size // 8):
        found = bins(histogram, size, summed)
        if best is None or found[0] < best[0]:
            best = found
        if best[0] <= least:
            break
    return best[1]


def bins(histogram: dict[int, int], size: int, summed: int) -> tuple[int, Slots]:
    """Number of sequences, and their slots, when the last ``summed`` tokens of a sequence are filled by subset sum."""
    counts, taken = {n: c for n, c in histogram.items() if c > 0}, dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    while counts:
        lengths = sorted(counts, reverse=True)
        free, room, used = dict(counts), size, {}
        for n in lengths:
            k = min(free[n], room // n) if room > summed else not used
            if k:
                used[n], free[n], room = k, free[n] - k, room - n * k
            if room <= summed and used:
                break
        for n, k in fullest([n for n in lengths if free[n]], free, room).items():
            used[n] = used.get(n, 0) + k
        times, offset = min(counts[n] // k for n, k in used.items()), 0
        for n in sorted(used, reverse=True):
            k = used[n]
            rows.append((n, taken[n], taken[n] + k * times, k, sequence, offset))
            taken[n] += k * times
            offset += n * k
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        sequence += times
    return sequence, rows


def placed(spark: SparkSession, cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (written) with sequence_id and offset."""
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = by_task.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    slots = sorted(plan(histogram, size))
    table_ = np.array(slots, np.int64).reshape(-1, 6)
    starts: dict[int, np.ndarray] = {int(n): table_[table_[:, 0] == n] for n in np.unique(table_[:, 0])}
    shared = spark.sparkContext.broadcast(starts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            ends = np.flatnonzero(np.diff(length[order], append=-1)) + 1
            for at, to in zip(np.r_[0, ends[:-1]] if len(ends) else (), ends):
                rows = order[at:to]
                n = int(length[rows[0]])
                t = shared.value[n]
                slot = t[np.searchsorted(t[:, 1], rank[rows], "right") - 1]
                k, copy = np.divmod(rank[rows] - slot[:, 1], slot[:, 3])
                sequence[rows], offset[rows] = slot[:, 4] + k, slot[:, 5] + copy * n
            kept = [batch.column(i) for i in range(5)]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before.select("task", "length", F.coalesce("first", F.lit(0)).alias("first")), ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """All documents in sequences of at most ``size`` tokens: one row for each piece, with its place."""
    return placed(spark, written(spark, pieces(docs, path or tokenizer_path(), size, end), "pieces"), size)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents: one row for each piece, with its place."""
    return pack(spark, docs)
