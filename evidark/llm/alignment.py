"""Alignment of two tokenizers over the same bytes, by a dictionary of groups.

A byte offset where tokens of both end cuts a text into groups. What a group links (the pairs of an A and a B token whose
bytes overlap) depends on its ids alone, so distinct groups are interned and expanded once: in a worker process for the
texts at hand, and once more in the cluster, where they meet the pairs' counts.

1. Each batch of texts (8 MB, or one longer text) becomes one row, a block: its dictionary of groups, its documents as
   places in that dictionary with frequencies, and of each pair the number of the block's documents that hold it.
2. The blocks' pair counts are summed; the highest count of an A id is a table of at most the vocabulary's size.
3. The distinct groups of all blocks are expanded and joined with the counts: links that are their A id's highest, and the
   sum of counts, by group.
4. Each block's dictionary is joined with these by the group's ids, and its documents add them up by frequency.

Neither tokenizer joins a printing character to a space or line end behind it (checked on the vocabulary), so texts are
encoded in chunks that end there; those not seen lately are encoded together. Both tokenizers end a token at the end of
every chunk, so groups do not cross chunks.

A text has no tokens, zeros and the empty digest if it is null or empty, or if the pieces' bytes are not its own (U+2581
in a text, which the second tokenizer takes for a space). Null doc_ids and repeated rows count as documents of their own;
further columns are not read. An empty table gives no rows. Of a long text a task holds four bytes a chunk beside the text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.llm.common import as_bytes, table, written

#: Bytes that a worker process keeps of chunks and groups, and what an entry takes beside its characters: objects, slots, numbers.
KEPT_BYTES, ENTRY_BYTES, GROUP_BYTES = 160 << 20, 300, 240
#: Texts of up to so many characters are cut at once; longer ones by so many chunks.
TOGETHER, WINDOW = 256 << 10, 1 << 16
#: Chunks that the tokenizers get at once.
BULK = 4096
#: A pair is one number of 20 bits each; a block has fewer than 2^23 documents.
SHIFT = 20
MASK = (1 << 2 * SHIFT) - 1
SPACE, LEAD = "▁", " x"

#: Up to a printing character before a space or line end; white space at the end of a text stays with what is before it.
CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def tokenizer_paths(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


class Grown:
    """A numpy column that grows."""

    def __init__(self, dtype: type):
        self.data, self.n = np.zeros(1024, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(n, 2 * self.n) - self.n, self.data.dtype)])
        self.data[self.n : n] = more
        self.n = n

    @property
    def now(self) -> np.ndarray:
        return self.data[: self.n]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges first, first + 1, ... of lengths ``n``, one behind the other."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens that share bytes; both lists of ends cover the same bytes."""
    first = np.searchsorted(ends_b, np.r_[0, ends_a[:-1]], "right")
    last = np.searchsorted(ends_b, ends_a, "left")
    n = last - first + 1
    return np.repeat(np.arange(len(ends_a)), n), spread(first, n)


class Tokenizers:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        crossing = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and re.search(r"\S[ \n]", p.replace(SPACE, " "))]
        if crossing or max(len(pieces), self.a.get_vocab_size()) >> SHIFT:
            raise ValueError(f"pieces that hold a space behind a printing character, or too many: {crossing[:3]}")
        self.a_length = np.zeros(self.a.get_vocab_size(), np.int64)
        for token, i in self.a.get_vocab().items():
            self.a_length[i] = len(token)  # a character stands for a byte
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a space, which the second tokenizer puts there itself; None if the bytes differ."""
        b = self.b.encode(text[1:])
        said = text.encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != said:
            return None
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        return (a, np.array(b, np.int64)) if self.a_length[a].sum() == len(said) else None


@cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def joined(ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Ids in decimals, joined by commas, between bounds."""
    told = list(map(str, ids.tolist()))
    at = bounds.tolist()
    return [",".join(told[i:j]) for i, j in zip(at, at[1:])]


class Store:
    """Chunks and groups that a worker process has met, as numbers; begun anew when it is over its bytes."""

    def __init__(self, codes: Tokenizers):
        self.codes = codes
        self.chunk: dict[str, int] = {}
        self.told: list[bytes] = []  # a chunk's groups in words
        self.n_a, self.n_b, self.n_links, self.differs = Grown(np.int64), Grown(np.int64), Grown(np.int64), Grown(bool)
        self.first, self.n_groups, self.groups = Grown(np.int64), Grown(np.int64), Grown(np.int32)
        self.group: dict[str, int] = {}
        self.key: list[str] = []
        self.first_pair, self.n_pairs, self.pairs = Grown(np.int64), Grown(np.int64), Grown(np.int64)
        self.held = 0

    def add(self, chunks: list[str], told: list[bytes], n_a: np.ndarray, n_b: np.ndarray, n_links: np.ndarray, n_groups: np.ndarray, groups: np.ndarray, differs: bool) -> None:
        at = len(self.told)
        self.chunk.update(zip(chunks, range(at, at + len(chunks))))
        self.told += told
        self.first.extend(self.groups.n + np.cumsum(n_groups) - n_groups)
        for column, more in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, n_links), (self.n_groups, n_groups), (self.groups, groups), (self.differs, np.full(len(chunks), differs))):
            column.extend(more)
        self.held += ENTRY_BYTES * len(chunks) + sum(map(len, chunks)) + sum(map(len, told)) + 4 * len(groups)

    def learn(self, chunks: list[str]) -> None:
        """Chunks that end in a printing character, encoded together; any other must come alone."""
        codes = self.codes
        found = codes.encode(LEAD + "".join(chunks))
        if found is None:
            if len(chunks) > 1:
                self.learn(chunks[: len(chunks) // 2])
                self.learn(chunks[len(chunks) // 2 :])
            else:
                none = np.zeros(1, np.int64)
                self.add(chunks, [b""], none, none, none, none, none[:0], True)
            return
        a, b = found
        a_ends, b_ends = np.cumsum(codes.a_length[a]), np.cumsum(codes.b_length[b])
        skip_a, skip_b = (int(np.searchsorted(x, len(LEAD), "right")) for x in (a_ends, b_ends))
        a, b, a_ends, b_ends = a[skip_a:], b[skip_b:], a_ends[skip_a:] - len(LEAD), b_ends[skip_b:] - len(LEAD)
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        chunk_ends = np.cumsum([len(c.encode()) for c in chunks])
        last = np.searchsorted(ends, chunk_ends)  # the last group of each chunk
        if not np.array_equal(ends[last], chunk_ends):
            raise ValueError("a token crosses the end of a chunk")
        a_bounds, b_bounds = (np.r_[0, np.searchsorted(x, ends, "right")] for x in (a_ends, b_ends))
        keys = [f"{x}|{y}" for x, y in zip(joined(a, a_bounds), joined(b, b_bounds))]
        link_a, link_b = overlaps(a_ends, b_ends)
        owner = np.searchsorted(ends, a_ends)[link_a]
        n_links = np.bincount(owner, minlength=len(ends))
        pairs = np.unique(owner << 2 * SHIFT | a[link_a] << SHIFT | b[link_b])
        n_pairs = np.bincount(pairs >> 2 * SHIFT, minlength=len(ends))
        new: list[int] = []
        for i, k in enumerate(keys):
            if k not in self.group:
                self.group[k] = len(self.key)
                self.key.append(k)
                new.append(i)
        at = spread((np.cumsum(n_pairs) - n_pairs)[new], n_pairs[new])
        self.first_pair.extend(self.pairs.n + np.cumsum(n_pairs[new]) - n_pairs[new])
        self.n_pairs.extend(n_pairs[new])
        self.pairs.extend(pairs[at] & MASK)
        self.held += GROUP_BYTES * len(new) + sum(len(keys[i]) for i in new) + 8 * len(at)
        starts = np.r_[0, last[:-1] + 1]
        told = [";".join(keys[i:j]).encode() for i, j in zip(starts.tolist(), (last + 1).tolist())]
        summed = lambda n: np.add.reduceat(n, starts)
        self.add(chunks, told, summed(np.diff(a_bounds)), summed(np.diff(b_bounds)), summed(n_links), last + 1 - starts, np.array([self.group[k] for k in keys], np.int32), False)

    def places(self, chunks: list[str]) -> np.ndarray:
        """Entries of chunks."""
        missing = set(chunks).difference(self.chunk)
        together = [c for c in missing if not c[-1].isspace()]
        for at in range(0, len(together), BULK):
            self.learn(together[at : at + BULK])
        for c in missing.difference(together):
            self.learn([c])
        return np.fromiter(map(self.chunk.__getitem__, chunks), np.int32, len(chunks))


def windows(text: str) -> Iterator[list[str]]:
    """A text's chunks; long texts come in several lists."""
    if len(text) <= TOGETHER:
        yield CHUNK.findall(text)
        return
    found = CHUNK.finditer(text)
    while some := [m.group() for m in islice(found, WINDOW)]:
        yield some


_STORES: dict[tuple[str, str], Store] = {}


def store(a_path: str, b_path: str) -> Store:
    """One for a worker process, new when the one before is full; only asked for between batches."""
    key = a_path, b_path
    if key not in _STORES or _STORES[key].held > KEPT_BYTES:
        _STORES[key] = Store(tokenizers(*key))
    return _STORES[key]


def entries(kept: Store, texts: Iterable[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the texts and the entries of their chunks, in order; short texts are looked up together."""
    places: list[int] = []
    chunks: list[str] = []
    ends: list[int] = []

    def looked_up() -> Iterator[tuple[int, np.ndarray]]:
        return zip(places, np.split(kept.places(chunks), ends[:-1])) if ends else iter(())

    for at, text in enumerate(texts):
        for window in windows(" " + text.decode()) if text else ():
            places.append(at)
            chunks += window
            ends.append(len(chunks))
            if len(chunks) > WINDOW:
                yield from looked_up()
                places, chunks, ends = [], [], []
    yield from looked_up()


def one_list(values: np.ndarray | pa.Array | list, kind: pa.DataType | None = None) -> pa.Array:
    """A column of one row that is a list."""
    if not isinstance(values, pa.Array):
        values = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, told array<string>, ends array<long>, place array<int>, times array<int>, key array<string>, pair array<long>, docs array<long>"


def block(kept: Store, number: int, doc_ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    """One batch of documents as one row: documents, dictionary, pair counts."""
    n = len(texts)
    digest, begun = [hashlib.sha256() for _ in texts], [False] * n
    lengths, found = np.zeros(n, np.int64), []
    for at, some in entries(kept, texts):
        digest[at].update((b";" if begun[at] else b"") + b";".join(map(kept.told.__getitem__, some.tolist())))
        begun[at] = True
        lengths[at] += len(some)
        found.append(some)
    chunk = np.concatenate(found) if found else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(n), lengths)
    differs = np.bincount(doc, kept.differs.now[chunk], minlength=n) > 0
    totals = [one_list(np.where(differs, 0, np.bincount(doc, column.now[chunk], minlength=n)).astype(np.int64)) for column in (kept.n_a, kept.n_b, kept.n_groups, kept.n_links)]
    told = ["" if d or not b else h.hexdigest() for d, b, h in zip(differs.tolist(), begun, digest)]
    keep = ~differs[doc]
    # chunks, then groups of each document, with frequencies
    code, times = np.unique(doc[keep] << 32 | chunk[keep], return_counts=True)
    doc, chunk = code >> 32, code & 0xFFFFFFFF
    many = kept.n_groups.now[chunk]
    group = kept.groups.now[spread(kept.first.now[chunk], many)]
    code, at = np.unique(np.repeat(doc, many) << 32 | group, return_inverse=True)
    times = np.bincount(at, np.repeat(times, many), minlength=len(code)).astype(np.int32)
    doc, group = code >> 32, code & 0xFFFFFFFF
    many = kept.n_pairs.now[group]
    pairs = np.unique(np.repeat(doc, many) << 2 * SHIFT | kept.pairs.now[spread(kept.first_pair.now[group], many)])
    pair, docs = np.unique(pairs & MASK, return_counts=True)
    used, place = np.unique(group, return_inverse=True)
    columns = [
        pa.array([number], pa.int64()), one_list(doc_ids), *totals,
        one_list(told, pa.string()), one_list(np.searchsorted(doc, np.arange(n), "right")), one_list(place.astype(np.int32)), one_list(times),
        one_list([kept.key[g] for g in used.tolist()], pa.string()), one_list(pair), one_list(docs),
    ]
    return pa.record_batch(columns, [c.split()[0] for c in BLOCKS.split(", ")])


def blocks(spark: SparkSession, docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The documents in blocks (written)."""
    a_path, b_path = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            yield block(store(a_path, b_path), task << 32 | i, batch.column(0), as_bytes(batch.column(1)))

    return written(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS), "blocks")


def pair_counts(spark: SparkSession, made: DataFrame) -> DataFrame:
    """pair (A id, B id as one number), docs, best (1 if no other B id has a higher count with this A id); written."""
    counts = made.select(F.inline(F.arrays_zip("pair", "docs"))).groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = written(spark, counts.select("pair", "docs", F.shiftright("pair", SHIFT).alias("a")), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # at most the vocabulary's size
    return counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))


def expanded(keys: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """key, pair, times: the links of each group."""
    a_path, b_path = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = tokenizers(a_path, b_path)
        for batch in batches:
            sides = pc.split_pattern(batch.column(0), "|").flatten()
            ids, counts = [], []
            for side in (0, 1):
                told = pc.split_pattern(sides.take(pa.array(np.arange(side, len(sides), 2))), ",")
                ids.append(pc.cast(told.flatten(), pa.int64()).to_numpy(zero_copy_only=False))
                counts.append(pc.list_value_length(told).to_numpy(zero_copy_only=False))
            # the groups, one behind the other, are a text of which both lists of tokens cover the same bytes
            link_a, link_b = overlaps(np.cumsum(codes.a_length[ids[0]]), np.cumsum(codes.b_length[ids[1]]))
            owner = np.repeat(np.arange(batch.num_rows), counts[0])[link_a]
            pair = ids[0][link_a] << SHIFT | ids[1][link_b]
            order = np.lexsort((pair, owner))
            owner, pair = owner[order], pair[order]
            first = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(pair) != 0)][: len(owner)])
            times = np.diff(np.r_[first, len(owner)])
            yield pa.record_batch([batch.column(0).take(pa.array(owner[first])), pa.array(pair[first], pa.int64()), pa.array(times, pa.int64())], ["key", "pair", "times"])

    return keys.select("key").mapInArrow(run, "key string, pair long, times long")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def added_up(values: pa.Table, made: pa.Table) -> pa.Table:
    """One block's documents with the sums over their groups."""
    own = {c: made.column(c).combine_chunks().flatten() for c in made.column_names if c != "of"}
    number = lambda c: own[c].to_numpy(zero_copy_only=False)
    at = values.column("at").to_numpy()
    out = {c: own[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    ends = number("ends")
    for name in ("n_best", "count_sum"):
        of = np.zeros(len(at), np.int64)
        of[at] = values.column(name).to_numpy()
        total = np.r_[0, np.cumsum(of[number("place")] * number("times"))]
        out[name] = pa.array(np.diff(np.r_[0, total[ends]]), pa.int64())
    return pa.table(out | {"groups_sha256": own["told"]})


def aligned(spark: SparkSession, docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Tokens, groups and links of every document, and how common its links are in all documents."""
    made = blocks(spark, docs, paths)
    dictionary = made.select("block", F.posexplode("key").alias("at", "key"))
    links = expanded(dictionary.select("key").distinct(), paths).join(pair_counts(spark, made), "pair")
    values = links.groupBy("key").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    back = dictionary.join(values, "key").select("block", "at", "n_best", "count_sum")
    documents = made.select(F.col("block").alias("of"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "told", "ends", "place", "times")
    return back.groupBy("block").cogroup(documents.groupBy("of")).applyInArrow(added_up, RESULT)


def op12_group_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark, table(spark, sf_dir, "documents"))
