"""Main text of web pages by a recurrent block labeller.

A page is read as its sequence of leaf blocks. Each block becomes a vector: a hashed bag of its tag path (tags, tag
pairs, words of class, id and role), a hashed bag of its words, and its length, share of links and place. A
bidirectional LSTM in numpy reads the whole sequence, so every block is judged with all others in view, and blocks
labelled main text are joined in page order.

The labeller is trained on made-up pages whose main text is known (``page_samples``), a fixed number from a fixed seed, so
it depends on no table; ``train_labeller`` does it and stores the weights in this package, so no query pays for it. All of
every page is read; no block is cut or dropped but by its label. Elements share their ancestors' path and long pages are
labelled in steps with carried state, so time grows with the page alone and memory with little beside its text.

Null or empty html gives an empty text. Rows are read one by one, so repeated rows, null ids and urls are kept. An
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cache
from importlib.resources import files
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidark.llm.blocks import PATHS, Block, leaf_blocks, path_bit
from evidark.llm.common import as_bytes, table

WORDS, NUMBERS = 64, 7
WIDTH = PATHS + WORDS + NUMBERS
HIDDEN = 24
#: Blocks of one page whose vectors are opened at a time, and pages and blocks that are labelled together.
STEPS, TOGETHER, BLOCKS = 1024, 128, 6000


@dataclass
class Features:
    """A page's blocks: bits of the path packed eight to a byte, and the other inputs as half-precision numbers."""

    path: np.ndarray
    rest: np.ndarray

    def __len__(self) -> int:
        return len(self.path)

    def opened(self, at: int = 0, to: int | None = None) -> np.ndarray:
        """Vectors of blocks ``at`` to ``to``, one row each."""
        bits = np.unpackbits(self.path[at:to], axis=1, bitorder="little")
        return np.concatenate([bits, self.rest[at:to]], 1, dtype=np.float32)


def features(blocks: list[Block]) -> Features:
    packed = b"".join([(b.leaf.bits | path_bit("l:" + b.leaf.tag) if b.leaf else 0).to_bytes(PATHS // 8, "little") for b in blocks])
    rest = np.zeros((len(blocks), WORDS + NUMBERS), np.float16)
    for i, b in enumerate(blocks):
        words = b.text.lower().split()
        size = len(b.text)
        rest[i, :WORDS] = np.bincount([zlib.crc32(w.encode("utf-8", "replace")) % WORDS for w in words], minlength=WORDS) / len(words)
        depth = b.leaf.depth if b.leaf else 0
        rest[i, WORDS:] = (min(1.5, np.log1p(size) / 5), min(1.5, np.log1p(len(words)) / 4), b.linked / size, size < 25, b.text[-1] in ".!?:;…", min(6.0, depth / 10), i / len(blocks))
    return Features(np.frombuffer(packed, np.uint8).reshape(len(blocks), PATHS // 8), rest)


class Lstm:
    """One direction; the gates are input, forget, output and candidate."""

    def __init__(self, rng: np.random.Generator):
        self.wx = (rng.normal(size=(WIDTH, 4 * HIDDEN)) * 0.1).astype(np.float32)
        self.wh = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b]

    def forward(self, x: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = False):
        """x: steps, pages, WIDTH; mask: steps, pages (0 beyond a page's end, where the state stands still)."""
        steps, pages, _ = x.shape
        given = x @ self.wx + self.b
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            z = given[t] + h @ self.wh
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            th = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                tape.append((h, c, i, f, o, g, th, m))
            h, c = m * o * th + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, tape, (h, c)

    def backward(self, x: np.ndarray, tape: list, dout: np.ndarray) -> list[np.ndarray]:
        steps, pages, _ = x.shape
        dz = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
        dh, dc, dwh = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), np.zeros_like(self.wh)
        for t in reversed(range(steps)):
            h, c, i, f, o, g, th, m = tape[t]
            dh = dh + dout[t]
            dhm, dcm = dh * m, dc * m
            dn = dcm + dhm * o * (1 - th * th)
            dz[t] = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), dhm * th * o * (1 - o), dn * i * (1 - g * g)], 1)
            dwh += h.T @ dz[t]
            dh = dz[t] @ self.wh.T + dh * (1 - m)
            dc = dn * f + dc * (1 - m)
        flat = dz.reshape(-1, dz.shape[2])
        return [x.reshape(-1, WIDTH).T @ flat, dwh, flat.sum(0)]


class Labeller:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.out = (rng.normal(size=2 * HIDDEN) * 0.3).astype(np.float32)
        self.straight = np.zeros(WIDTH, np.float32)  # from the block itself
        self.bias = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.ahead.params(), *self.back.params(), self.out, self.straight, self.bias]

    @staticmethod
    def batch(pages: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors padded to ``steps``, and the mask."""
        x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def taped(self, pages: list[Features]):
        """Scores with all that ``step`` needs."""
        opened, steps = [p.opened() for p in pages], max(map(len, pages))
        x, mask = self.batch(opened, steps)
        r, _ = self.batch([p[::-1] for p in opened], steps)
        a, a_tape, _ = self.ahead.forward(x, mask, keep=True)
        b, b_tape, _ = self.back.forward(r, mask, keep=True)
        turned = np.zeros_like(b)
        for k, p in enumerate(pages):
            turned[: len(p), k] = b[: len(p), k][::-1]
        s = a @ self.out[:HIDDEN] + turned @ self.out[HIDDEN:] + x @ self.straight + self.bias
        return s, mask, x, r, a, a_tape, turned, b_tape

    def scores(self, pages: list[Features]) -> list[np.ndarray]:
        """A score for each block, above 0 for main text. Both directions run over ``STEPS`` blocks at a time, their state
        carried on, so memory beside ``pages`` does not grow with a page's length."""
        out = [np.full(len(p), self.bias[0], np.float32) for p in pages]
        for lstm, own, straight, turn in ((self.ahead, self.out[:HIDDEN], self.straight, 1), (self.back, self.out[HIDDEN:], None, -1)):
            state = None
            for at in range(0, max(map(len, pages)), STEPS):
                bounds = [(min(at, len(p)), min(at + STEPS, len(p))) for p in pages]
                spans = [(a, b) if turn > 0 else (len(p) - b, len(p) - a) for p, (a, b) in zip(pages, bounds)]
                x, mask = self.batch([p.opened(a, b)[::turn] for p, (a, b) in zip(pages, spans)], max(b - a for a, b in spans))
                h, _, state = lstm.forward(x, mask, state)
                s = h @ own if straight is None else h @ own + x @ straight
                for k, (a, b) in enumerate(spans):
                    out[k][a:b] += s[: b - a, k][::turn]
        return out

    def step(self, pages: list[Features], labels: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy."""
        s, mask, x, r, a, a_tape, turned, b_tape = self.taped(pages)
        y = np.zeros_like(s)
        for k, l in enumerate(labels):
            y[: len(l), k] = l
        ds = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * mask / mask.sum()).astype(np.float32)
        dback = np.zeros_like(turned)
        dturned = ds[:, :, None] * self.out[HIDDEN:]
        for k, p in enumerate(pages):
            dback[: len(p), k] = dturned[: len(p), k][::-1]
        own = [np.concatenate([(ds[:, :, None] * a).sum((0, 1)), (ds[:, :, None] * turned).sum((0, 1))]), ds.ravel() @ x.reshape(-1, WIDTH), np.array([ds.sum()], np.float32)]
        return [*self.ahead.backward(x, a_tape, ds[:, :, None] * self.out[:HIDDEN]), *self.back.backward(r, b_tape, dback), *own]

    def keep(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Which blocks are main text. Pages of like length are read together."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            most = max(1, min(TOGETHER, BLOCKS // len(pages[order[min(at + TOGETHER, len(order)) - 1]])))
            some = order[at : at + most]
            for i, s in zip(some, self.scores([features(pages[i]) for i in some])):
                out[i] = (s > 0).tolist()
            at += most
        return out


WEIGHTS = "labeller.npz"


@cache
def trained() -> Labeller:
    """The labeller with the weights that ``python -m evidark.llm.train_labeller`` has fitted."""
    model = Labeller()
    with np.load(BytesIO(files("evidark.llm").joinpath(WEIGHTS).read_bytes())) as stored:
        for n, p in enumerate(model.params()):
            p[:] = stored[f"p{n}"]
    return model


SURROGATES = re.compile("[\ud800-\udfff]")


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    out = []
    for at in range(0, len(pages), 2 * TOGETHER):
        blocks = [leaf_blocks(p) for p in pages[at : at + 2 * TOGETHER]]
        out += ["\n".join(b.text for b, k in zip(p, kept) if k) for p, kept in zip(blocks, model.keep(blocks))]
    return [SURROGATES.sub("\ufffd", t) for t in out]


def extractor(spark: SparkSession):
    shared = spark.sparkContext.broadcast(trained())

    @F.arrow_udf(T.StringType())
    def extract(html: pa.Array) -> pa.Array:
        return pa.array(main_texts(shared.value, [(h or b"").decode() for h in as_bytes(html)]), pa.string())

    return lambda html: extract(html.cast("string"))


def op4_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extractor(spark)(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
