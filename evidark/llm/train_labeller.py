"""Fits the block labeller on made-up pages and stores its weights: ``python -m evidark.llm.train_labeller``."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from evidark.llm.blocks import Block, leaf_blocks
from evidark.llm.extraction import WEIGHTS, Features, Labeller, features
from evidark.llm.page_samples import Maker

PAGES, PASSES, BATCH, RATE, SEED = 6000, 10, 24, 0.012, 20
KEEP, DROP = "\ue001", "\ue000"


def sample(maker: Maker) -> tuple[list[Block], np.ndarray]:
    """A made-up page's blocks and labels: marks in its texts tell which are main text."""
    page = "".join(part if keep is None else (KEEP if keep else DROP) + part for part, keep in maker.page())
    blocks, labels = leaf_blocks(page), []
    for b in blocks:
        labels.append(KEEP in b.text)
        b.text = b.text.replace(KEEP, "").replace(DROP, "") or "."
    return blocks, np.array(labels, np.float32)


def fit(data: list[tuple[Features, np.ndarray]], passes: int = PASSES, seed: int = SEED) -> Labeller:
    """Adam on the cross-entropy of blocks, gradients clipped to unit length, the rate sinking in a line."""
    rng, model = np.random.default_rng(seed), Labeller()
    params = model.params()
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = passes * -(-len(data) // BATCH)
    for _ in range(passes):
        # pages of about one length share a batch; batches come in random order
        order = sorted(range(len(data)), key=lambda i: len(data[i][1]) + rng.random() * 8)
        batches = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
        for n in rng.permutation(len(batches)):
            grads = model.step([data[i][0] for i in batches[n]], [data[i][1] for i in batches[n]])
            t += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for k, g in enumerate(grads):
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= RATE * (1 - 0.95 * t / total) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + 1e-5 * params[k]
    return model


def made_up(pages: int, seed: int) -> list[tuple[Features, np.ndarray]]:
    maker = Maker(seed)
    return [(features(b), l) for b, l in (sample(maker) for _ in range(pages)) if b]


def main() -> None:
    model = fit(made_up(PAGES, SEED))
    to = Path(__file__).with_name(WEIGHTS)
    np.savez_compressed(to, **{f"p{n}": p.astype(np.float16) for n, p in enumerate(model.params())})
    right = [(int(((s > 0) == (l > 0)).sum()), len(l)) for f, l in made_up(500, SEED + 1) for s in model.scores([f])]
    print(f"{to}: {sum(r for r, _ in right) / sum(n for _, n in right):.4f} of the blocks and {sum(r == n for r, n in right) / len(right):.4f} of 500 unseen pages right")


if __name__ == "__main__":
    main()
