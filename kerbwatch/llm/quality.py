"""Operator 9: text quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from kerbwatch.llm.common import labelled_sample, scored

DIVISOR, LEFT_OUT, THRESHOLD = 5, 0, 0.3
# Bounds of what is fitted on: rows of either label, and characters of one of them.
ROWS_PER_LABEL = 1_500
FIT_CHARS = 6_000
EPOCHS = 8  # more for a small sample, until there were LEAST_STEPS steps
LEAST_STEPS = 600
BATCH = 32

STEP = 4  # bytes between two positions of a filter, which sees 2 * STEP bytes
WIDTH = 8  # numbers that stand for a byte
FILTERS = 32
HIDDEN = 16
HALF = 64  # positions in half a chunk; chunks of 512 bytes overlap by half

Net = dict[str, np.ndarray]


def new_net(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    scale = lambda *shape: rng.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)
    return {
        "bytes": rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
        "near": scale(STEP * WIDTH, FILTERS),
        "far": scale(STEP * WIDTH, FILTERS),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": scale(2 * FILTERS, HIDDEN),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": scale(HIDDEN, 1),
        "out_bias": np.zeros(1, np.float32),
    }


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text padded with zeros to whole half-chunks; half-chunks of each text."""
    size = STEP * HALF
    raw = [t.encode("utf-8", "replace") for t in texts]
    halves = np.array([max(1, -(-(len(r) + STEP) // size)) for r in raw], np.int64)
    padded = b"".join(r.ljust(int(h) * size, b"\0") for r, h in zip(raw, halves, strict=True))
    return np.frombuffer(padded, np.uint8), halves


def combined(net: Net, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and hidden layer of pooled replies."""
    hidden = np.maximum(pooled @ net["hidden"] + net["hidden_bias"], 0)
    raw = (hidden @ net["out"] + net["out_bias"])[:, 0]
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30))), hidden


def score_long(net: Net, text: str, at_once: int) -> float:
    """Probability of one text as `forward` gives it, with the replies to about `at_once` bytes held.

    Running best and sum of the chunks go from piece to piece, and so does the last half-chunk, which
    makes a chunk with the first of the next piece.
    """
    size = STEP * HALF
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    halves = max(1, -(-(len(raw) + STEP) // size))
    piece = max(1, at_once // size)
    best, total, before = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), np.empty((0, FILTERS), np.float32)
    for lo in range(0, halves, piece):
        hi = min(halves, lo + piece)
        data = np.zeros((hi - lo) * size + STEP, np.uint8)  # the block after the last is looked at too
        own = raw[lo * size : hi * size + STEP]
        data[: len(own)] = own
        blocks = net["bytes"][data].reshape(-1, STEP * WIDTH)
        reply = blocks[:-1] @ net["near"] + blocks[1:] @ net["far"] + net["filter_bias"]
        half_max = np.maximum(reply, 0).reshape(-1, HALF, FILTERS).max(axis=1)
        rows = np.concatenate((before, half_max))
        chunks = np.maximum(rows[:-1], rows[1:])
        before = rows[-1:]
        if hi == halves:
            chunks = np.concatenate((chunks, before))  # the last half stands alone
        best = np.maximum(best, chunks.max(axis=0, initial=0))
        total += chunks.sum(axis=0, dtype=np.float64)
    pooled = np.concatenate((best, (total / halves).astype(np.float32)))
    return float(combined(net, pooled[None])[0][0])


def forward(net: Net, data: np.ndarray, halves: np.ndarray) -> dict[str, np.ndarray]:
    """Probabilities of the texts and what the backward step needs.

    A filter sees a block of STEP bytes and the block after it. At least STEP zeros end a text, so
    what lies after its last block is zeros too, whatever text follows.
    """
    blocks = net["bytes"][data].reshape(-1, STEP * WIDTH)
    reply = blocks @ net["near"]
    after = blocks @ net["far"]
    none = np.tile(net["bytes"][0], STEP) @ net["far"]
    last = np.cumsum(halves) * HALF - 1
    reply[:-1] += after[1:]
    reply[last[:-1]] += none - after[last[:-1] + 1]
    reply[-1] += none
    reply += net["filter_bias"]
    np.maximum(reply, 0, out=reply)
    # Largest reply of each half-chunk, then of each chunk of two neighbouring halves.
    half_max = reply.reshape(-1, HALF, FILTERS).max(axis=1)
    ends = np.cumsum(halves)
    starts = ends - halves
    chunk_max = half_max.copy()
    chunk_max[:-1] = np.maximum(half_max[:-1], half_max[1:])
    chunk_max[ends - 1] = half_max[ends - 1]  # the last half stands alone
    top = np.maximum.reduceat(chunk_max, starts, axis=0)
    mean = np.add.reduceat(chunk_max, starts, axis=0) / halves[:, None].astype(np.float32)
    pooled = np.concatenate((top, mean), axis=1)
    p, hidden = combined(net, pooled)
    return {
        "p": p, "hidden": hidden, "pooled": pooled,
        "reply": reply, "half_max": half_max, "chunk_max": chunk_max, "blocks": blocks,
        "starts": starts, "ends": ends,
    }


def gradients(net: Net, data: np.ndarray, halves: np.ndarray, y: np.ndarray) -> Net:
    """Gradients of the mean log loss; a maximum passes its gradient to the places that attain it."""
    f = forward(net, data, halves)
    n = len(y)
    d_raw = ((f["p"] - y) / n)[:, None].astype(np.float32)
    out = {"out": f["hidden"].T @ d_raw, "out_bias": d_raw.sum(0)}
    d_hidden = (d_raw @ net["out"].T) * (f["hidden"] > 0)
    out |= {"hidden": f["pooled"].T @ d_hidden, "hidden_bias": d_hidden.sum(0)}
    d_pooled = d_hidden @ net["hidden"].T
    owner = np.repeat(np.arange(n), halves)
    d_top, d_mean = d_pooled[:, :FILTERS], d_pooled[:, FILTERS:]
    is_top = f["chunk_max"] == f["pooled"][owner, :FILTERS]
    ties = np.add.reduceat(is_top.astype(np.float32), f["starts"], axis=0)
    d_chunk = is_top * (d_top / ties)[owner] + (d_mean / halves[:, None].astype(np.float32))[owner]
    own = f["half_max"] >= f["chunk_max"]
    d_half = d_chunk * own
    d_half[1:] += (d_chunk * ~own)[:-1]
    reply = f["reply"].reshape(-1, HALF, FILTERS)
    at = reply.argmax(axis=1)
    d_reply = np.zeros_like(reply)
    np.put_along_axis(d_reply, at[:, None, :], (d_half * (f["half_max"] > 0))[:, None, :], axis=1)
    d_reply = d_reply.reshape(-1, FILTERS)
    out["filter_bias"] = d_reply.sum(0)
    out["near"] = f["blocks"].T @ d_reply
    d_after = np.zeros_like(d_reply)
    d_after[1:] = d_reply[:-1]
    d_after[f["starts"][1:] * HALF] = 0
    out["far"] = f["blocks"].T @ d_after
    ends_at = f["ends"] * HALF - 1
    d_none = d_reply[ends_at].sum(0)
    none = np.tile(net["bytes"][0], STEP)
    out["far"] += np.outer(none, d_none)
    d_blocks = (d_reply @ net["near"].T + d_after @ net["far"].T).reshape(-1, WIDTH)
    d_bytes = np.stack([np.bincount(data, d_blocks[:, k], 256) for k in range(WIDTH)], axis=1)
    d_bytes[0] += (net["far"] @ d_none).reshape(STEP, WIDTH).sum(0)
    out["bytes"] = d_bytes.astype(np.float32)
    return out


def fit(rows: list[tuple[str, object]], epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam on batches of texts of like length; labels weigh as they occur among the rows."""
    net = new_net(seed)
    labels = np.array([float(y) for _, y in rows], np.float32)
    if len(set(labels.tolist())) < 2:  # nothing to tell apart: a constant
        prior = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-3), 1 - 1e-3)
        net["out"][:] = 0
        net["out_bias"][:] = np.log(prior / (1 - prior))
        return net
    texts = [t for t, _ in rows]
    rng = np.random.default_rng(seed)
    order = np.argsort([len(t) for t in texts], kind="stable")
    parts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    ready = [(*laid_out([texts[k] for k in part]), labels[part]) for part in parts]
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    epochs = max(epochs, -(-LEAST_STEPS // len(ready)))
    steps, total = 0, epochs * len(ready)
    for _ in range(epochs):
        for i in rng.permutation(len(ready)):
            steps += 1
            rate = 4e-3 * (1 - steps / (total + 1))
            for k, g in gradients(net, *ready[i]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                unbiased = first[k] / (1 - 0.9**steps)
                net[k] -= (rate * unbiased / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return net


def score_texts(net: Net, texts: list[str], at_once: int = 1 << 19) -> np.ndarray:
    """Probability of each text, whole texts, about `at_once` bytes at a time; longer texts in pieces."""
    order = np.argsort([len(t) for t in texts], kind="stable")
    out = np.empty(len(texts))
    lo, held = 0, 0
    for i in range(len(order) + 1):
        if i == len(order) or held and held + len(texts[order[i]]) > at_once:
            some = order[lo:i]
            if len(some) == 1 and held > at_once:
                out[some] = score_long(net, texts[some[0]], at_once)
            elif len(some):
                out[some] = forward(net, *laid_out([texts[k] for k in some]))["p"]
            lo, held = i, 0
        if i < len(order):
            held += len(texts[order[i]]) + STEP * HALF
    return out


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of `docs`.

    The network is fitted on the driver on a bounded sample of labelled rows and shipped with the
    task (15 kB). Every text is scored whole, as overlapping chunks of 512 bytes: filters over 8 bytes
    every 4, largest reply per chunk, best and mean chunk of the text, one hidden layer. Null and
    empty texts are scored as no bytes; repeated rows stay; an empty table gives an empty table; a
    null key counts as the key of no digits; other columns are not read.
    """
    net = fit(labelled_sample(docs, labels, "quality", DIVISOR, LEFT_OUT, ROWS_PER_LABEL, FIT_CHARS))

    def make() -> Callable[[list[str]], np.ndarray]:
        return lambda texts: score_texts(net, texts)

    return scored(docs, DIVISOR, LEFT_OUT, make, threshold)
