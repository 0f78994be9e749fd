"""Toxicity scores of whole texts from a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors side by side: the embedding of its hash and the mean embedding of its character n-grams'
hashes. Two gated recurrent networks read a window of words from both ends, an attention layer weighs the states, and
a logistic layer scores the weighted sum. A text is cut into overlapping windows, all of them are scored, and the
highest counts. Only texts have labels, so training picks the window that stands for a toxic text: at first the one
with most words that set toxic texts apart, by themselves or by an n-gram, later the one that the network itself scores
highest. Words and n-grams that few training texts hold have no vector of their own, as unknown ones have none later.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.language import bag_of_words
from logsieve.llm.texts import fold, longest_within, shipped, slices

WINDOW, STEP = 48, 32       # words; neighbours overlap by a third
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 14
NGRAMS = (3, 5)
APART = 4.0                 # standard errors from which a word or n-gram sets texts apart
WIDTH, STATE, ATTENTION = 8, 8, 8
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_000, 2_000      # labelled texts that are fitted, about
SAMPLE_BYTES = 1 << 26     # that the fitted texts have together, at most; the longest are left out where they pass it
WINDOWS_PER_TEXT = 4        # of a clean text that an epoch draws
EPOCHS, LEAST_STEPS = 8, 300
BLOCK_TEXTS = 200           # whose n-grams are counted at once
KNOWN_TEXTS = 3             # training texts that must hold a word for it to be known
FORGET = 0.1                # share of known words that a training step treats as unknown
DECAY = 0.02                # pull of all weights to zero, per unit of learning rate
PREDICT_AT = 0.7


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * np.uint64(0x100000001B3)
    return h ^ (h >> np.uint64(29))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, n-gram hashes word by word, where each word's n-grams end); bucket 0 is for what is unknown."""
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(m) for m in marked], np.int64)
    ends = np.cumsum(lengths)
    whole = np.full(len(words), 0xCBF29CE484222325, np.uint64)
    for j in range(int(lengths.max()) if len(words) else 0):
        has = lengths > j
        whole[has] = _mix(whole[has], chars[(ends - lengths)[has] + j])
    owner, left = np.repeat(np.arange(len(words)), lengths), np.repeat(ends, lengths) - np.arange(len(chars))
    owners, hashes = [], []
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), 0x9E3779B97F4A7C15 + n, np.uint64)
        for j in range(n):
            h = _mix(h, chars[at + j])
        owners.append(owner[at])
        hashes.append(h)
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return ((whole % np.uint64(WORD_BUCKETS - 1)).astype(np.int64) + 1, (h[order] % np.uint64(CHAR_BUCKETS - 1)).astype(np.int64) + 1,
            np.cumsum(np.bincount(owner, minlength=len(words))))


def windows_of(number: np.ndarray, text: np.ndarray, texts: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers of each window, padded with `pad`; its length; its text): every word is in a window."""
    sizes = np.bincount(text, minlength=texts)
    firsts = np.cumsum(sizes) - sizes
    n = np.where(sizes > 0, 1 + -(-np.maximum(sizes - WINDOW, 0) // STEP), 0)
    of = np.repeat(np.arange(texts), n)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    length = np.minimum(sizes[of] - start, WINDOW)
    place = np.arange(WINDOW)
    at = np.where(place < length[:, None], (firsts[of] + start)[:, None] + place, len(number))
    return np.append(number, pad)[at], length, of


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and both passes; `p` maps names to arrays, `known` and `known_grams` mark the hashes of known words and n-grams."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, s = 2 * WIDTH, STATE
        self.known, self.known_grams = np.ones(WORD_BUCKETS, bool), np.ones(CHAR_BUCKETS, bool)

        def start(*shape, scale=None):
            return rng.normal(0, scale or shape[0] ** -0.5, shape).astype(np.float32)

        self.p = {"words": start(WORD_BUCKETS, WIDTH, scale=0.1), "chars": start(CHAR_BUCKETS, WIDTH, scale=0.1),
                  "attend": start(2 * s, ATTENTION), "attend_bias": np.zeros(ATTENTION, np.float32), "look": start(ATTENTION, scale=0.3),
                  "out": start(2 * s, scale=0.3), "out_bias": np.full(1, -1, np.float32)}
        for way in ("ahead", "back"):
            self.p |= {f"{way}_in": start(d, 3 * s), f"{way}_bias": np.zeros(3 * s, np.float32), f"{way}_state": start(s, 3 * s)}

    def inputs(self, words: list[str], forget: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """The input vector of each word, a zero row for padding after them, and what the way back needs."""
        whole, grams, ends = word_features(words)
        whole = np.where(self.known[whole] if forget is None else self.known[whole] & ~forget, whole, 0)
        grams = np.where(self.known_grams[grams], grams, 0)
        starts = np.concatenate([[0], ends[:-1]])
        mean = np.add.reduceat(self.p["chars"][grams], starts, axis=0) / (ends - starts)[:, None]
        x = np.concatenate([self.p["words"][whole], mean], axis=1)
        return np.concatenate([x, np.zeros((1, 2 * WIDTH))]).astype(np.float32), (whole, grams, starts, ends)

    def _run(self, way: str, gates: np.ndarray, codes: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each word: (windows, words, STATE). The way back starts afresh at the last real word."""
        u, s = self.p[f"{way}_state"], STATE
        h = np.zeros((len(codes), s), np.float32)
        out = np.empty((codes.shape[1], len(codes), s), np.float32)
        for t in range(codes.shape[1]) if way == "ahead" else range(codes.shape[1] - 1, -1, -1):
            g, uh = gates[codes[:, t]], h @ u
            zr = sigmoid(g[:, :2 * s] + uh[:, :2 * s])
            z, r = zr[:, :s], zr[:, s:]
            n = np.tanh(g[:, 2 * s:] + r * uh[:, 2 * s:])
            new = n + z * (h - n)
            if way == "back":
                new *= mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, n, uh[:, 2 * s:]))
            out[t] = h = new
        return out

    def forward(self, x: np.ndarray, codes: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        p, mask = self.p, np.arange(codes.shape[1]) < length[:, None]
        steps: dict = {"ahead": [] if keep is not None else None, "back": [] if keep is not None else None}
        both = np.concatenate([
            self._run(way, x @ p[f"{way}_in"] + p[f"{way}_bias"], codes, mask, steps[way]) for way in ("ahead", "back")], axis=2)
        seen = np.tanh(both @ p["attend"] + p["attend_bias"])               # (words, windows, ATTENTION)
        e = np.where(mask.T, seen @ p["look"], -np.inf)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * both).sum(axis=0)
        if keep is not None:
            keep |= {"steps": steps, "both": both, "seen": seen, "a": a, "pooled": pooled, "mask": mask}
        return pooled @ p["out"] + p["out_bias"][0]

    def gradients(self, words: list[str], codes: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray,
                  forget: np.ndarray | None = None) -> tuple[dict, float]:
        """Gradients of the weighted mean log loss, and the loss."""
        p, s, keep = self.p, STATE, {}
        x, (whole, grams, starts, ends) = self.inputs(words, forget)
        logit = self.forward(x, codes, length, keep)
        q = sigmoid(logit)
        loss = float(-(weight * np.log(np.where(y > 0, q, 1 - q) + 1e-9)).sum())
        d = (weight * (q - y)).astype(np.float32)
        both, seen, a, mask = keep["both"], keep["seen"], keep["a"], keep["mask"]
        g = {"out": keep["pooled"].T @ d, "out_bias": d.sum(keepdims=True)}
        dpool = d[:, None] * p["out"]
        da = (both * dpool).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        g["look"] = np.tensordot(de, seen, 2)
        dseen = de[:, :, None] * p["look"] * (1 - seen * seen)
        g["attend"], g["attend_bias"] = np.tensordot(both, dseen, ([0, 1], [0, 1])), dseen.sum(axis=(0, 1))
        dboth = a[:, :, None] * dpool + dseen @ p["attend"].T
        dx = np.zeros_like(x)
        for k, way in enumerate(("ahead", "back")):
            u = p[f"{way}_state"]
            du, dh = np.zeros_like(u), np.zeros((len(codes), s), np.float32)
            dgates = np.empty((codes.shape[1], len(codes), 3 * s), np.float32)
            for t, h, z, r, n, un in reversed(keep["steps"][way]):
                dh = dh + dboth[t][:, k * s:(k + 1) * s]
                if way == "back":
                    dh = dh * mask[:, t, None]
                dn = dh * (1 - z) * (1 - n * n)
                dz, dr = dh * (h - n) * z * (1 - z), dn * un * r * (1 - r)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                duh = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ duh
                dh = dh * z + duh @ u.T
            flat = codes.T.ravel()
            order = np.argsort(flat, kind="stable")
            used, at = np.unique(flat[order], return_index=True)
            per_word = np.zeros((len(x), 3 * s), np.float32)
            per_word[used] = np.add.reduceat(dgates.reshape(-1, 3 * s)[order], at, axis=0)
            g[f"{way}_state"], g[f"{way}_bias"], g[f"{way}_in"] = du, per_word.sum(axis=0), x.T @ per_word
            dx += per_word @ p[f"{way}_in"].T
        dx = dx[:-1]
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], whole, dx[:, :WIDTH])
        np.add.at(g["chars"], grams, np.repeat(dx[:, WIDTH:] / (ends - starts)[:, None], ends - starts, axis=0))
        return g, loss


@dataclass
class Model:
    network: Network
    slope: float = 1.0          # of the highest logit, calibrated on held-back texts
    shift: float = 0.0

    def highest(self, texts: pa.Array) -> np.ndarray:
        """The highest logit of each text's windows; -inf without words."""
        words, number, text = bag_of_words(texts)
        out = np.full(len(texts), -np.inf)
        if words:
            x, _ = self.network.inputs(words)
            codes, length, of = windows_of(number, text, len(texts), len(words))
            for a in range(0, len(codes), 1024):
                np.maximum.at(out, of[a:a + 1024], self.network.forward(x, codes[a:a + 1024], length[a:a + 1024]))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = self.highest(texts)
        return np.where(np.isfinite(z), sigmoid(self.slope * np.where(np.isfinite(z), z, 0.0) + self.shift), 0.0)


def holders(bucket: np.ndarray, text: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    """(texts that hold each bucket, toxic ones among them)."""
    pairs = np.unique(bucket * len(y) + text)
    bucket, of = pairs // len(y), pairs % len(y)
    return np.stack([np.bincount(bucket, minlength=buckets), np.bincount(bucket, y[of], buckets)])


def apart(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far each bucket's share of toxic texts is from that of clean ones, in standard errors; 0 if few texts hold it."""
    (held, bad), n_bad, n_good = counts, y.sum(), len(y) - y.sum()
    share = held / len(y)
    error = np.sqrt(share * (1 - share) * (1 / n_bad + 1 / n_good)) + 1e-9
    return np.where(held >= KNOWN_TEXTS, (bad / n_bad - (held - bad) / n_good) / error, 0.0)


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 11, rate: float = 0.01, batch: int = 128) -> Model:
    """Trains on four fifths of the texts, calibrates on the rest."""
    rng = np.random.default_rng(seed)
    y, column = np.array(toxic, np.float32), pa.array(texts, pa.large_string())
    model = Model(Network())
    words, number, text = bag_of_words(column)
    if not words or y.min() == y.max():
        model.slope, model.shift = 0.0, 9.0 if len(y) and y.min() == 1 else -9.0
        return model
    held = rng.random(len(texts)) < 0.2
    whole, grams, ends = word_features(words)
    mine = ~held[text]
    renumber = np.cumsum(~held) - 1
    n, at = number[mine], renumber[text[mine]]
    by_word = holders(whole[n], at, y[~held], WORD_BUCKETS)
    counts = np.diff(ends, prepend=0)
    by_gram = np.zeros((2, CHAR_BUCKETS))
    edges = np.searchsorted(at, np.arange(0, int(at.max()) + 1 + BLOCK_TEXTS, BLOCK_TEXTS)) if len(at) else [0]
    for a, b in zip(edges[:-1], edges[1:]):         # some texts at a time: their n-grams are many
        pair = np.unique(n[a:b] * len(y) + at[a:b])
        word, t = pair // len(y), pair % len(y)
        places = np.repeat(ends[word] - np.cumsum(counts[word]), counts[word]) + np.arange(counts[word].sum())
        by_gram += holders(grams[places], np.repeat(t, counts[word]), y[~held], CHAR_BUCKETS)
    model.network.known, model.network.known_grams = by_word[0] >= KNOWN_TEXTS, by_gram[0] >= KNOWN_TEXTS
    by_word, by_gram = apart(by_word, y[~held]), apart(by_gram, y[~held])
    # the first number of a vector starts as what its word or n-gram alone tells
    model.network.p["words"][:, 0] = np.clip(by_word / APART, -1, 3)
    model.network.p["chars"][:, 0] = np.clip(by_gram / APART, -1, 3)
    distance = np.maximum(by_word[whole], np.maximum.reduceat(by_gram[grams], ends - counts))
    codes, length, of = windows_of(number, text, len(texts), len(words))
    score = np.append(np.maximum(distance - APART, 0), 0)[codes].sum(axis=1)
    mean = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.network.p.items()}
    windows = int(np.minimum(np.bincount(of[~held[of]]), WINDOWS_PER_TEXT).sum())
    epochs = max(epochs, -(-LEAST_STEPS * batch // max(1, windows)))
    done = 0
    for epoch in range(epochs):
        # an epoch takes the highest window of a toxic text, and any few of a clean one
        rank = np.where(y[of] > 0, -score, rng.random(len(codes)))
        order = np.lexsort((rank, of))
        nth = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        chosen = order[(nth < np.where(y[of[order]] > 0, 1, WINDOWS_PER_TEXT)) & ~held[of[order]]]
        rng.shuffle(chosen)
        share = max(float(y[of[chosen]].mean()), 1e-6)
        for a in range(0, len(chosen), batch):
            rows = chosen[a:a + batch]
            own, local = np.unique(codes[rows], return_inverse=True)
            own = own[own < len(words)]
            label = y[of[rows]]
            weight = np.where(label > 0, 0.4 / share, 0.6 / max(1 - share, 1e-6)) / len(rows)
            grads, _ = model.network.gradients([words[i] for i in own], local.reshape(len(rows), -1), length[rows], label, weight, rng.random(len(own)) < FORGET)
            done += 1
            step = rate * (1 - epoch / epochs)
            for k, g in grads.items():                                      # Adam, with decay
                m, v = mean[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.network.p[k] -= step * ((m / (1 - 0.9 ** done)) / (np.sqrt(v / (1 - 0.99 ** done)) + 1e-7) + DECAY * model.network.p[k])
        if epoch >= epochs // 2:
            x, _ = model.network.inputs(words)
            positive = np.flatnonzero((y[of] > 0) & ~held[of])
            for a in range(0, len(positive), 1024):
                at = positive[a:a + 1024]
                score[at] = model.network.forward(x, codes[at], length[at])
    return calibrate(model, pa.array([t for t, h in zip(texts, held) if h], pa.large_string()), y[held])


def calibrate(model: Model, texts: pa.Array, y: np.ndarray) -> Model:
    """Slope and shift of least log loss on held-back texts; the shift makes the mean score the share of toxic texts."""
    z = model.highest(texts)
    y, z = y[np.isfinite(z)], z[np.isfinite(z)]
    if not len(y) or y.min() == y.max():
        return model
    best = np.inf
    for slope in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
        low, high = -60.0, 60.0
        for _ in range(50):
            shift = (low + high) / 2
            low, high = (shift, high) if sigmoid(slope * z + shift).mean() < y.mean() else (low, shift)
        q = np.clip(sigmoid(slope * z + shift), 1e-6, 1 - 1e-6)
        loss = -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()
        if loss < best:
            best, model.slope, model.shift = loss, slope, shift
    return model


def sample_of(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """About `SAMPLE_TOXIC` toxic and `SAMPLE_CLEAN` clean texts, whole, chosen by a hash of their id; `SAMPLE_BYTES` at most."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select(F.col("doc_id").alias("labelled"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.when(F.col("toxic") == 1, F.lit(SAMPLE_TOXIC / max(1, counts.get(1, 0)))).otherwise(F.lit(SAMPLE_CLEAN / max(1, counts.get(0, 0))))
    drawn = F.pmod(F.xxhash64("labelled", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter(drawn < chance)           # a few thousand rows, by the two constants
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "toxic")
    longest = longest_within(found, "text", SAMPLE_BYTES)
    rows = found.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text or ""))
    return [r.text or "" for r in rows], [r.toxic for r in rows]


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each whole text: the calibrated probability of its worst window.

    Words are runs of letters in lower case; a null text and one without letters score 0. Every row gives a row, equal
    or null ids included, and equal texts equal scores. Only doc_id and text are read, so extra columns cannot clash;
    an empty table gives no rows. A model fitted without labels of both kinds gives every text the same score.
    """
    sent = shipped(docs.sparkSession, model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent()
        for batch in slices(batches, bytes_each=4_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fitted.scores(batch.column("text")), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {id_type}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt from labels of rows whose id's crc32 modulo 3 is not 1."""
    learnt = labels.filter(fold(F.col("doc_id"), 3) != 1)
    model = fit(*sample_of(docs, learnt))
    return score_texts(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
