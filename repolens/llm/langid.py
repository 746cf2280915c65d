"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers, one forward and one backward, read a text; a softmax on both states labels every
byte position, and a document's probabilities are the mean over all of its positions. A text is read in
windows of `SPAN` bytes, cut before a character, with `MARGIN` bytes more on both sides: the state so
carries over words and over the cuts, and every position counts once, in the window it belongs to.

Training is numpy back-propagation through time on windows of a bounded sample of labelled rows. A share
of them is made noise, as a label of its own: the bytes of a window in another order, and random bytes
and letters. A text whose letters are noise with a probability above `NOISE` is in no language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

#: Bytes of a window that count, and of context on each side.
SPAN, MARGIN = 240, 16
#: Windows read at once.
AT_ONCE = 1024
#: No language: null text, or no letter.
UNDETERMINED = "und"

#: Mean probability of noise over a text's letters from which it is in no language.
NOISE = 0.95

_LETTER = K.table(bytes(range(65, 91)) + bytes(range(97, 123)))
_LETTERED = _LETTER | K.table(bytes(range(128, 256)))


@dataclass(frozen=True)
class Config:
    """rows: labelled rows of each language that training may read (its only bound on data); windows:
    drawn from them for each epoch, of up to `span` bytes; noise: the share of windows made noise."""

    hidden: int = 8
    embed: int = 12
    rows: int = 250
    windows: int = 6_000
    span: int = 64
    noise: float = 0.25
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    seed: int = 1


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the windows of all texts, and the number of each text's first window."""
    size = np.diff(offsets)
    count = -(-size // SPAN)
    at = K.bounds(count)
    starts = np.repeat(offsets[:-1], count) + SPAN * (np.arange(at[-1]) - np.repeat(at[:-1], count))
    ends = np.minimum(starts + SPAN, np.repeat(offsets[1:], count))
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    for cuts in (starts, ends):
        for _ in range(3):  # a character has up to three bytes after its first
            cuts += (padded[cuts] & 0xC0) == 0x80
    return starts, ends, at


def steps_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(steps, windows) bytes from each start to its end, padded with spaces."""
    size = ends - starts
    out = np.full((int(size.max(initial=1)), len(starts)), 32, np.uint8)
    where = np.arange(len(out))[:, None]
    np.copyto(out, data[np.minimum(starts + where, max(0, len(data) - 1))], where=where < size)
    return out


def noisy(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows (steps, windows) as noise: three in five shuffled, the others random bytes or letters."""
    kind = rng.random(x.shape[1])
    letters = np.where(rng.random(x.shape) < 0.15, 32, rng.integers(97, 123, x.shape))
    made = np.where(kind < 0.8, rng.integers(0x21, 256, x.shape), letters).astype(np.uint8)
    return np.where(kind < 0.6, rng.permuted(x, axis=0), made)


class Network:
    """Weights: E (256, embed); per direction W (embed, 3h), U (h, 3h), b (3h): update, reset, new;
    V (2h, labels and noise), c."""

    def __init__(self, labels: list[str], config: Config, rng: np.random.Generator | None = None) -> None:
        self.labels, self.h = labels, config.hidden
        rng = rng or np.random.default_rng(config.seed)
        h, e, f4 = config.hidden, config.embed, np.float32
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(f4)
        self.w = {"E": draw(256, e) * f4(np.sqrt(256) * 0.3), "V": draw(2 * h, len(labels) + 1), "c": np.zeros(len(labels) + 1, f4)}
        for d in "fb":
            self.w |= {f"W{d}": draw(e, 3 * h), f"U{d}": draw(h, 3 * h), f"b{d}": np.zeros(3 * h, f4)}

    def _pass(self, x: np.ndarray, inside: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, words, h) in one direction; a step outside the word leaves the state."""
        h, (U, b) = self.h, (self.w[f"U{d}"], self.w[f"b{d}"])
        table = self.w["E"] @ self.w[f"W{d}"] + b
        steps, n = x.shape
        out, held = np.empty((steps, n, h), np.float32), [None] * steps
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            given = table[x[t]]
            gates = given[:, : 2 * h] + state @ U[:, : 2 * h]
            gates = 0.5 * np.tanh(0.5 * gates) + 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(given[:, 2 * h :] + (r * state) @ U[:, 2 * h :])
            step = (1 - z) * new
            step += z * state
            if not inside[t].all():
                step = np.where(inside[t][:, None], step, state)
            if keep:
                held[t] = (state, z, r, new)
            state = step
            out[t] = state
        return out, held

    def _read(self, x: np.ndarray, inside: np.ndarray, d: str) -> np.ndarray:
        """The states of `_pass`, in place and without what training needs."""
        h, f4 = self.h, np.float32
        table = (self.w["E"] @ self.w[f"W{d}"] + self.w[f"b{d}"]).astype(f4)
        table[:, : 2 * h] *= f4(0.5)  # a logistic gate is half a tanh of half its input, and a half
        U = self.w[f"U{d}"].astype(f4)
        of_gates, of_new = np.ascontiguousarray(U[:, : 2 * h]) * f4(0.5), np.ascontiguousarray(U[:, 2 * h :])
        steps, n = x.shape
        out, state = np.empty((steps, n, h), f4), np.zeros((n, h), f4)
        given, gates, new, reset = np.empty((n, 3 * h), f4), np.empty((n, 2 * h), f4), np.empty((n, h), f4), np.empty((n, h), f4)
        whole = inside.all(axis=1)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(table, x[t], axis=0, out=given, mode="clip")
            np.matmul(state, of_gates, out=gates)
            gates += given[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates *= f4(0.5)
            gates += f4(0.5)
            np.multiply(gates[:, h:], state, out=reset)
            np.matmul(reset, of_new, out=new)
            new += given[:, 2 * h :]
            np.tanh(new, out=new)
            step = out[t]
            np.subtract(state, new, out=step)
            step *= gates[:, :h]
            step += new
            if not whole[t]:
                np.copyto(step, state, where=~inside[t][:, None])
            state = step
        return out

    def forward(self, x: np.ndarray, inside: np.ndarray, keep: bool = False):
        """Label probabilities (steps, words, labels)."""
        f, held_f = self._pass(x, inside, "f", keep)
        b, held_b = self._pass(x, inside, "b", keep)
        h = self.h
        score = f @ self.w["V"][:h] + b @ self.w["V"][h:] + self.w["c"]
        score -= score.max(axis=2, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=2, keepdims=True)
        return (score, f, b, held_f, held_b) if keep else score

    def gradients(self, x: np.ndarray, inside: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the positions, and its gradients by back-propagation through time."""
        h = self.h
        prob, f, b, *held = self.forward(x, inside, keep=True)
        n = inside.sum()
        steps, words = x.shape
        loss = -np.log(np.maximum(prob[:, np.arange(words), label], 1e-9))[inside].sum() / n
        prob[:, np.arange(words), label] -= 1
        prob *= inside[:, :, None] / np.float32(n)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["V"][:h], g["V"][h:] = np.einsum("tnh,tnl->hl", f, prob, optimize=True), np.einsum("tnh,tnl->hl", b, prob, optimize=True)
        g["c"] = prob.sum(axis=(0, 1))
        for d, kept, V in (("f", held[0], self.w["V"][:h]), ("b", held[1], self.w["V"][h:])):
            U, W = self.w[f"U{d}"], self.w[f"W{d}"]
            table = np.zeros((256, 3 * h), np.float32)
            back = np.zeros((words, h), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                state, z, r, new = kept[t]
                back = back + prob[t] @ V.T
                live = inside[t][:, None]
                step = back * live
                d_new = step * (1 - z) * (1 - new * new)
                d_rs = d_new @ U[:, 2 * h :].T
                d_z = step * (state - new) * z * (1 - z)
                d_r = d_rs * state * r * (1 - r)
                gates = np.concatenate([d_z, d_r], axis=1)
                g[f"U{d}"][:, : 2 * h] += state.T @ gates
                g[f"U{d}"][:, 2 * h :] += (r * state).T @ d_new
                np.add.at(table, x[t], np.concatenate([gates, d_new], axis=1))
                back = np.where(live, step * z + d_rs * r + gates @ U[:, : 2 * h].T, back)
            g[f"b{d}"] = table.sum(axis=0)
            g[f"W{d}"] = self.w["E"].T @ table
            g["E"] += table @ W.T
        return float(loss), g

    def train(self, data: np.ndarray, offsets: np.ndarray, label: np.ndarray, config: Config) -> float:
        """Adam on windows at random places of the texts, of random length, each label alike; returns the
        last epoch's mean loss."""
        rng = np.random.default_rng(config.seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        size = np.diff(offsets)
        weight = size / np.bincount(label, size, len(self.labels))[label]
        noise = len(self.labels)
        steps, mean = 0, 0.0
        total = config.epochs * -(-config.windows // config.batch)
        for _ in range(config.epochs):
            drawn = rng.choice(len(size), config.windows, p=weight / weight.sum())
            starts = offsets[drawn] + (rng.random(len(drawn)) * size[drawn]).astype(np.int64)
            ends = np.minimum(starts + rng.integers(min(4, config.span), config.span + 1, len(drawn)), offsets[drawn + 1])
            mean = 0.0
            for i in range(0, len(drawn), config.batch):
                own = slice(i, i + config.batch)
                x, wanted = steps_of(data, starts[own], ends[own]), label[drawn[own]]
                made = rng.random(len(wanted)) < config.noise
                x[:, made] = noisy(x[:, made], rng)
                wanted[made] = noise
                loss, g = self.gradients(x, np.arange(len(x))[:, None] < ends[own] - starts[own], wanted)
                mean += loss * x.shape[1] / len(drawn)
                steps += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                rate = config.rate * (1 - steps / (total + 1))
                for k, v in g.items():
                    v = v * min(1.0, 1.0 / max(norm, 1e-9))
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v * v - second[k])
                    self.w[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-8)
        return mean

    def window_sums(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(windows, labels and two): probabilities of the labels summed over the positions of each window,
        which is read with its context from `low` to `high`; that of noise over its letters; and how many
        letters it has."""
        h, (V, c) = self.h, (self.w["V"], self.w["c"])
        out = np.empty((len(starts), len(c) + 1), np.float64)
        order = np.argsort(high - low, kind="stable")
        for i in range(0, len(order), AT_ONCE):
            own = order[i : i + AT_ONCE]
            x = steps_of(data, low[own], high[own])
            place = np.arange(len(x))[:, None]
            inside = place < high[own] - low[own]
            counts = ((place >= starts[own] - low[own]) & (place < ends[own] - low[own])).astype(np.float32)
            forth, back = self._read(x, inside, "f"), self._read(x, inside, "b")
            letters = counts * _LETTERED[x]
            total, noise = np.zeros((len(own), len(c)), np.float32), np.zeros(len(own), np.float32)
            for t in range(len(x)):
                score = forth[t] @ V[:h]
                score += back[t] @ V[h:]
                score += c
                score -= score.max(axis=1, keepdims=True)
                np.exp(score, out=score)
                score /= score.sum(axis=1)[:, None]
                noise += score[:, -1] * letters[t]
                total += score * counts[t][:, None]
            out[own, :-2], out[own, -2], out[own, -1] = total[:, :-1], noise, letters.sum(axis=0)
        return out

    def mean_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, labels and noise): the mean over all positions of each text, that of noise over its
        letters; zero for an empty one."""
        starts, ends, at = windows(data, offsets)
        size = np.diff(at)
        low = np.maximum(starts - MARGIN, np.repeat(offsets[:-1], size))
        high = np.minimum(ends + MARGIN, np.repeat(offsets[1:], size))
        out = np.zeros((len(size), len(self.labels) + 1))
        full = np.flatnonzero(size)
        if len(full):
            sums = self.window_sums(data, starts, ends, low, high)
            whole = np.add.reduceat(sums, at[:-1][full], axis=0)
            out[full, :-1] = whole[:, :-2] / np.diff(offsets)[full][:, None]
            out[full, -1] = whole[:, -2] / np.maximum(whole[:, -1], 1)
        return out


def sample(docs: DataFrame, key: str, text: str, label: str, rows: int, seed: int) -> DataFrame:
    """Up to `rows` labelled rows of each label, by a hash of key and text.

    The rows with text of each label are counted first, and only a share of them that should hold four
    times `rows` goes on: what is shuffled for the ranking grows with the labels, not with the table.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(F.col(key), F.col(text), F.lit(seed)).alias("h"))
    counts = known.groupBy("label").agg(F.least(F.lit(1.0), 4.0 * rows / F.count("*")).alias("share"))
    some = known.join(counts.hint("broadcast"), "label").where((F.col("h").cast("double") / 2.0**64 + 0.5) <= F.col("share")).drop("share")
    best = Window.partitionBy("label").orderBy("h", "text")
    return some.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rows).select("text", "label")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", config: Config = Config()) -> Network | None:
    """A network trained on `config.rows` rows of each label at most; None if no row has a label and
    a text. One label gives a network that always predicts it."""
    rows = sample(docs, key, text, label, config.rows, config.seed).toArrow()
    labels = sorted(set(rows["label"].to_pylist()))
    data, offsets = K.texts(rows["text"])
    if not labels or not len(data):
        return None
    made = Network(labels, config)
    made.train(data, offsets, np.searchsorted(labels, rows["label"].to_numpy(zero_copy_only=False).astype(str)), config)
    return made


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def lettered(text: str) -> Column:
    """`has_letter` of a column; false for null."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text", extra: list[str] | None = None, pred: str = "lang_pred", score: str = "score", noise: str = "noise") -> DataFrame:
    """The `extra` columns of `docs` (its key alone by default) with lang_pred, score and noise, under the
    names `pred`, `score` and `noise`, which no column of `extra` may have.

    score is the mean probability of the predicted label over all byte positions, noise that of noise
    over letters. Texts that are null
    or have no letter, and all texts if there is no network, get `und` and 0 twice. Ties go to the first
    label in order. Repeated rows and null keys are kept.
    """
    names = extra or [key]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(noise, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(network)
    wanted = docs.select(*names, *([] if text in names else [text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.alone("langid")
        network = shared.value
        for batch in K.portions(batches, text, 1 << 20):
            values = K.column(batch, text)
            data, offsets = K.texts(values)
            mean = network.mean_probabilities(data, offsets) if network else np.zeros((len(batch), 2))
            plain = np.diff(K.bounds(_LETTER[data].astype(np.int64))[offsets]) > 0
            lettered = np.array([bool(p) or (values[i].is_valid and has_letter(values[i].as_py())) for i, p in enumerate(plain)], bool) & bool(network)
            best = mean[:, :-1].argmax(axis=1)
            labels = [network.labels[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
            sure = np.where(lettered, mean[np.arange(len(mean)), best], 0.0)
            other = np.where(lettered, mean[:, -1], 0.0)
            yield pa.RecordBatch.from_arrays([*[K.column(batch, c) for c in names], pa.array(labels, pa.string()), pa.array(np.clip(sure, 0, 1)), pa.array(np.clip(other, 0, 1))], names=schema.names)

    return wanted.mapInArrow(run, schema)


def in_a_language(pred: str = "lang_pred", noise: str = "noise") -> Column:
    """Whether a row of `predict` is in one of the learned languages: not `und`, nor noise."""
    return (F.col(pred) != UNDETERMINED) & (F.col(noise) <= NOISE)


def held_out(key: str) -> Column:
    """Rows that training must not read: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", config: Config = Config()) -> DataFrame:
    """(key, held_out, lang_pred, score), learned from the rows of `docs` that are not held out."""
    network = fit(docs.where(~held_out(key)), key, text, label, config)
    return predict(docs, network, key, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")
