"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads the bytes of a segment (a word, cut every ``SEGMENT`` bytes; A-Z
count as a-z) from both sides and gives every byte position a probability per
language.  A document's probabilities are the mean over its letter positions.
Segments are independent, so each distinct one is computed once per block of text
and weighted by its count, and a worker remembers up to ``2 ** MEMORY_BITS``:
the same sums for a fraction of the work.

Training runs in numpy on the driver, by backpropagation through time, on a
bounded sample: about ``train_docs`` labelled documents, evenly over languages,
of which at most ``train_segments`` distinct segments are kept, by hash order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codemix.llm.common import Remembered, WordHasher, give_back, row_slices, text_buffer, thin

SEGMENT = 32
BLOCK = 2 << 20
TRAIN_DOCS, TRAIN_SEGMENTS = 800, 30_000
HIDDEN, EPOCHS, BATCH, RATE = 12, 6, 256, 0.01
#: Updates at least: a small sample is passed more often.
UPDATES = 400
#: Bits of a worker's memory of segments; those that find no slot are computed again.
MEMORY_BITS = 19
UNKNOWN = "und"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
PLAIN = re.compile(rb"[A-Za-z]")
LETTER = np.zeros(256, bool)
LETTER[ord("a"):ord("z") + 1] = LETTER[ord("A"):ord("Z") + 1] = LETTER[0x80:] = True


# --- segments ---------------------------------------------------------------

def _cut(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut spans to at most SEGMENT bytes."""
    times = (ends - starts + SEGMENT - 1) // SEGMENT
    if len(times) == 0 or times.max() == 1:
        return starts, ends
    first = np.repeat(np.cumsum(times) - times, times)
    begin = np.repeat(starts, times) + SEGMENT * (np.arange(len(first)) - first)
    return begin, np.minimum(begin + SEGMENT, np.repeat(ends, times))


def segments(hasher: WordHasher, data: np.ndarray, bounds: np.ndarray):
    """Blocks (starts, ends, letters, hashes, rows) of all segments that have a letter."""
    found, size = [], 0
    for a, b in row_slices(bounds):
        base, stop = int(bounds[a]), int(bounds[b])
        parts = hasher.pieces(data[base:stop]) if b == a + 1 else [(0, stop - base)]
        for x, y in parts:
            part = data[base + x:base + y]
            inner = bounds[a:b + 1] - base - x
            starts, ends = _cut(*hasher.spans(part, np.clip(inner, 0, len(part))))
            count = np.concatenate([[0], np.cumsum(LETTER[part])])
            letters = count[ends] - count[starts]
            keep = letters > 0
            starts, ends, letters = starts[keep], ends[keep], letters[keep]
            rows = a + np.searchsorted(inner, starts, "right") - 1 if b > a + 1 else np.full(len(starts), a)
            hashes = hasher.hashes(part, starts, ends)
            found.append((starts + base + x, ends + base + x, letters, hashes, rows))
            size += len(part)
            if size >= BLOCK:
                yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
                found, size = [], 0
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


# --- network ----------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax per position."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.weights = {"out": rng.normal(0, 0.3, (2 * hidden, len(langs))), "out_b": np.zeros(len(langs))}
        for side in "fb":
            self.weights[f"in_{side}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.weights[f"rec_{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            self.weights[f"bias_{side}"] = np.zeros(hidden)
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _walk(self, side: str, data, starts, lens, trace: list | None):
        """States at every position of segments that are sorted by falling length."""
        hid = self.hidden
        table, rec, bias = (self.weights[f"{k}_{side}"] for k in ("in", "rec", "bias"))
        states = np.zeros((int(lens.sum()), hid), np.float32)
        state = np.zeros((len(lens), hid), np.float32)
        for t in range(int(lens[0]) if len(lens) else 0):
            n = int(np.searchsorted(-lens, -t, "left"))
            at = starts[:n] + (t if side == "f" else lens[:n] - 1 - t)
            old = state[:n]
            given, rolled = table[data[at]], old @ rec
            gates = _sigmoid(given[:, :2 * hid] + rolled[:, :2 * hid])
            keep, reset = gates[:, :hid], gates[:, hid:]
            inner = rolled[:, 2 * hid:] + bias
            new = np.tanh(given[:, 2 * hid:] + reset * inner)
            state = new + keep * (old - new)
            states[at] = state
            if trace is not None:
                trace.append((at, old, keep, reset, inner, new))
        return states

    def positions(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, traces: dict | None = None):
        both = np.concatenate([self._walk(s, data, starts, lens, None if traces is None else traces.setdefault(s, []))
                               for s in "fb"], 1)
        logits = both @ self.weights["out"] + self.weights["out_b"]
        logits -= logits.max(1, keepdims=True)
        odds = np.exp(logits)
        return both, odds / odds.sum(1, keepdims=True)

    def gradients(self, data, starts, lens, target, weight):
        """Loss and gradients of the weighted cross entropy, through time in both directions."""
        traces: dict = {}
        both, odds = self.positions(data, starts, lens, traces)
        hid, total = self.hidden, weight.sum()
        rows = np.arange(len(odds))
        loss = -(weight * np.log(odds[rows, target] + 1e-9)).sum() / total
        err = odds.copy()
        err[rows, target] -= 1
        err *= (weight / total)[:, None]
        grads = {"out": both.T @ err, "out_b": err.sum(0)}
        back = err @ self.weights["out"].T
        for k, side in enumerate("fb"):
            rec = self.weights[f"rec_{side}"]
            given = np.zeros_like(self.weights[f"in_{side}"])
            d_rec, d_bias = np.zeros_like(rec), np.zeros(hid, np.float32)
            later = np.zeros((0, hid), np.float32)
            for at, old, keep, reset, inner, new in reversed(traces[side]):
                d = back[at, k * hid:(k + 1) * hid].copy()
                d[:len(later)] += later
                d_new = d * (1 - keep) * (1 - new * new)
                d_gate = np.concatenate([d * (old - new) * keep * (1 - keep),
                                         d_new * inner * reset * (1 - reset)], 1)
                d_roll = np.concatenate([d_gate, d_new * reset], 1)
                d_bias += d_roll[:, 2 * hid:].sum(0)
                d_rec += old.T @ d_roll
                np.add.at(given, data[at], np.concatenate([d_gate, d_new], 1))
                later = d * keep + d_roll @ rec.T
            grads |= {f"in_{side}": given, f"rec_{side}": d_rec, f"bias_{side}": d_bias}
        return loss, grads

    def fit(self, words: list[bytes], target: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> Network:
        """Adam over batches of segments of like length."""
        rng = np.random.default_rng(5)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        lens, step = np.array([len(w) for w in words]), 0
        epochs = max(epochs, -(-UPDATES // -(-len(words) // BATCH))) if words else 0
        total = epochs * (len(words) // BATCH + 1)
        for _ in range(epochs):
            mixed = rng.permutation(len(words))
            for a in range(0, len(words), BATCH):
                pick = mixed[a:a + BATCH]
                pick = pick[np.argsort(-lens[pick], kind="stable")]
                data = np.frombuffer(b"".join(words[i] for i in pick), np.uint8)
                size = lens[pick]
                starts = np.cumsum(size) - size
                _, grads = self.gradients(data, starts, size, np.repeat(target[pick], size),
                                          (np.repeat(weight[pick], size) * LETTER[data]).astype(np.float32) + 1e-6)
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9 ** step))
                                        / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, step: int = 4096) -> np.ndarray:
        """Per segment: the sum of its letter positions' probabilities."""
        out = np.zeros((len(starts), len(self.langs)))
        order = np.argsort(-lens, kind="stable")
        for a in range(0, len(order), step):
            pick = order[a:a + step]
            size = lens[pick]
            to = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(starts[pick] - to, size)
            part = LOWER[data[at]]
            _, odds = self.positions(part, to, size)
            out[pick] = np.add.reduceat(odds * LETTER[part][:, None], to, axis=0)
        return out

    def recalled(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        """``pooled`` through the worker's memory: a table of values, and each segment's row in it."""
        if "_memory" not in self.__dict__:
            self._memory = Remembered(MEMORY_BITS)
            self._values = np.zeros((1 << 16, len(self.langs)))
        place = self._memory.find(hashes)
        missed = np.flatnonzero(place < 0)
        if len(missed):
            new, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            first = missed[first]
            base = self._memory.size
            order = np.full(len(new), -1)
            kept = self._memory.add(new)
            order[kept] = np.arange(len(kept))  # the remembered ones come first and stay
            order[order < 0] = np.arange(len(kept), len(new))
            if base + len(new) > len(self._values):
                grown = np.zeros((2 * (base + len(new)), len(self.langs)))
                grown[:base] = self._values[:base]
                self._values = grown
            self._values[base + order] = self.pooled(data, starts[first], lens[first])
            place[missed] = base + order[back]
        return self._values, place

    def documents(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the probabilities, and whether it has a letter."""
        data, bounds = text_buffer(column)
        hasher, n = WordHasher(True), len(bounds) - 1
        sums, letters = np.zeros((n, len(self.langs))), np.zeros(n)
        for starts, ends, count, hashes, rows in segments(hasher, data, bounds):
            odds, place = self.recalled(hashes, data, starts, ends - starts)
            letters += np.bincount(rows, count, n)
            for c in range(len(self.langs)):
                sums[:, c] += np.bincount(rows, odds[place, c], n)
        has = letters > 0
        for i in np.flatnonzero(has):
            text = memoryview(data[bounds[i]:bounds[i + 1]])
            if not PLAIN.search(text):
                has[i] = any(c.isalpha() for c in bytes(text).decode("utf-8", "replace"))
        return sums / np.maximum(letters, 1)[:, None], has


# --- Spark ------------------------------------------------------------------

def held_out() -> Column:
    """Documents that are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(True)
    for batch in thin(batches, "text"):
        data, bounds = text_buffer(batch.column("text"))
        langs, raw = batch.column("lang").to_pylist(), LOWER[data].tobytes()
        counts: dict[tuple[str, bytes], int] = {}
        for starts, ends, _, _, rows in segments(hasher, data, bounds):
            for a, b, i in zip(starts.tolist(), ends.tolist(), rows.tolist(), strict=True):
                key = (langs[i], raw[a:b])
                counts[key] = counts.get(key, 0) + 1
        if counts:
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([k[0] for k in counts], pa.string()),
                "segment": pa.array([k[1] for k in counts], pa.binary()),
                "n": pa.array(list(counts.values()), pa.int64())})


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_segments: int = TRAIN_SEGMENTS,
          epochs: int = EPOCHS) -> Network:
    """Fit the network on labelled documents that are not held out.

    Without one segment to learn from it has no languages.
    """
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Network([])
    per_lang = max(1, train_docs // len(langs))
    rates = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, 1.2 * per_lang / sizes[lang])))])
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 20)) / float(1 << 20)
    rows = (labelled.filter(place < F.element_at(rates, F.col("lang")))
            .mapInArrow(_counted, "lang string, segment binary, n bigint")
            .groupBy("lang", "segment").agg(F.sum("n").alias("n"))
            .orderBy(F.xxhash64("segment", "lang"), "segment", "lang").limit(train_segments).collect())
    if not rows:
        return Network([])
    target = np.array([langs.index(r["lang"]) for r in rows])
    weight = np.sqrt(np.array([r["n"] for r in rows], np.float64))
    share = np.bincount(target, weight, len(langs))
    weight = weight / share[target] * weight.sum() / len(langs)
    return Network(langs).fit([bytes(r["segment"]) for r in rows], target, weight, epochs)


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (columns of these names are replaced).

    Only ``text`` is read.  Null text, text without a letter, or a network that
    learned no language give ``und`` and 0.  Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def predict(texts: pa.Array) -> pa.Array:
        net = shared.value
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if net.langs and len(texts):
            odds, has = net.documents(texts)
            odds = np.round(odds, 6)
            best = odds.argmax(1)
            scores = np.where(has, odds[np.arange(len(best)), best], 0.0)
            langs = [net.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        give_back()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1), pa.float64())],
                                          ["lang_pred", "score"])

    found = docs.withColumn("_langid", F.arrow_udf(predict, "lang_pred string, score double")(docs["text"]))
    keep = [docs[c] for c in docs.columns if c not in ("lang_pred", "score")]
    return found.select(*keep, "_langid.lang_pred", "_langid.score")
