"""Packing token sequences by minimum bin slack.

Every document is cut into full windows of ``capacity`` tokens and one remainder.  The
remainders of a partition are packed together: a bitset over reachable lengths (subset
sums of the multiset of remaining lengths) gives the sum closest to the capacity, a
backward walk gives how many items of each length make it up, and the documents are
taken.  The same multiset is used again as long as its items last.  Where no sum is
exact, the next document is cut to fill the window.  So each partition ends with one
unfilled sequence at most.

Texts are tokenised in chunks (white space and the run after it) that the tokenizer
never joins; each distinct chunk of a block is tokenised once.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codemix.llm.common import ChunkIds, row_slices, text_buffer, thin

CAPACITY = 1024
END = 0
#: Bits of a worker's memory of chunks; those that find no slot are tokenised again in the next block.
MEMORY_BITS = 18
#: Bytes of text that are tokenised at a time, and pieces that are handed on at a time.
BLOCK_BYTES, HELD_PIECES = 1 << 18, 8_000
#: Largest number of items of the multiset that one search looks at, longest first.
WIDTH = 256

#: The split before the merges of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that the tokenizer knows and the chunk borders do not.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


# --- tokens -----------------------------------------------------------------

def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def ranked_encoder(path: str):
    """A fast encoder with the vocabulary of a byte-level BPE tokenizer file.

    Ids order the merges, so they serve as ranks; a file where they don't is refused.
    Added tokens in a text become their id, as in the tokenizer file's own library.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of, vocab = _byte_of(), spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    made = [vocab["".join(m)] for m in pairs]
    if made != sorted(made) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is no byte-level BPE file whose ids order its merges")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


class Chunked:
    """Token ids of texts, through the distinct chunks of a block."""

    def __init__(self, path: str):
        self.encoder = ranked_encoder(path)
        self.special = re.compile("|".join(map(re.escape, self.encoder.special_tokens_set)) or r"(?!)")
        self.chunks = ChunkIds(self._encode, glued=True, bits=MEMORY_BITS)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        plain, special = self.encoder.encode_ordinary, self.special
        return [self.encoder.encode(t, allowed_special="all") if special.search(t) else plain(t) for t in texts]

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text, in order, as unsigned 32-bit numbers; null counts as empty."""
        data, bounds = text_buffer(column)
        for a, b in row_slices(bounds, BLOCK_BYTES):
            base = int(bounds[a])
            part, inner = data[base:int(bounds[b])], bounds[a:b + 1] - base
            yield from self._block(part, inner)

    def _block(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        if not _ODD.search(data.tobytes().decode("utf-8", "surrogatepass")):
            yield from self.chunks.ids(data, bounds)
            return
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            text = data[s:e].tobytes().decode("utf-8", "surrogatepass")
            if _ODD.search(text):
                yield np.array(self._encode([text])[0], np.uint32)
            else:
                yield from self.chunks.ids(data[s:e], np.array([0, e - s]))


# --- minimum bin slack ------------------------------------------------------

def fill(counts: dict[int, int], capacity: int, width: int = WIDTH) -> dict[int, int]:
    """Counts per length of the multiset whose sum is the largest within the capacity.

    Takes the longest item, then a bitset of reachable sums over the longest ``width``
    lengths; stops as soon as the capacity is reachable, and walks back.
    """
    lengths = sorted((k for k, n in counts.items() if n), reverse=True)
    if not lengths:
        return {}
    room = capacity - lengths[0]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in [x for x in lengths if x <= room][:width]:
        most = min(counts[length] - (length == lengths[0]), room // length)
        left, size = most, 1
        while left > 0:
            n = min(size, left)
            steps.append((reach, length, n))
            reach |= (reach << (length * n)) & mask
            left -= n
            size *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {lengths[0]: 1}
    for before, length, n in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= length * n
    return used


def sequences(lengths: np.ndarray, capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pack items into sequences of (item, start, length); every token once, gapless."""
    shelf: dict[int, list[int]] = {}
    for item in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        shelf.setdefault(int(lengths[item]), []).append(item)
    shelf.pop(0, None)
    counts = {k: len(v) for k, v in shelf.items()}
    begin: dict[int, int] = {}

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        item = shelf[length].pop()
        return item, begin.get(item, 0), length

    while any(counts.values()):
        used = fill(counts, capacity)
        total = sum(k * n for k, n in used.items())
        rest = {k: n for k, n in counts.items() if n > used.get(k, 0)}
        if total < capacity and rest:  # no exact sum: cut the shortest document that fills the window
            out = [take(k) for k, n in used.items() for _ in range(n)]
            longer = [k for k, n in counts.items() if n and k > capacity - total]
            length = min(longer)
            item, start, _ = take(length)
            cut = capacity - total
            begin[item] = start + cut
            shelf.setdefault(length - cut, []).append(item)
            counts[length - cut] = counts.get(length - cut, 0) + 1
            yield [*out, (item, start, cut)]
            continue
        for _ in range(min(counts[k] // n for k, n in used.items())):
            yield [take(k) for k, n in used.items() for _ in range(n)]


def _pack(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, serial = TaskContext.get().partitionId() << 33, 0
        names = [f.split()[0] for f in PIECES.split(", ")]
        encoder, ends = Chunked(path), np.array([END], np.uint32)
        owner, begin, total, tails = [], [], [], []

        def rows(columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in thin(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in names]
            ids = batch.column("doc_id").to_pylist()
            for doc, found in zip(ids, encoder.ids(batch.column("text")), strict=True):
                tokens = np.concatenate([found, ends]).astype("<u4")
                full = len(tokens) // capacity
                for k in range(full):
                    piece = zlib.crc32(tokens[k * capacity:(k + 1) * capacity].tobytes())
                    for c, x in zip(out, (doc, k * capacity, capacity, piece, len(tokens), base + serial, 0),
                                    strict=True):
                        c.append(x)
                    serial += 1
                if len(tokens) % capacity:
                    owner.append(doc)
                    begin.append(full * capacity)
                    total.append(len(tokens))
                    tails.append(tokens[full * capacity:].astype(np.uint16 if tokens.max() < 1 << 16 else np.uint32))
            yield rows(out)
        out = [[] for _ in names]
        for pieces in sequences(np.array([len(t) for t in tails], np.int64), capacity):
            offset = 0
            for item, start, length in pieces:
                part = tails[item][start:start + length].astype("<u4").tobytes()
                for c, x in zip(out, (owner[item], begin[item] + start, length, zlib.crc32(part), total[item],
                                      base + serial, offset), strict=True):
                    c.append(x)
                offset += length
            serial += 1
            if len(out[0]) > HELD_PIECES:
                yield rows(out)
                out = [[] for _ in names]
        yield rows(out)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that every executor can open.  A document
    is its ids and a closing id 0; null and empty texts are that one id.  Repeated rows are
    packed each for itself, a null doc_id stays null, an empty table gives no rows.  Only
    doc_id and text are read.  Rows never leave their partition, so a lost task repeats
    the same packing.
    """
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(
        _pack(tokenizer, capacity), PIECES)
