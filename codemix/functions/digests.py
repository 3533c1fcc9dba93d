"""MD5 of many short messages at once, over Arrow arrays: the draws of ``draw.py`` inside a batch."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 55  # bytes of a message that fits one block with its end mark and length; others go one by one
CHUNK = 1 << 13  # messages at a time, so that the state stays in the processor's cache
SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * (1 << 32)).astype(np.uint32)
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _blocks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The padded messages as 16 little-endian words each, one row a word."""
    sizes = np.diff(offsets)
    block = np.zeros((len(sizes), 64), np.uint8)
    at = np.arange(offsets[0], offsets[-1]) + np.repeat(np.arange(len(sizes)) * 64 - offsets[:-1], sizes)
    block.reshape(-1)[at] = data[offsets[0]:offsets[-1]]
    block[np.arange(len(sizes)), sizes] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = sizes * 8
    return words


def _rounds(words: np.ndarray) -> list[np.ndarray]:
    n = words.shape[1]
    a, b, c, d = (np.full(n, v, np.uint32) for v in START)
    f, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    filled = words.any(axis=1)
    for k in range(64):
        quarter = k // 16
        if quarter == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = k
        elif quarter == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * k + 1) % 16
        elif quarter == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * k + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * k % 16
        f += a
        f += SINES[k]
        if filled[g]:
            f += words[g]
        turn = TURNS[quarter][k % 4]
        np.left_shift(f, np.uint32(turn), out=high)
        f >>= np.uint32(32 - turn)
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a  # the old first word is free for the next round
    return [x + np.uint32(v) for x, v in zip((a, b, c, d), START, strict=True)]


def _short(messages: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(messages.buffers()[1], np.int32)[messages.offset:messages.offset + len(messages) + 1].astype(np.int64)
    data = np.frombuffer(messages.buffers()[2] or b"", np.uint8)
    out = np.empty((4, len(messages)), np.uint32)
    for lo in range(0, len(messages), CHUNK):
        at = offsets[lo:lo + CHUNK + 1]
        for k, word in enumerate(_rounds(_blocks(data, at))):
            out[k, lo:lo + CHUNK] = word.byteswap()
    return out


def md5_words(messages: pa.Array) -> np.ndarray:
    """The four 32-bit words of every digest, first digits highest, as a ``4 x n`` array of uint32."""
    messages = messages.cast(pa.binary())
    long = np.flatnonzero(pc.binary_length(messages).to_numpy(zero_copy_only=False) > LONGEST)
    if not len(long):
        return _short(messages)
    slow = pa.array(long)
    short = np.ones(len(messages), bool)
    short[long] = False
    out = np.empty((4, len(messages)), np.uint32)
    out[:, short] = _short(messages.filter(pa.array(short)))
    out[:, long] = np.array([np.frombuffer(md5(m).digest(), ">u4") for m in messages.take(slow).to_pylist()]).T
    return out
