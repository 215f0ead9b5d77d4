"""The numbers of :mod:`jostle.functions.rng` for whole arrays of keys, inside a task.

A key is ``head``, a block of repetitions, ``middle`` and a slot, the numbers as decimals: the text that the column functions
hash. Keys of one length differ in their digits only, so MD5 runs on arrays of its 32-bit words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

# Keys that are hashed at once: their arrays fit a core's cache.
KEYS = 16_384
# Keys whose numbers a task holds at once.
HELD = 262_144
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_CONSTANTS = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF


def _compress(state: list, words: list, size: int) -> list:
    """One block of MD5 for ``size`` keys; what all keys share is an int, the rest a flat array, and the result is new."""
    a, b, c, d = (s if isinstance(s, int) else s.copy() for s in state)
    f, high = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        word, constant, turn = words[_WORD[i]], _CONSTANTS[i], _SHIFTS[i]
        if isinstance(a, int) and isinstance(word, int):
            mixed = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | (d ^ _MASK))
            x = (a + mixed + word + constant) & _MASK
            a, b, c, d = d, (b + (x << turn | x >> (32 - turn))) & _MASK, b, c
            continue
        if isinstance(a, int):
            a, b, c, d = (np.full(size, v, np.uint32) for v in (a, b, c, d))
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        if isinstance(word, int):
            a += np.uint32((word + constant) & _MASK)
        else:
            a += word
            a += np.uint32(constant)
        np.left_shift(a, np.uint32(turn), out=high)
        a >>= np.uint32(32 - turn)
        a |= high
        a += b
        a, b, c, d = d, a, b, c
    return [(s + v) & _MASK if isinstance(v, int) else v + (np.uint32(s) if isinstance(s, int) else s) for s, v in zip(state, (a, b, c, d), strict=True)]


def _digits(numbers: np.ndarray, size: int, at: int, words: dict[int, np.ndarray]) -> None:
    """Add the ``size`` decimal digits of ``numbers`` to the words that bytes ``at`` and after are in."""
    for i in range(size):
        digit = (numbers // 10 ** (size - 1 - i) % 10 + 48).astype(np.uint32) << np.uint32(8 * ((at + i) % 4))
        words[(at + i) // 4] = words.get((at + i) // 4, np.uint32(0)) + digit


def _same_length(first: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Parts of a range of numbers with equally many digits: (from, to, digits)."""
    while first < end:
        size = len(str(first))
        yield first, min(end, 10**size), size
        first = 10**size


def md5_words(head: str, blocks: range, middle: str, slots: int) -> list[np.ndarray]:
    """The four words of MD5 for every block and slot below ``slots``, each of shape (blocks, slots)."""
    before, between = head.encode(), middle.encode()
    out = [np.empty((len(blocks), slots), np.uint32) for _ in range(4)]
    for b0, b1, wide in _same_length(blocks.start, blocks.stop):
        for s0, s1, long in _same_length(0, slots):
            length = len(before) + wide + len(between) + long
            text = before + bytes(wide) + between + bytes(long) + b"\x80"
            text += bytes(-(len(text) + 8) % 64) + (8 * length).to_bytes(8, "little")
            fixed = np.frombuffer(text, "<u4").tolist()
            rows = max(1, KEYS // (s1 - s0))
            for b in range(b0, b1, rows):
                own, to = {}, min(b + rows, b1)
                _digits(np.arange(b, to)[:, None], wide, len(before), own)
                for s in range(s0, s1, KEYS):
                    upto, varying = min(s + KEYS, s1), dict(own)
                    shape = (to - b, upto - s)
                    _digits(np.arange(s, upto)[None, :], long, len(before) + wide + len(between), varying)
                    flat = {w: np.broadcast_to(v, shape).ravel() + np.uint32(fixed[w]) for w, v in varying.items()}
                    words, state = [flat.get(w, v) for w, v in enumerate(fixed)], list(_START)
                    for block in range(0, len(words), 16):
                        state = _compress(state, words[block : block + 16], shape[0] * shape[1])
                    for whole, part in zip(out, state, strict=True):
                        whole[b - blocks.start : to - blocks.start, s:upto] = part.reshape(shape)
    return out


def spans(blocks: range, slots: int) -> Iterator[range]:
    """Parts of ``blocks`` whose numbers may be held at once."""
    step = max(1, HELD // max(slots, 1))
    for b in range(blocks.start, blocks.stop, step):
        yield range(b, min(b + step, blocks.stop))


def leading(words: list[np.ndarray]) -> np.ndarray:
    """The first 32 bits of each digest, as :func:`jostle.functions.rng.draw` and ``sign_bits`` read them."""
    return words[0].byteswap()


def indices(words: list[np.ndarray], part: int, size: int) -> np.ndarray:
    """Indices below ``size``, as :func:`jostle.functions.rng.index_of` reads them."""
    bits = words[2 * part].byteswap().astype(np.uint64) << np.uint64(28)
    bits |= words[2 * part + 1].byteswap() >> np.uint32(4)
    return (bits - bits // np.uint64(size) * np.uint64(size)).view(np.int64)
