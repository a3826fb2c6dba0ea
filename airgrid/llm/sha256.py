"""SHA-256 over many inputs at once, block by block, so that the state before a block can be kept and resumed."""

from __future__ import annotations

import numpy as np

#: Inputs hashed together: their words stay in the processor's cache.
LANES = 4_096
DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _root(n: int, power: int, bits: int = 32) -> int:
    """First bits of the fraction of the power-th root of n, by whole numbers."""
    wanted, low, high = n << (power * bits), 0, 1 << (bits + 8)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**power <= wanted else (low, middle)
    return low & ((1 << bits) - 1)


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, n))][:64]
#: The standard's round constants and first state: roots of the first primes.
ROUND = np.array([_root(p, 3) for p in _PRIMES], dtype=np.uint32)
FIRST = np.array([_root(p, 2) for p in _PRIMES[:8]], dtype=np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) of big-endian words each."""
    out = np.empty_like(state)
    for at in range(0, state.shape[1], LANES):
        s = state[:, at:at + LANES]
        w = list(block[:, at:at + LANES])
        a, b, c, d, e, f, g, h = s
        for i in range(64):
            if i >= 16:
                x, y = w[i - 15], w[i - 2]
                w.append(w[i - 16] + w[i - 7] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
            one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
            two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
            a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
        out[:, at:at + LANES] = s + np.stack([a, b, c, d, e, f, g, h])
    return out


def fresh(n: int) -> np.ndarray:
    return np.repeat(FIRST[:, None], n, axis=1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as the block (16, n) of their 64 hex digits; a digest as text fills one block."""
    text = np.empty((len(digests), 64), dtype=np.uint8)
    text[:, 0::2] = DIGITS[digests >> 4]
    text[:, 1::2] = DIGITS[digests & 15]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of inputs of so many whole blocks each."""
    padding = np.zeros((16, state.shape[1]), dtype=np.uint32)
    padding[0] = 1 << 31
    padding[15] = blocks * 512
    return state_bytes(compress(state, padding))


def state_bytes(state: np.ndarray) -> np.ndarray:
    """States (8, n) as rows (n, 32) of bytes."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def bytes_state(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(rows).view(">u4").astype(np.uint32).T)
