"""Hashed character n-grams of whole texts, a stretch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points taken at once; a longer text is read in stretches that overlap by the longest n-gram.
STRETCH = 1 << 20


def buckets(text: str, orders: tuple[int, int], bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers (below 2**bits) of all n-grams of the lower-cased text, n from orders[0] to orders[1]."""
    text = f" {text.lower()} "
    least, most = orders
    for at in range(0, max(1, len(text) - most + 1), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH + most - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        last = at + STRETCH + most - 1 >= len(text)
        gram = codes * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        for n in range(1, most + 1):
            if n > 1:
                gram = gram[:-1] * np.uint32(0x85EBCA6B) + codes[n - 1 :]
            if n >= least and len(gram):
                own = gram if last else gram[:STRETCH]
                mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                yield mixed >> np.uint32(32 - bits)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))
