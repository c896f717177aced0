"""Hashed character n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

# Characters handled at a time: bounds a worker's memory whatever the length of a text.
PIECE = 1 << 19


@cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(texts: Sequence[str | None], overlap: int) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in order, long ones cut with an overlap, grouped up to ``PIECE`` characters."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        for start in range(0, len(text or ""), PIECE):
            part = text[max(0, start - overlap):start + PIECE]
            if held and held + len(part) > PIECE:
                yield owners, parts
                owners, parts, held = [], [], 0
            owners.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield owners, parts


def hashed(texts: Sequence[str | None], orders: Sequence[int], bits: int, raw: bool = False,
           ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index of the text and bucket of each n-gram of the given orders, piece by piece.

    Texts are lower-cased, and every run of other characters than letters becomes one blank; ``raw`` keeps all
    characters as they are. n-grams do not cross texts. Null and empty texts have none.
    """
    most = max(orders)
    for owners, parts in _pieces(texts, most - 1):
        own, codes = [], []
        for owner, part in zip(owners, parts):
            if not raw:
                part = f" {part.lower()} "
            code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            codes.append(code)
            own.append((owner, len(code)))
        code = np.concatenate(codes)
        owner = np.repeat(np.array([o for o, _ in own], np.int32), [n for _, n in own])
        if not raw:
            letter = letters()[code]
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            keep[0] = True
            keep[1:] |= owner[1:] != owner[:-1]
            code, owner = np.where(letter, code, np.uint32(32))[keep], owner[keep]
        key = code * np.uint32(0x9E3779B1)
        for n in range(2, most + 1):
            if len(key) < 2:
                break
            key = (key[:-1] ^ (key[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[n - 1:] * np.uint32(0x9E3779B1)
            if n in orders:
                inside = owner[:len(key)] == owner[n - 1:]
                mixed = (key ^ np.uint32(n)) * np.uint32(0xC2B2AE35)
                mixed ^= mixed >> np.uint32(16)
                yield owner[:len(key)][inside], (mixed >> np.uint32(32 - bits))[inside]
        if 1 in orders:
            mixed = (code ^ np.uint32(1)) * np.uint32(0xC2B2AE35)
            yield owner, (mixed ^ (mixed >> np.uint32(16))) >> np.uint32(32 - bits)


def distinct(texts: Sequence[str | None], orders: Sequence[int], bits: int, wanted: np.ndarray | None = None,
             ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of text and bucket, some texts at a time; ``wanted`` masks the buckets that count."""
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end] or "") <= PIECE):
            held += len(texts[end] or "")
            end += 1
        pairs = [np.zeros(0, np.int64)]
        for owner, bucket in hashed(texts[start:end], orders, bits):
            if wanted is not None:
                hit = wanted[bucket]
                owner, bucket = owner[hit], bucket[hit]
            key = owner.astype(np.int64) << bits | bucket
            pairs.append(np.unique(key) if end - start == 1 else key)
        both = np.unique(np.concatenate(pairs))
        yield (both >> bits) + start, both & ((1 << bits) - 1)
        start = end


def all_distinct(texts: Sequence[str | None], orders: Sequence[int], bits: int, wanted: np.ndarray,
                 ) -> tuple[np.ndarray, np.ndarray]:
    """All of ``distinct`` at once: few pairs, as ``wanted`` masks most."""
    parts = list(distinct(texts, orders, bits, wanted)) or [(np.zeros(0, np.int64),) * 2]
    return np.concatenate([o for o, _ in parts]), np.concatenate([b for _, b in parts])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
