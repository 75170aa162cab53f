"""Vectorised text primitives shared by the Python stages: code points, tokens, hashes, lines and sentences.

A batch of texts becomes one array of code points; everything below works on whole batches, so the cost per
character is a few numpy passes whatever the number of texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Flags of a code point, all found in one look-up.
LETTER, MARK, DIGIT, SPACE, IDEOGRAPH, ENDER, FULL, CLOSER, BREAK, LATIN, PERSIAN, INVISIBLE = (1 << i for i in range(12))
ENDERS, IDEOGRAPHIC, CLOSERS = ".!?…؟！？", "。", "\"”“»'’)]"
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: Characters without a width: soft hyphens, joiners, directions, byte order marks.
UNSEEN = "\u00ad\ufeff" + "".join(chr(i) for a, b in ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064)) for i in range(a, b + 1))
TOP = 0x20000  # code points beyond are treated as letters (they are CJK extensions)


@cache
def classes() -> dict[str, np.ndarray]:
    """Per code point: letter, mark, digit value (-1: none), lower-case form, white space; its symbol (one for all digits, one for all white space, else the lower-case form) and its value in a word (digits of all scripts are equal)."""
    letter, mark, space = np.zeros(TOP + 1, bool), np.zeros(TOP + 1, bool), np.zeros(TOP + 1, bool)
    digit, lower = np.full(TOP + 1, -1, np.int8), np.arange(TOP + 1, dtype=np.uint32)
    for i in range(TOP):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        elif kind[0] == "M":
            mark[i] = True
        elif kind == "Nd":
            digit[i] = unicodedata.digit(c)
        if c.isspace():
            space[i] = True
    letter[TOP] = True
    ideograph = np.zeros(TOP + 1, bool)
    for a, b in ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF)):
        ideograph[a : b + 1] = True
    ideograph[TOP] = True
    flags = np.zeros(TOP + 1, np.uint16)
    for bit, on in ((LETTER, letter), (MARK, mark), (DIGIT, digit >= 0), (SPACE, space), (IDEOGRAPH, ideograph)):
        flags[on] |= bit
    for bit, chars in ((ENDER, ENDERS), (FULL, IDEOGRAPHIC), (CLOSER, CLOSERS), (BREAK, BREAKS), (PERSIAN, "پچژگکی"), (INVISIBLE, UNSEEN)):
        flags[[ord(c) for c in chars]] |= bit
    flags[(np.arange(TOP + 1) < 0x250) & letter] |= LATIN
    value = np.where(digit >= 0, digit.astype(np.uint32) + np.uint32(48), lower)
    symbol = np.where(digit >= 0, np.uint32(48), np.where(space, np.uint32(32), lower))
    return {"letter": letter, "mark": mark, "digit": digit, "lower": lower, "space": space, "ideograph": ideograph, "flags": flags, "symbol": symbol, "value": value}


def codepoints(texts: list[str], end: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each followed by ``end``; start of each text and, last, the total length)."""
    joined = end.join(texts) + (end if texts else "")
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + len(end)
    return cp, np.concatenate(([0], np.cumsum(sizes)))


@cache
def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(ids: list, texts: list[str], limit: int = 100_000) -> Iterator[tuple[list, list[str]]]:
    """Slices of about ``limit`` characters: what numpy holds at once stays bounded, and in the processor's cache."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield ids[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


LONG = 64  # a power of two


def runs(inside: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True; ``cut`` marks positions at which a new run starts all the same."""
    before = np.concatenate(([False], inside[:-1]))
    begins = inside & ~before
    if cut is not None:
        begins |= inside & cut
    starts = np.flatnonzero(begins)
    after = np.concatenate((inside[1:], [False]))
    ends = inside & ~after
    if cut is not None:
        ends |= inside & np.concatenate((cut[1:], [True]))
    return starts, np.flatnonzero(ends) + 1


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of ``values`` in each run, by position within the run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(total)
    place = at - np.repeat(first, size)
    at += np.repeat(starts - first, size)
    with np.errstate(over="ignore"):
        x = values.take(at).astype(np.uint64)
        x += np.uint64(1)
        x *= multipliers(LONG, seed).take(place, mode="wrap")
        if (size > LONG).any():  # only these runs: a hash must not depend on what stands beside it
            long = np.repeat(size > LONG, size)
            x[long] = mix(x[long] + (place[long] // LONG).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return mix(np.add.reduceat(x, first) + size.astype(np.uint64))


def sentences(cp: np.ndarray, f: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the sentences in a batch: those pieces between ends of sentences that hold a letter.

    A sentence ends at a line break; after a run of end marks and the closing quotes or brackets behind it where
    white space or the line's end follows; after an ideographic full stop with such quotes. ``f``: the flags of ``cp``,
    where they are known.
    """
    if f is None:
        f = classes()["flags"][np.minimum(cp, TOP)]
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # only at these positions, a few of a hundred, can a sentence end
    at = np.flatnonzero(f & (ENDER | FULL | CLOSER | BREAK))
    here = f[at]
    following = np.where(at + 1 < n, f[np.minimum(at + 1, n - 1)], BREAK)
    closer = (here & CLOSER) != 0
    run = closer.copy()  # the first of each run of closing quotes
    run[1:] &= ~(closer[:-1] & (at[1:] == at[:-1] + 1))
    # the last position up to each that is no closing quote
    last = np.where(closer, at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))] - 1, at) if len(at) else at
    before = np.where(last >= 0, f[np.maximum(last, 0)], 0)
    stop = ((before & ENDER) != 0) & ((following & (SPACE | BREAK)) != 0)
    stop |= ((before & FULL) != 0) & ((following & CLOSER) == 0)
    stop |= (here & BREAK) != 0
    ends = at[stop] + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate(([0], ends[:-1]))
    keep = (np.bitwise_or.reduceat(f, starts) & LETTER) != 0
    return starts[keep], ends[keep]
