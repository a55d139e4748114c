"""MD5-based hash positions, built from native expressions so every engine reproduces them bit for bit."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = 1 << 31  # from this size on, positions need more than 32 hash bits and a finer modular fold
MINHASH_PRIME = 2147483647


def bloom_bits(items: int, fp_rate: float) -> int:
    """Number of bits for ``items`` entries at ``fp_rate``."""
    return max(1, int(-items * math.log(fp_rate) / math.log(2) ** 2))


def bloom_hashes(m: int, items: int) -> int:
    """Hash count, truncated (plain membership filter)."""
    return max(1, int(m / items * math.log(2)))


def rounded_hashes(m: int, items: int) -> int:
    """Hash count, rounded and kept within 1..20 (counting and sliced filters)."""
    return max(1, min(round(m / items * math.log(2)), 20)) if items else 1


def words32(digest: Column) -> list[Column]:
    """The four unsigned 32-bit words of a hex MD5 digest."""
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def md5_mod(text: Column, m: int) -> Column:
    """The whole 128-bit MD5 value of ``text`` modulo ``m``.

    Folded in steps of 32 bits, or of 16 bits for a large ``m``, so that every step stays inside a signed
    64-bit integer: exact for ``m`` up to 2^47.
    """
    digest, bits = F.md5(text), 32 if m < WIDE else 16
    step, rest = bits // 4, F.lit(0).cast("bigint")
    for at in range(0, 32, step):
        part = F.conv(F.substring(digest, 1 + at, step), 16, 10).cast("bigint")
        rest = (rest * F.lit(1 << bits).cast("bigint") + part) % F.lit(m).cast("bigint")
    return rest


def seeded_positions(item: Column, m: int, k: int) -> list[Column]:
    """Positions md5("<seed>:<item>") mod m for seeds 0..k-1."""
    return [md5_mod(F.concat(F.lit(f"{seed}:"), item), m) for seed in range(k)]


def wide_words(words: list[Column]) -> list[Column]:
    """Two 52-bit words out of four 32-bit ones, for position spaces that 32 bits do not reach."""
    tail = F.lit(1 << 20).cast("bigint")
    return [words[i] * tail + words[i + 2] % tail for i in (0, 1)]


def double_hash_positions(h1: Column, h2: Column, m: int, k: int) -> list[Column]:
    """Positions (h1 + i*h2) mod m for i in 0..k-1, from two words of one digest."""
    size = F.lit(m).cast("bigint")
    step = F.when(h2 % size == 0, F.lit(1).cast("bigint")).otherwise(h2)
    return [(h1 + F.lit(i).cast("bigint") * step) % size for i in range(k)]


def minhash(grams: Column, count: int) -> Column:
    """``count`` min-hash values over a set of strings, as an array (empty set: nulls).

    One digest per element; hash i is (a + i*b) mod p from two 31-bit words of it.
    """
    return minhash_of(hash_pairs(grams), count)


def hash_pairs(grams: Column) -> Column:
    """Two 31-bit words of each element's digest; stage them as a column where many hashes are taken of them."""
    return F.transform(grams, lambda g: _hash_pair(F.md5(g)))


def minhash_of(pairs: Column, count: int) -> Column:
    """``minhash`` of elements given by their ``hash_pairs``."""
    prime = F.lit(MINHASH_PRIME).cast("bigint")

    def smallest(index: int) -> Column:
        factor = F.lit(index).cast("bigint")
        return F.array_min(F.transform(pairs, lambda h: (h["a"] + factor * h["b"]) % prime))

    return F.array(*[smallest(i) for i in range(count)])


def _hash_pair(digest: Column) -> Column:
    a = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")
    b = F.conv(F.substring(digest, 9, 7), 16, 10).cast("bigint")
    return F.struct(a.alias("a"), b.alias("b"))
