"""Ranked merges of one word on a heap: for words too long for a quadratic fold, and for offline proofs."""

from __future__ import annotations

import base64
import heapq


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 of the token's bytes, then its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(parts: list, rank_of, join) -> list:
    """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank.

    ``rank_of(a, b)`` is the pair's rank or None; ``join(a, b)`` is the merged part. O(n log n).
    """
    n = len(parts)
    if n < 2:
        return parts
    parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := rank_of(parts[i], parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j], after[i] = join(a, b), None, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p is not None]
