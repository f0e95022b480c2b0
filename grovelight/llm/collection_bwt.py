"""Burrows-Wheeler transform and common prefixes of a collection of short strings, built column by column.

Round r inserts the suffix of length r of every string that is long enough, so all strings grow by one symbol a round.
The transform and the prefix lengths are files of one byte a row. A round reads them front to back in chunks, which
gives each new suffix its place (the rank of its first symbol among all equal ones so far) and its common prefix with
its neighbour (one more than the least between two equal symbols), and a second reading writes the next round's files.
In memory are one chunk, one place a string, and running counts and minima of 256 symbols.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Symbol of a suffix that is a whole string; no byte of UTF-8 has this value.
END = 255
BLOCK = 8


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi] for each pair: whole blocks by a sparse table, both ends by themselves."""
    step = np.arange(BLOCK)
    out = np.minimum(values[np.minimum(lo[:, None] + step, hi[:, None])].min(1), values[np.maximum(hi[:, None] - step, lo[:, None])].min(1))
    first, last = -(-lo // BLOCK), (hi + 1) // BLOCK - 1
    far = np.flatnonzero(first <= last)
    if len(far):
        whole = values[: len(values) // BLOCK * BLOCK]
        while len(whole) > len(values) // BLOCK:
            whole = np.minimum(whole[0::2], whole[1::2])
        table = [whole]
        a, n = first[far], last[far] - first[far] + 1
        level = np.frexp(n)[1] - 1
        for k in range(level.max()):
            half, wide = 1 << k, table[-1]
            table.append(np.minimum(wide[: max(len(wide) - half, 0)], wide[half:]))
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            inner = np.minimum(table[k][a[at]], table[k][a[at] + n[at] - (1 << int(k))])
            out[far[at]] = np.minimum(out[far[at]], inner)
    return out


def chunks(path: str, n: int, size: int):
    with open(path, "rb") as f:
        for a in range(0, n, size):
            yield np.fromfile(f, np.uint8, min(size, n - a))


def places(sym_file: str, lcp_file: str, n: int, at: np.ndarray, most: int, size: int):
    """One reading. Of the suffixes that the rows ``at`` bring in, and of those that come next after them: first symbol,
    rank among its equals, prefix, whether new, and the row; and how often each symbol occurs."""
    counts, least, was_new = np.zeros(256, np.int64), np.full(256, 255, np.uint8), np.zeros(256, bool)
    found = []
    for c, (sym, lcp) in enumerate(zip(chunks(sym_file, n, size), chunks(lcp_file, n, size))):
        a = c * size
        new = at[np.searchsorted(at, a) : np.searchsorted(at, a + len(sym))] - a
        order = np.argsort(sym, kind="stable")
        own = np.bincount(sym, minlength=256)
        start = np.cumsum(own) - own
        # Where the new rows stand in the order: a search in their own symbol's part of it.
        s = sym[new]
        by = np.argsort(s, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(s[by]) != 0)), len(by)) if len(by) else [0]
        k = np.empty(len(by), np.int64)
        for i, j in zip(cuts[:-1], cuts[1:]):
            v = s[by[i]]
            k[i:j] = start[v] + np.searchsorted(order[start[v] : start[v] + own[v]], new[by[i:j]])
        s = s[by]
        # The rows behind new ones: in this chunk, or the first of a symbol whose last row before was new.
        after = k + 1
        after, s_after = after[after < start[s] + own[s]], s[after < start[s] + own[s]]
        carried = np.flatnonzero(was_new & (own > 0))
        every = np.concatenate([k, after, start[carried]])
        symbols = np.concatenate([s, s_after, carried.astype(np.uint8)])
        fresh = np.concatenate([np.ones(len(k), bool), np.zeros(len(every) - len(k), bool)])
        one = np.lexsort((~fresh, every))  # a row that is both counts as new
        one = one[np.append(True, np.diff(every[one]) != 0)] if len(one) else one
        k, s, fresh = every[one], symbols[one], fresh[one]
        row, rank, inside = order[k], counts[s] + k - start[s], k > start[s]
        if len(k):
            prefix = range_minima(lcp, np.where(inside, order[k - 1] + 1, 0), row)
            prefix = np.where(inside, prefix, np.minimum(prefix, least[s]))
            prefix = np.where(rank == 0, 0, np.minimum(prefix.astype(np.int64) + 1, most)).astype(np.uint8)
            found.append((s, rank, prefix, fresh, row + a))
        if a + size < n:
            least = np.minimum(least, lcp.min())
            here = np.flatnonzero(own)
            last = order[start[here] + own[here] - 1]
            open_end = last + 1 < len(lcp)
            least[here] = 255
            least[here[open_end]] = range_minima(lcp, last[open_end] + 1, np.full(open_end.sum(), len(lcp) - 1))
            was_new[here] = np.isin(last, new)
        counts += own
    return counts, *(np.concatenate(x) for x in zip(*found))


def build(folder: str, bodies: np.ndarray, offsets: np.ndarray, most: int, size: int) -> tuple[str, str, int]:
    """Files of symbols and prefixes (up to ``most``) of all suffixes, and the number of rows. The strings are
    bodies[offsets[j]:offsets[j+1]], none empty. Rounds write to two pairs of files by turns."""
    ends, lengths = offsets[1:], np.diff(offsets)
    m = len(lengths)
    names = [{"sym": f"{folder}/sym-{i}", "lcp": f"{folder}/lcp-{i}"} for i in (0, 1)]
    for name in (*names[0].values(), *names[1].values()):
        open(name, "wb").close()
    bodies[ends - 1].tofile(names[0]["sym"])
    np.zeros(m, np.uint8).tofile(names[0]["lcp"])
    n, at, who = m, np.arange(m), np.arange(m)
    now, after = names
    for r in range(1, int(lengths.max()) + 1):
        counts, s, rank, prefix, fresh, row = places(now["sym"], now["lcp"], n, at, most, size)
        begin = m + np.cumsum(counts[:END]) - counts[:END]
        target = begin[s] + rank
        order = np.argsort(target)
        target, prefix, fresh, row = target[order], prefix[order], fresh[order], row[order]
        who = who[np.searchsorted(at, row[fresh])]
        at = target[fresh]
        symbols = np.where(lengths[who] > r, bodies[np.maximum(ends[who] - r - 1, 0)], END).astype(np.uint8)
        before = at - np.arange(len(at))  # how many of the old rows stand before each new one
        for name, values in (("sym", symbols), ("lcp", prefix[fresh])):
            with open(after[name], "r+b") as f:
                done = 0
                for c, old in enumerate(chunks(now[name], n, size)):
                    a = c * size
                    i, j = np.searchsorted(before, [a, a + len(old) if a + len(old) < n else n + 1])
                    made = np.empty(len(old) + j - i, np.uint8)
                    kept = np.ones(len(made), bool)
                    kept[at[i:j] - done] = False
                    made[kept] = old
                    made[at[i:j] - done] = values[i:j]
                    if name == "lcp":
                        p, q = np.searchsorted(target, [done, done + len(made)])
                        made[target[p:q] - done] = prefix[p:q]
                    made.tofile(f)
                    done += len(made)
        now, after = after, now
        n += len(at)
        going = lengths[who] > r
        at, who = at[going], who[going]
        if not len(at):
            break
    return now["sym"], now["lcp"], n


def later_copies(bodies: np.ndarray, offsets: np.ndarray, width: int, size: int = 4 << 20) -> np.ndarray:
    """(string, offset) of every ``width`` bytes that also start earlier: in an earlier string, or earlier in the same."""
    lengths = np.diff(offsets)
    m = len(lengths)
    if not m:
        return np.zeros((0, 2), np.int64)
    # Scratch of this task alone, gone when it ends; a task that runs again builds its own.
    with tempfile.TemporaryDirectory() as folder:
        sym_file, lcp_file, n = build(folder, bodies, offsets, width, size)
        sym, lcp = np.fromfile(sym_file, np.uint8, n), np.fromfile(lcp_file, np.uint8, n)
    # Row of the next longer suffix: ends last, behind all symbols.
    follow = np.empty(n, np.int32)
    follow[np.argsort(sym, kind="stable")] = np.arange(m, n + m, dtype=np.int32)
    first = np.full(n, -1, np.int64)
    at, who = np.arange(m), np.arange(m)
    for r in range(1, int(lengths.max()) + 1):
        going = lengths[who] >= r
        at, who = follow[at[going]], who[going]
        if r >= width:
            first[at] = (who << 16) | (lengths[who] - r)
    del follow, sym
    rows = np.flatnonzero(first >= 0)
    group = np.cumsum(lcp < width)[rows]
    value = first[rows]
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    begins = np.flatnonzero(np.append(True, np.diff(group) != 0))
    least = np.repeat(np.minimum.reduceat(value, begins), np.diff(np.append(begins, len(rows))))
    later = value[value != least]
    return np.stack([later >> 16, later & 0xFFFF], 1)
