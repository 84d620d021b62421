"""Suffix order and common-prefix values of one shard by external induced sorting.

The text is split at its S*-suffixes (ends of falling runs).  The pieces between them are sorted as tuples and named; the
string of names is ordered by recursion; the order of all suffixes is induced from it in two scans.  In each scan a suffix puts
its left neighbour into a priority queue keyed by first symbol.  The queue is a bucket array per symbol that is
filled first in, first out; it lives in memory-mapped files in ``folder``, so that a shard larger than memory
pages through the disk in order.  Each queued tuple carries its position and its common prefix with the tuple before it: one more than
the least common prefix over the stretch of the scan between the two that put them there.

Names are written as two digits for the recursion, which keeps the number of buckets near the square root of the
number of names.  Strings of at most ``in_memory`` names are ordered by prefix doubling instead.
Common prefixes are cut at ``cap`` symbols; suffixes that agree in more than ``cap`` symbols keep their true order.
Positions and names take 32 bits where they fit; what is needed of a stretch only is made stretch by stretch.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np

#: Strings of names of at most this length are the recursion's base case.
IN_MEMORY = 1_000_000
STRETCH = 1 << 18


class Store:
    """Arrays in memory-mapped files that go with the store; arrays under ``least`` bytes stay in memory."""

    def __init__(self, folder: str | None = None, least: int = 1_000_000):
        # where Spark itself spills; task scratch that no other task reads
        self.folder = folder or tempfile.mkdtemp(prefix="induced-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.own = folder is None
        self.least = least
        self.n_files = 0

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def array(self, n: int, kind: type) -> np.ndarray:
        if n * np.dtype(kind).itemsize < self.least:
            return np.empty(n, kind)
        name = os.path.join(self.folder, uuid.uuid4().hex)
        out = np.memmap(name, kind, "w+", shape=(n,))
        self.n_files += 1
        os.unlink(name)  # the mapping keeps the file; nothing is left behind
        return out

    def close(self) -> None:
        if self.own:
            os.rmdir(self.folder)


def _position(n: int) -> type:
    """The kind of numbers up to ``n``."""
    return np.int32 if n < 2**31 - 1 else np.int64


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo : hi]) for each pair, lo < hi, by doubling tables."""
    width = hi - lo
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table, step = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - step])
        if len(table) > step:
            table = np.minimum(table[:-step], table[step:])
        step *= 2
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes a and b, known to be ``start`` at least, cut at ``cap``."""
    n = len(text)
    out = np.minimum(start, cap).astype(a.dtype)
    live = np.flatnonzero(out < cap)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live = live[ok]
        out[live] += 1
        live = live[out[live] < cap]
    return out


def _doubling(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of a short string of names, by prefix doubling."""
    n = len(names)
    small = _position(n + 2 * cap)
    rank = names.astype(small) + small(1)  # dense
    width = 1
    levels = [rank]  # ranks by the first 1, 2, 4, ... names
    while True:
        key = rank.astype(np.int64)
        key *= n + 2
        key[: max(0, n - width)] += rank[width:]
        order = np.argsort(key)  # ties are ranked alike, so any order of them will do
        key = key[order]
        new = np.ones(n, small)
        new[1:] += np.cumsum(key[1:] != key[:-1], dtype=small)
        del key
        rank = np.empty(n, small)
        rank[order] = new
        distinct = int(new[-1])
        del new
        width *= 2
        if width <= 2 * cap:
            levels.append(rank)
        if distinct == n or width >= n:
            break
        del order
    del rank
    order = order.astype(small)
    lcp = np.zeros(n, small)
    a, b = order[:-1].copy(), order[1:].copy()
    top = len(levels) - 1
    for k in range(top, -1, -1):
        level = np.append(levels.pop(), small(-1))
        # equal ranks mean equal names as far as both go; near the end they must not reach past it
        inside = (a + (1 << k) <= n) & (b + (1 << k) <= n)
        same = inside & (level[np.minimum(a, n)] == level[np.minimum(b, n)])
        if k == top:
            rounds = -(-cap // (1 << k))
        else:
            rounds = 1
        for _ in range(rounds):
            jump = same * small(1 << k)
            lcp[1:] += jump
            a += jump
            b += jump
            if rounds > 1:
                inside = (a + (1 << k) <= n) & (b + (1 << k) <= n)
                same &= inside & (level[np.minimum(a, n)] == level[np.minimum(b, n)])
    return order, np.minimum(lcp, cap)


def _names(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, sigma: int) -> np.ndarray:
    """Dense names, in order, of the pieces text[start : end + 1]; the last piece ends before the end of the text.

    A piece that another one continues is the greater of the two (its end rises, the other falls there).
    """
    bits = int(sigma + 2).bit_length()
    per = 63 // bits
    n, m = len(text), len(starts)
    length = ends - starts + 1
    small = _position(m)
    name = np.zeros(m, small)
    todo = np.arange(m, dtype=small)
    consumed = 0
    while len(todo):
        key = np.zeros(len(todo), np.uint64)
        for lo in range(0, len(todo), STRETCH):
            own = todo[lo : lo + STRETCH]
            part = key[lo : lo + STRETCH]
            for k in range(per):
                at = starts[own].astype(np.int64) + consumed + k
                inside = consumed + k < length[own]
                symbol = np.where(inside, text[np.minimum(at, n - 1)].astype(np.int64) + 1, sigma + 1)
                symbol[inside & (at >= n)] = 0  # past the end of the text: the least
                part <<= np.uint64(bits)
                part |= symbol.astype(np.uint64)
        order = np.lexsort((key, name[todo])) if consumed else np.argsort(key, kind="stable")
        rows, key = todo[order], key[order]
        del order, todo
        base = name[rows]
        group = np.ones(len(rows), bool)
        group[1:] = base[1:] != base[:-1]
        first = group.copy()
        first[1:] |= key[1:] != key[:-1]
        del key
        index = np.arange(len(rows), dtype=small)
        base += np.maximum.accumulate(np.where(first, index, small(0)))
        base -= np.maximum.accumulate(np.where(group, index, small(0)))
        name[rows] = base
        del base, group, index
        consumed += per
        # groups of several members, of which one at least goes on
        at = np.flatnonzero(first)
        sizes = np.diff(np.append(at, len(rows)))
        more = (sizes > 1) & np.logical_or.reduceat(length[rows] > consumed, at)
        todo = rows[np.repeat(more, sizes)]
        del rows, first, at, sizes, more
    used = np.zeros(m, bool)
    used[name] = True
    return (np.cumsum(used, dtype=small) - small(1))[name]


def _scan(text: np.ndarray, store: Store, rising: bool, is_s: np.ndarray, counts: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, seed_bounds: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One induction scan.

    rising: L-suffixes from S*-suffixes, in rising order; else S-suffixes from L-suffixes, in falling order.
    seeds and seed_lcp lie in scan order, seed_bounds by symbol in scan order.  Returns the queue: positions, common
    prefix with the tuple before, and bounds by symbol in scan order.
    """
    sigma = len(counts)
    order = np.arange(sigma) if rising else np.arange(sigma)[::-1]
    bounds = np.concatenate([[0], np.cumsum(counts[order])])
    slot = np.empty(sigma, np.int64)
    slot[order] = np.arange(sigma)
    head = bounds[:-1].copy()  # by slot
    n = len(text)
    queue, prefix = store.array(int(bounds[-1]), np.int32 if n < 2**31 - 1 else np.int64), store.array(int(bounds[-1]), np.int16)
    narrow = np.uint8 if sigma <= 1 << 8 else np.uint16 if sigma <= 1 << 16 else np.int64  # radix sorts up to 16 bits
    depth_kind = prefix.dtype
    if rising:  # the empty suffix comes first and puts the last symbol
        s = slot[text[n - 1]]
        queue[head[s]], prefix[head[s]] = n - 1, 0
        head[s] += 1

    def put(positions: np.ndarray, lcp: np.ndarray, own: int) -> None:
        """The scanned tuples put their left neighbours into the queues of symbols other than ``own``."""
        at = np.flatnonzero(positions > 0)
        left = positions[at] - 1
        take = is_s[left] != rising
        at, left = at[take], left[take]
        target = slot[text[left]]
        other = target != own
        at, left, target = at[other], left[other], target[other]
        if len(at):
            by = np.argsort(target.astype(narrow), kind="stable")
            _append(at[by], left[by], target[by], lcp)

    def _append(at: np.ndarray, left: np.ndarray, target: np.ndarray, lcp: np.ndarray) -> None:
        new = np.ones(len(at), bool)
        new[1:] = target[1:] != target[:-1]
        index = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(new, index, 0))
        where = head[target] + index - begin
        value = np.empty(len(at), depth_kind)
        inner = np.flatnonzero(~new)
        if len(inner):
            value[inner] = 1 + _least_between(lcp, at[inner - 1] + 1, at[inner] + 1)
        firsts = np.flatnonzero(new)
        value[firsts] = head[target[firsts]] > bounds[target[firsts]]  # they share this symbol and no more
        queue[where] = left
        prefix[where] = np.minimum(value, cap)
        ends = np.append(firsts[1:], len(at))
        head[target[firsts]] += ends - firsts

    busy = np.flatnonzero((counts[order] > 0) | (np.diff(seed_bounds) > 0))
    for s in busy.tolist():
        lo, hi, depth = int(bounds[s]), int(head[s]), 1
        while lo < hi:  # rounds: tuples whose left neighbours begin with the same symbol
            positions = np.asarray(queue[lo:hi])
            at = np.flatnonzero(positions > 0)
            left = positions[at] - 1
            take = (is_s[left] != rising) & (slot[text[left]] == s)
            at, left = at[take], left[take]
            if not len(at):
                break
            value = np.empty(len(at), depth_kind)
            value[0] = min(depth, cap)
            if len(at) > 1:
                value[1:] = 1 + _least_between(np.asarray(prefix[lo:hi]), at[:-1] + 1, at[1:] + 1)
            queue[hi : hi + len(at)] = left
            prefix[hi : hi + len(at)] = np.minimum(value, cap)
            lo, hi, depth = hi, hi + len(at), depth + 1
        head[s] = max(hi, int(head[s]))
        own, own_lcp = np.asarray(queue[bounds[s] : head[s]]), np.asarray(prefix[bounds[s] : head[s]])
        a, b = int(seed_bounds[s]), int(seed_bounds[s + 1])
        more, more_lcp = np.asarray(seeds[a:b]), np.asarray(seed_lcp[a:b]).astype(depth_kind)
        if len(own) and len(more):
            more_lcp = more_lcp.copy()
            more_lcp[0] = _common(text, own[-1:], more[:1], np.zeros(1, np.int64), cap)[0]
        if len(own) or len(more):
            put(np.concatenate([own, more]), np.concatenate([own_lcp, more_lcp]), s)
    return queue, prefix, bounds


def suffix_order(text: np.ndarray, cap: int, store: Store | None = None, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes of ``text`` (non-negative integers) in order, and common prefixes with the one before."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    own = store is None
    store = store or Store()
    sigma = int(text.max()) + 1
    # types: S if the next different symbol is greater; the last suffix is L
    small = _position(n + cap)
    is_s = np.zeros(n, bool)
    for hi in range(n - 1, 0, -STRETCH):
        lo = max(0, hi - STRETCH)
        part = text[lo : hi + 1]
        up, same = part[1:] > part[:-1], part[1:] == part[:-1]
        far = hi - lo  # equal up to the next stretch, which is known
        nearest = np.minimum.accumulate(np.where(same, far, np.arange(far))[::-1])[::-1]
        is_s[lo:hi] = np.where(nearest < far, up[np.minimum(nearest, far - 1)], is_s[hi])
    star = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(small)
    m = len(star)
    names_cap = cap // 2 + 1  # a piece goes two symbols on at least
    if m > 1:
        name = _names(text, star, np.append(star[1:], small(n)), sigma)
        if int(name.max()) + 1 == m:
            order = np.empty(m, small)
            order[name] = np.arange(m, dtype=small)
            shared = np.zeros(m, small)
        elif m <= in_memory:
            order, shared = _doubling(name, names_cap)
        else:
            base = int(np.ceil(np.sqrt(int(name.max()) + 1)))
            digits = np.stack([name // base, name % base], axis=1).reshape(-1).astype(np.int32)
            two_order, two_lcp = suffix_order(digits, 2 * names_cap, store, in_memory)
            del digits
            even = np.flatnonzero(two_order % 2 == 0)
            order = two_order[even] // 2
            shared = np.zeros(m, small)
            shared[1:] = _least_between(two_lcp, even[:-1] + 1, even[1:] + 1) // 2
        del name
        ends = np.append(star, small(n))
        star_sorted = star[order]
        reach = ends[np.minimum(order[1:] + shared[1:], m)] - star_sorted[1:]
        del order, shared, ends
        star_lcp = np.zeros(m, np.int16)
        star_lcp[1:] = _common(text, star_sorted[:-1], star_sorted[1:], reach, cap)
        del reach
    else:
        star_sorted, star_lcp = star, np.zeros(m, np.int16)
    s_counts = np.bincount(text[is_s], minlength=sigma)
    l_counts = np.bincount(text[~is_s], minlength=sigma)
    star_bounds = np.concatenate([[0], np.cumsum(np.bincount(text[star], minlength=sigma))])
    del star
    l_queue, l_lcp, l_bounds = _scan(text, store, True, is_s, l_counts, star_sorted, star_lcp, star_bounds, cap)
    # the second scan meets the L-suffixes in falling order
    down, down_lcp = l_queue[::-1], np.concatenate([np.zeros(1, l_lcp.dtype), l_lcp[:0:-1]]) if len(l_lcp) else l_lcp
    del star_sorted, star_lcp
    down_bounds = len(l_queue) - l_bounds[::-1]
    s_queue, s_lcp, s_bounds = _scan(text, store, False, is_s, s_counts, down, down_lcp, down_bounds, cap)
    order, lcp = store.array(n, small), store.array(n, np.int16)
    at = 0
    for symbol in np.flatnonzero(l_counts + s_counts).tolist():
        a, b = int(l_bounds[symbol]), int(l_bounds[symbol + 1])
        k = sigma - 1 - symbol
        c, d = int(s_bounds[k]), int(s_bounds[k + 1])
        order[at : at + b - a], lcp[at : at + b - a] = l_queue[a:b], l_lcp[a:b]
        if b > a:
            lcp[at] = 0
        mid = at + b - a
        end = mid + d - c
        if d > c:
            order[mid:end] = s_queue[c:d][::-1]
            lcp[mid + 1 : end] = s_lcp[c + 1 : d][::-1]
            lcp[mid] = _common(text, np.asarray(order[mid - 1 : mid]), np.asarray(order[mid : mid + 1]), np.zeros(1, np.int64), cap)[0] if b > a else 0
        at = end
    if own:
        store.close()
    return order, lcp
