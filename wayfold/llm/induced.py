"""External induced suffix sorting with common prefixes, depth-limited, in numpy batches.

Suffixes are L or S by their first change of character; LMS suffixes (S after L) seed the order of all others. A scan in
sorted order pushes each suffix's left neighbour to the queue of its first character; since pushes to a queue come in
sorted order, the queues together are the monotone priority queue of external induced sorting, and each entry carries
its common prefix with the entry before it: one more than the least common prefix the scan passed since the last push
there. The queues keep at most ``memory`` bytes and write the rest, largest queue first, to an unlinked temporary file
that is read back in order. Two inductions order the LMS substrings and then everything; between them the reduced string
of substring names is ranked by doubling, up to the depth that counts (``limit`` characters), which ends the recursion.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .shared import mix, powers


class Queues:
    """FIFO queues of (position, common prefix) batches by character, over a memory bound on disk."""

    def __init__(self, kinds: int, memory: int):
        self.lists: list[list] = [[] for _ in range(kinds)]
        self.size = [0] * kinds
        self.total, self.memory, self.file, self.spilled = 0, memory, None, 0

    def push(self, kind: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.lists[kind].append((at, lcp))
        self.size[kind] += at.nbytes + lcp.nbytes
        self.total += at.nbytes + lcp.nbytes
        while self.total > self.memory:
            self._spill(max(range(len(self.size)), key=self.size.__getitem__))

    def _spill(self, kind: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        kept = []
        for item in self.lists[kind]:
            if len(item) == 2:
                self.file.seek(0, 2)
                item = (self.file.tell(), len(item[0]), None)
                at, lcp = self.lists[kind][len(kept)]
                self.file.write(at.tobytes())
                self.file.write(lcp.tobytes())
                self.spilled += at.nbytes
            kept.append(item)
        self.lists[kind] = kept
        self.total -= self.size[kind]
        self.size[kind] = 0

    def pop(self, kind: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All entries of a queue in the order they came."""
        items, self.lists[kind] = self.lists[kind], []
        if not items:
            return None
        self.total -= self.size[kind]
        self.size[kind] = 0
        out = []
        for item in items:
            if len(item) == 3:
                self.file.seek(item[0])
                item = (np.frombuffer(self.file.read(4 * item[1]), np.int32), np.frombuffer(self.file.read(item[1]), np.uint8))
            out.append(item)
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True for S; the last character is the least and unlike all others."""
    step = np.sign(np.diff(text.astype(np.int32)))
    change = np.flatnonzero(step)
    out = np.ones(len(text), bool)
    out[:-1] = step[change[np.searchsorted(change, np.arange(len(step)))]] > 0
    return out


def _common(text: np.ndarray, a: int, b: int, limit: int) -> int:
    """Common prefix of two suffixes, up to the limit."""
    n = min(limit, len(text) - max(a, b))
    diff = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(diff[0]) if len(diff) else n


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes by binary search over prefix hashes."""
    up, down = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(77)) * up[: len(text)], out=total[1:])
    most = np.minimum(limit, len(text) - np.maximum(a, b))
    low = np.zeros(len(a), np.int64)
    width = 1 << max(0, limit.bit_length() - 1)
    while width:
        mid = low + width
        ok = np.flatnonzero(mid <= most)
        x, y, m = a[ok], b[ok], mid[ok]
        same = (total[x + m] - total[x]) * down[x] == (total[y + m] - total[y]) * down[y]
        low[ok[same]] = m[same]
        width >>= 1
    return low


class _Push:
    """Left neighbours of a scan to their queues, with the least common prefix passed since the last push."""

    def __init__(self, text, wanted, queues, limit, track):
        self.text, self.wanted, self.queues, self.limit, self.track = text, wanted, queues, limit, track
        self.passed = np.full(len(queues.lists), 255, np.int64)
        self.fresh = np.ones(len(queues.lists), bool)

    def __call__(self, at: np.ndarray, lcp: np.ndarray) -> None:
        left = at - 1
        go = np.flatnonzero((at > 0) & self.wanted[left])
        targets = self.text[left[go]]
        if self.track and len(at):
            least = int(lcp.min())
        for t in np.unique(targets):
            index = go[targets == t]
            if not self.track:
                self.queues.push(int(t), left[index], np.zeros(len(index), np.uint8))
                continue
            border = np.concatenate([[0], index + 1])
            open_end = border[-1] == len(lcp)
            mins = np.minimum.reduceat(lcp, border[:-1] if open_end else border).astype(np.int64)
            tail = 255 if open_end else int(mins[-1])
            mins = mins[: len(index)].copy()
            mins[0] = min(mins[0], self.passed[t])
            value = np.minimum(mins + 1, self.limit)
            if self.fresh[t]:
                value[0], self.fresh[t] = 0, False
            self.queues.push(int(t), left[index], value.astype(np.uint8))
            self.passed[t] = tail
            done = True
        if self.track and len(at):
            others = np.ones(len(self.passed), bool)
            others[np.unique(targets)] = False
            self.passed[others] = np.minimum(self.passed[others], least)


def _induce(text, is_s, seeds, seed_lcp, limit, memory, track):
    """Order and common prefixes of all suffixes from the sorted LMS suffixes."""
    kinds = int(text.max()) + 1
    head = text[seeds]
    first = np.searchsorted(head, np.arange(kinds + 1))
    none = np.zeros(0, np.int32), np.zeros(0, np.uint8)
    queues = Queues(kinds, memory)
    push = _Push(text, ~is_s, queues, limit, track)
    ls: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(kinds):
        got = []
        while (batch := queues.pop(c)) is not None:
            got.append(batch)
            push(*batch)
        mine = (np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])) if got else none
        ls.append(mine)
        if first[c] < first[c + 1]:
            own = seed_lcp[first[c] : first[c + 1]].copy()
            own[0] = _common(text, int(mine[0][-1]), int(seeds[first[c]]), limit) if track and len(mine[0]) else 0
            push(seeds[first[c] : first[c + 1]], own)
    queues.close()
    spilled = queues.spilled
    queues = Queues(kinds, memory)
    push = _Push(text, is_s, queues, limit, track)
    orders, lcps = [], []
    for c in range(kinds - 1, -1, -1):
        got = []
        while (batch := queues.pop(c)) is not None:
            got.append(batch)
            push(*batch)
        down = (np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])) if got else none
        if c == 0:  # the last character stands alone
            down = np.array([len(text) - 1], np.int32), np.zeros(1, np.uint8)
        at, lcp = ls[c]
        border = _common(text, int(at[-1]), int(down[0][-1]), limit) if track and len(at) and len(down[0]) else 0
        if len(at):
            push(at[::-1], np.concatenate([np.array([border], np.uint8), lcp[:0:-1]]))
        up = np.concatenate([np.array([border], np.uint8), down[1][:0:-1]]) if len(down[0]) else none[1]
        orders.append(np.concatenate([at, down[0][::-1]]))
        lcps.append(np.concatenate([lcp, up]))
    queues.close()
    return np.concatenate(orders[::-1]), np.concatenate(lcps[::-1]), spilled + queues.spilled


def suffix_order(text: np.ndarray, limit: int, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions in suffix order to depth ``limit``, common prefix with the entry before up to ``limit``, bytes spilled).

    ``text`` is an array of small integers that ends in a 0 found nowhere else; ``limit`` is 254 at most."""
    is_s = _types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + np.int32(1)
    if len(lms) > 1:
        seeds = lms[np.argsort(text[lms], kind="stable")]
        order, _, spilled = _induce(text, is_s, seeds, np.zeros(len(seeds), np.uint8), limit, memory, False)
        place = np.full(len(text), -1, np.int64)
        place[lms] = np.arange(len(lms))
        number = place[order]
        number = number[number >= 0]
        end = np.append(lms[1:] + 1, len(text)).astype(np.int64)  # a substring ends with the next LMS character
        up, down = powers(len(text) + 1)
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mix(text.astype(np.uint64) + np.uint64(77)) * up[: len(text)], out=total[1:])
        names = (total[end] - total[lms]) * down[lms]
        length = end - lms
        a, b = number[:-1], number[1:]
        new = (names[a] != names[b]) | (length[a] != length[b])
        rank = np.zeros(len(lms), np.int64)
        rank[number] = np.concatenate([[0], np.cumsum(new)])
        step, kinds = 1, int(rank.max()) + 1
        while kinds < len(lms) and step <= limit // 2:
            nxt = np.zeros(len(lms), np.int64)
            nxt[:-step] = rank[step:] + 1
            found, rank = np.unique(rank * (len(lms) + 1) + nxt, return_inverse=True)
            step, kinds = step * 2, len(found)
        seeds = lms[np.argsort(rank, kind="stable")]
    else:
        seeds, spilled = lms, 0
    lcp = np.zeros(len(seeds), np.uint8)
    if len(seeds) > 1:
        lcp[1:] = common_prefixes(text, seeds[:-1].astype(np.int64), seeds[1:].astype(np.int64), limit)
    order, lcp, more = _induce(text, is_s, seeds, lcp, limit, memory, True)
    return order, lcp, spilled + more
