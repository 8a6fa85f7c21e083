"""External induced suffix sorting of one shard, with common-prefix values.

A suffix is small if it is less than the one behind it, else large; small ones behind a large one are sampled. Sampled
suffixes are put in order by sorting the string of their substrings' names, by the same method, level by level. The large
suffixes are then induced from them in ascending order and the small ones from the large ones in descending order: a
suffix taken from the priority queue sends the suffix before it there, as a tuple of first character, place and (for bytes)
common prefix with the one sent to that character before. Nothing is sent below what is being taken, so the queue holds
ranges of characters, each first in, first out, and keeps only the range that is being taken in memory: the rest waits in an
unlinked file. Strings, kinds, names and orders of more than ``IN_MEMORY`` bytes are mapped from such files, too.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .text import _BASE, _BYTE, mix

#: Arrays above this size are mapped from unlinked temporary files.
IN_MEMORY = 8 << 20
#: Rows that a queue buffers before it writes them, rows of a range of several characters, rows taken at a time.
BUFFER, WINDOW, RUN = 1 << 18, 1 << 13, 1 << 16
#: Strings of names up to this length, which fit memory, are sorted directly: the recursion ends there.
SHORT = 1 << 20
_FAR = np.int32(1 << 30)


def room(n: int, dtype) -> np.ndarray:
    """An array in memory, or of a file that goes with it if it is large."""
    if n * np.dtype(dtype).itemsize <= IN_MEMORY:
        return np.empty(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


def blocks(n: int, size: int = 1 << 18):
    for at in range(0, n, size):
        yield at, min(n, at + size)


class Queue:
    """Rows (character, place, common prefix) by ranges of characters, each range in the order in which rows came."""

    def __init__(self, counts: np.ndarray):
        # a range holds one frequent character, or several that are rare
        total = np.concatenate([[0], np.cumsum(counts)])
        edges = [0]
        while edges[-1] < len(counts):
            edges.append(max(edges[-1] + 1, int(np.searchsorted(total, total[edges[-1]] + WINDOW, "right")) - 1))
        self.edges = np.array(edges)
        if len(counts) <= 256:
            self.edges = np.arange(len(counts) + 1)
        self.held: list[list[np.ndarray]] = [[] for _ in self.edges[1:]]
        self.written: list[list[tuple[int, int]]] = [[] for _ in self.edges[1:]]
        self.size, self.file = 0, None

    def put(self, char: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        """Rows in ascending order of their characters."""
        rows = np.stack([char, place, common], 1).astype(np.int64)
        cuts = np.searchsorted(char, self.edges[1:-1])
        cuts = np.concatenate([[0], cuts, [len(char)]])
        for r in np.flatnonzero(np.diff(cuts)):
            self.held[r].append(rows[cuts[r] : cuts[r + 1]])
        self.size += len(rows)
        if self.size > BUFFER:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        end = self.file.seek(0, 2)
        for r, held in enumerate(self.held):
            if held:
                rows = np.concatenate(held)
                self.file.write(rows.tobytes())
                self.written[r].append((end, len(rows)))
                end += rows.nbytes
                held.clear()
        self.size = 0

    def take(self, r: int):
        """The rows of a range, also those that come while others are worked on, some at a time."""
        while self.written[r] or self.held[r]:
            if self.written[r]:
                at, n = self.written[r].pop(0)
                for a, b in blocks(n, RUN):
                    self.file.seek(at + a * 24)
                    yield np.frombuffer(self.file.read((b - a) * 24), np.int64).reshape(-1, 3)
            else:
                rows = np.concatenate(self.held[r])
                self.size -= len(rows)
                self.held[r].clear()
                for a, b in blocks(len(rows), RUN):
                    yield rows[a:b]


class Order:
    """Suffixes in order: places, common prefixes with the one before, and where each character's begin."""

    def __init__(self, kinds: int, n: int):
        self.place, self.common, self.count, self.n = room(n, np.int64), room(n, np.int32), np.zeros(kinds, np.int64), 0

    def put(self, char: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        self.place[self.n : self.n + len(place)] = place
        self.common[self.n : self.n + len(place)] = common
        self.n += len(place)
        np.add.at(self.count, char, 1)

    def done(self) -> Order:
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        return self

    def read(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.place[a:b], self.common[a:b]


class Backward:
    """An order from its end, by characters that count down; the first common prefix of a character isn't told."""

    def __init__(self, order: Order):
        self.order, self.first = order, order.n - order.first[::-1]

    def read(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.order.n
        common = np.zeros(b - a, np.int32)
        skip = int(a == 0)
        common[skip:] = self.order.common[n - b + 1 : n - a + 1][::-1][skip:] if not skip else self.order.common[n - b + 1 : n][::-1]
        return self.order.place[n - b : n - a][::-1], common


class Level:
    """A string of characters below kinds, bytes or names, whose last one is least."""

    def __init__(self, s: np.ndarray, kinds: int, cap: int):
        self.s, self.kinds, self.cap, n = s, kinds, cap, len(s)
        self.small = room(n, bool)
        self.count = np.zeros(kinds, np.int64)
        behind, char = True, None
        for a, b in reversed(list(blocks(n))):
            own = np.asarray(s[a:b]).astype(np.int64)
            self.count += np.bincount(own, minlength=kinds)
            after = np.append(own[1:], char if char is not None else own[-1])
            at = np.flatnonzero(own != after)
            # by the first character that differs, in the block or behind it
            nearest = np.searchsorted(at, np.arange(b - a))
            self.small[a:b] = np.append((own < after)[at], behind)[nearest]
            behind, char = bool(self.small[a]), int(own[0])
        parts = []
        for a, b in blocks(n):
            first = self.small[max(0, a - 1) : b]
            own = np.flatnonzero(first[1:] & ~first[:-1]) + max(1, a)
            parts.append(own)
        last = [] if any(len(p) and p[-1] == n - 1 for p in parts) else [np.array([n - 1])]
        size = sum(map(len, parts)) + len(last)
        self.sampled, at = room(size, np.int64), 0
        for p in parts + last:
            self.sampled[at : at + len(p)] = p
            at += len(p)
        # prefix sums of a polynomial hash
        self.sum, carry, low, high = room(n + 1, np.uint64), np.uint64(0), *_steps(_BASE)
        self.sum[0] = 0
        for a, b in blocks(n):
            value = _BYTE[s[a:b]] if kinds <= 256 else mix(np.asarray(s[a:b]).astype(np.uint64) + np.uint64(1))
            own = np.cumsum(value * _power(low, high, np.arange(a, b))) + carry
            self.sum[a + 1 : b + 1], carry = own, own[-1]

    def hash(self, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sum[a + size] - self.sum[a]) * _power(*_DOWN, a)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes, up to cap, by bisection over hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.cap, len(self.s) - np.maximum(a, b)).astype(np.int64)
        for reach in (8, 32, self.cap):
            # most pairs differ soon
            tried = np.flatnonzero(low < high)
            goal = np.minimum(reach, high[tried])
            goal = np.maximum(goal, low[tried])
            equal = self.hash(a[tried], goal) == self.hash(b[tried], goal)
            low[tried[equal]] = goal[equal]
            high[tried[~equal]] = goal[~equal] - 1
            while len(live := tried[~equal][low[tried[~equal]] < high[tried[~equal]]]):
                mid = (low[live] + high[live] + 1) // 2
                same = self.hash(a[live], mid) == self.hash(b[live], mid)
                low[live[same]], high[live[~same]] = mid[same], mid[~same] - 1
        return low.astype(np.int32)

    def by_character(self, place: np.ndarray) -> Order:
        """Suffixes by their first character, else as they come."""
        queue, order = Queue(self.count), Order(self.kinds, len(place))
        for a, b in blocks(len(place)):
            own = np.asarray(place[a:b])
            char = np.asarray(self.s[own]).astype(np.int64)
            at = np.argsort(char, kind="stable")
            queue.put(char[at], own[at], np.zeros(b - a, np.int64))
        for r in range(len(queue.edges) - 1):
            if queue.edges[r + 1] - queue.edges[r] == 1:
                for rows in queue.take(r):
                    order.put(rows[:, 0], rows[:, 1], rows[:, 2])
            elif found := list(queue.take(r)):
                rows = np.concatenate(found)
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                order.put(rows[:, 0], rows[:, 1], rows[:, 2])
        return order.done()

    def induce(self, seeds: Order | Backward, small: bool, tell: bool) -> Order:
        """One pass: from sorted seeds all suffixes of the other kind, ascending large ones or descending small ones.

        Without tell the order is all that counts, and common prefixes are left at 0.
        """
        flip = self.kinds - 1 if small else 0
        char = (lambda at: flip - np.asarray(self.s[at]).astype(np.int64)) if small else (lambda at: np.asarray(self.s[at]).astype(np.int64))
        queue = Queue(self.count[::-1] if small else self.count)
        out = Order(self.kinds, len(self.s))
        least = np.full(self.kinds if tell else 1, -1, np.int32)  # of the values since the last one sent to a character; -1: none was

        def before(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which rows send a suffix, and its character."""
            at = np.flatnonzero(place > 0)
            at = at[self.small[place[at] - 1] == small]
            return at, char(place[at] - 1)

        def send(place: np.ndarray, common: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
            order = np.argsort(to, kind="stable")
            to, at = to[order], at[order]
            if not tell:
                queue.put(to, place[at] - 1, np.zeros(len(at), np.int64))
                return
            if len(at):
                head = np.concatenate([[True], to[1:] != to[:-1]])
                cuts = np.append(np.flatnonzero(head), len(to))
                begin = np.where(head, 0, np.concatenate([[0], at[:-1] + 1]))
                spans = np.stack([begin, at + 1], 1).ravel()
                value = np.minimum.reduceat(np.append(common, _FAR), spans)[::2]
                value[head] = np.minimum(value[head], least[to[head]])
                queue.put(to, place[at] - 1, np.minimum(value + 1, self.cap))
                rest = np.append(np.minimum.accumulate(common[::-1])[::-1], _FAR)
            np.minimum(least, common.min(), out=least)
            if len(at):
                least[to[cuts[1:] - 1]] = rest[at[cuts[1:] - 1] + 1]

        for r in range(len(queue.edges) - 1):
            low, high = int(queue.edges[r]), int(queue.edges[r + 1])
            first, end = int(seeds.first[low]), int(seeds.first[high])
            if high - low == 1:
                last = None
                for rows in queue.take(r):
                    place, common = rows[:, 1], rows[:, 2].astype(np.int32)
                    out.put(rows[:, 0], place, common)
                    send(place, common, *before(place))
                    last = place[-1:]
                for a in range(first, end, RUN):
                    place, common = (np.array(x) for x in seeds.read(a, min(end, a + RUN)))
                    if a == first:
                        common[0] = 0 if last is None or not tell else self.shared(last, place[:1])[0]
                    send(place, common, *before(place))
            else:
                self.window(queue, r, seeds.read(first, end)[0], char, before, send, out)
        return out.done()

    def window(self, queue: Queue, r: int, seeds: np.ndarray, char, before, send, out: Order) -> None:
        """Takes a range of several characters from the queue: runs of rows up to where one of them sends one into the range."""
        high = int(queue.edges[r + 1])
        rows = list(queue.take(r))
        place = np.concatenate([*(x[:, 1] for x in rows), seeds]).astype(np.int64)
        seed = np.arange(len(place)) >= len(place) - len(seeds)
        # a character's seeds come after what was sent to it
        key = char(place) * 2 + seed
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        step = 64
        while len(key):
            own, k = place[:step], key[:step]
            at, to = before(own)
            into = np.full(len(own), 2 * high, np.int64)
            into[at] = np.where(to < high, 2 * to, 2 * high)
            soonest = np.minimum.accumulate(into)
            # rows before which a sent one belongs have to wait
            late = np.flatnonzero(k[1:] > soonest[:-1])
            n = int(late[0]) + 1 if len(late) else len(own)
            step = 4 * n
            sent = at < n
            at, to = at[sent], to[sent]
            taken = own[:n][k[:n] % 2 == 0]
            out.put(k[:n][k[:n] % 2 == 0] // 2, taken, np.zeros(len(taken), np.int32))
            far = to >= high
            send(own, np.zeros(len(own), np.int32), at[far], to[far])
            new, to = own[at[~far]] - 1, to[~far] * 2
            if not len(new):
                key, place = key[n:], place[n:]
                continue
            order = np.argsort(to, kind="stable")
            where = np.searchsorted(key[n:], to[order], "right")
            key, place = np.insert(key[n:], where, to[order]), np.insert(place[n:], where, new[order])

    def sort_sampled(self) -> np.ndarray:
        """The sampled suffixes in order: induced by their substrings first, then by the order of the names' string."""
        s, n = self.sampled, len(self.s)
        small = self.induce(Backward(self.induce(self.by_character(s), False, False)), True, False)
        name, rank, before = room(len(s), np.int64), 0, None
        name[len(s) - 1] = 0
        for a, b in reversed(list(blocks(small.n))):
            place = np.array(small.place[a:b])[::-1]
            index = np.minimum(np.searchsorted(s, place), len(s) - 1)
            keep = (s[index] == place) & (index != len(s) - 1)
            place, index = place[keep], index[keep]
            if not len(place):
                continue
            size = np.minimum(s[index + 1] + 1, n) - place
            h = mix(self.hash(place, size) + size.astype(np.uint64))
            new = np.append(True if before is None else h[0] != before, h[1:] != h[:-1])
            name[index] = rank + np.cumsum(new)
            rank, before = rank + int(new.sum()), h[-1]
        if rank + 1 < len(s):
            return _gather(s, ordered(name, rank + 1))
        out = room(len(s), np.int64)
        out[name] = s
        return out

    def sorted(self, tell: bool) -> tuple[Order, Order]:
        """Large suffixes in ascending and small ones in descending order."""
        place = self.sort_sampled()
        seeds = Order(self.kinds, len(place))
        for a, b in blocks(len(place)):
            own = np.asarray(place[a:b])
            common = self.shared(np.asarray(place[max(0, a - 1) : b - 1]), own[int(a == 0) :]) if tell else np.zeros(b - a - int(a == 0), np.int32)
            seeds.put(np.asarray(self.s[own]).astype(np.int64), own, np.append(np.zeros(int(a == 0), np.int32), common))
        large = self.induce(seeds.done(), False, tell)
        return large, self.induce(Backward(large), True, tell)


def _gather(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = room(len(at), np.int64)
    for a, b in blocks(len(at)):
        out[a:b] = s[at[a:b]]
    return out


def _steps(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base with exponents below 2**16, and of multiples of 2**16 below 2**32."""
    out = []
    for b in (base, pow(base, 1 << 16, 2**64)):
        step = np.full(1 << 16, b, np.uint64)
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    return tuple(out)


def _power(low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    return low[k & 0xFFFF] * high[k >> 16]


_DOWN = _steps(pow(_BASE, -1, 2**64))


def ordered(s: np.ndarray, kinds: int) -> np.ndarray:
    """The order of all suffixes of a string of names below kinds."""
    n = len(s)
    if n <= SHORT:
        rank, span = np.asarray(s), 1
        while span < n and rank.max() < n - 1:
            pair = rank * (n + kinds + 1) + np.append(rank[span:] + 1, np.zeros(min(span, n), np.int64))
            rank = np.unique(pair, return_inverse=True)[1]
            span *= 2
        return np.argsort(rank, kind="stable")
    large, small = Level(s, kinds, 0).sorted(False)
    out, at = room(n, np.int64), 1
    out[0] = n - 1  # the last suffix is least, and no pass induces it
    back = Backward(small)
    # characters of few suffixes together, large ones before small ones
    total = large.first + (small.n - small.first[::-1])[: kinds + 1]
    low = 0
    while low < kinds:
        high = max(low + 1, int(np.searchsorted(total, total[low] + RUN, "right")) - 1)
        a, b = int(large.first[low]), int(large.first[high])
        c, d = int(back.first[low]), int(back.first[high])
        place = np.concatenate([large.place[a:b], back.read(c, d)[0]])
        char = np.concatenate([np.repeat(np.arange(low, high), np.diff(large.first[low : high + 1])), np.repeat(np.arange(low, high), np.diff(back.first[low : high + 1]))])
        out[at : at + len(place)] = place[np.argsort(char, kind="stable")]
        at += len(place)
        low = high
    return out


class Sorter:
    """Sorts the suffixes of a text of bytes, common prefixes up to cap told; its last byte is the least and ends regions."""

    def __init__(self, text: np.ndarray, cap: int):
        self.level, self.cap = Level(text, 256, cap), cap

    def repeated(self) -> np.ndarray:
        """Which places begin cap bytes that also begin elsewhere."""
        out = room(len(self.level.s), bool)
        out[:] = False
        large, small = self.level.sorted(True)
        for order in (large, small):
            for a, b in blocks(order.n):
                place, common = order.place[max(0, a - 1) : b], order.common[max(0, a - 1) : b]
                hit = common >= self.cap
                out[place[hit]] = True
                out[place[:-1][hit[1:]]] = True
        back = small.n - small.first[::-1]
        for byte in range(256):  # where the two kinds meet
            if large.count[byte] and small.count[255 - byte]:
                a = np.asarray(large.place[large.first[byte + 1] - 1 :][:1])
                b = np.asarray(small.place[small.n - int(back[byte]) - 1 :][:1])
                if self.level.shared(a, b)[0] >= self.cap:
                    out[a], out[b] = True, True
        return out
