"""A piece vocabulary as a unigram model, and best segmentations by a trie of pre-tokens or by max-plus chunks.

Inside the models a space is the byte 0xFF, which UTF-8 never uses, and a text that isn't empty begins with one. Pieces
hold 0xFF at their front only, so no piece crosses from one pre-token (spaces, then other bytes) into the next. Bytes
that no piece covers are byte tokens.
"""

from __future__ import annotations

import numpy as np

from .text import byte_sums, range_hash

SPACE = 0xFF
#: Pre-tokens longer than this many bytes are first cut where no piece reaches over: their parts go into the trie.
LONG = 64
#: Bytes of long pre-tokens whose pieces are looked up at a time.
LOOKUP = 1 << 16
_BITS = 20
NEVER = -1e30


class Pieces:
    """Piece i is bytes[i] with a log probability from its rank by Zipf's law; pieces are ranked as in the file.

    A byte token scores ``BYTE_PENALTY`` below the last piece, so it is only used where no piece fits.
    """

    BYTE_PENALTY, OFFSET = 10.0, 2.7

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int64)
        ranked = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_unknown(i) or model.is_control(i)):
                own = piece.encode().replace("▁".encode(), bytes([SPACE]))
                if bytes([SPACE]) not in own[1:]:  # runs of spaces are single-space pieces
                    self.bytes[i] = own
                    ranked.append(i)
        rank = np.arange(len(ranked)) + self.OFFSET
        self.score = np.full(size, NEVER)
        # whole multiples of 2**-20, so that sums are exact and equal paths tie in whatever order they are added up
        self.score[ranked] = np.round((-np.log(rank) - np.log((1 / rank).sum())) * 2**20) / 2**20
        self.byte_score = float(self.score[ranked].min() - self.BYTE_PENALTY)
        self.score[self.byte_id] = self.byte_score
        self.table = {self.bytes[i]: i for i in reversed(ranked)}
        self.longest = max(map(len, self.table))
        lengths = np.array([len(b) for b in self.table])
        ids = np.array(list(self.table.values()))
        buf = np.frombuffer(b"".join(self.table), np.uint8)
        start = np.cumsum(lengths) - lengths
        h = range_hash(byte_sums(buf), start, start + lengths)
        order = np.argsort(h)
        self.hash, self.id = h[order], ids[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes])
        self.first = np.cumsum(self.size) - self.size

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces', and those pieces' ids."""
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        hit = self.hash[k] == h[at]
        return at[hit], self.id[k[hit]]

    def segment(self, word: bytes) -> tuple[float, list[int]]:
        """The best score and pieces of one byte string, by the plain recurrence; ties go to the longer last piece."""
        best, back = [0.0], [(0, -1)]
        for end in range(1, len(word) + 1):
            top = (best[end - 1] + self.byte_score, 1, int(self.byte_id[word[end - 1]])) if word[end - 1] != SPACE or bytes([SPACE]) not in self.table else (NEVER, 1, -1)
            for n in range(1, min(self.longest, end) + 1):
                i = self.table.get(word[end - n : end])
                if i is not None and best[end - n] + self.score[i] >= top[0]:
                    top = (best[end - n] + self.score[i], n, i)
            best.append(top[0])
            back.append(top[1:])
        out, at = [], len(word)
        while at:
            out.append(back[at][1])
            at -= back[at][0]
        return best[-1], out[::-1]

    def matches(self, raw: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, id) of the pieces in raw that end behind low and up to high, by end, then length."""
        begin = max(0, low - self.longest)
        pre, found = byte_sums(raw[begin:high]), []
        for n in range(1, min(self.longest, high) + 1):
            end = np.arange(max(low + 1, n), high + 1)
            at, ids = self.find(range_hash(pre, end - n - begin, end - begin))
            found.append((end[at], np.full(len(at), n), ids))
        end, size, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((size, end))
        return end[order], size[order], ids[order]

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """The places inside raw that no piece reaches over: both sides are segmented independently."""
        over = np.zeros(len(raw) + 2, np.int64)
        for low in range(0, len(raw), LOOKUP):
            end, size, _ = self.matches(raw, low, min(len(raw), low + LOOKUP))
            np.add.at(over, end - size + 1, 1)
            np.add.at(over, end, -1)
        return np.flatnonzero(np.cumsum(over)[1 : len(raw)] == 0) + 1

    def segment_long(self, raw: np.ndarray) -> tuple[float, list[int]]:
        """Like segment(), for a long run in which pieces overlap without end: one step for each piece that occurs."""
        best, back, score = [0.0], [(0, -1)], self.score
        for low in range(0, len(raw), LOOKUP):
            high = min(len(raw), low + LOOKUP)
            ends, sizes, ids = self.matches(raw, low, high)
            first = np.searchsorted(ends, np.arange(low + 1, high + 2)).tolist()
            gain, sizes, ids, single = score[ids].tolist(), sizes.tolist(), ids.tolist(), self.byte_id[raw[low:high]].tolist()
            for k in range(high - low):
                end = low + k + 1
                top, n, i = best[end - 1] + self.byte_score, 1, single[k]
                for m in range(first[k], first[k + 1]):
                    value = best[end - sizes[m]] + gain[m]
                    if value >= top:
                        top, n, i = value, sizes[m], ids[m]
                best.append(top)
                back.append((n, i))
        out, at = [], len(raw)
        while at:
            n, i = back[at]
            out.append(i)
            at -= n
        return best[-1], out[::-1]


def model_bytes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the models read them: one 0xFF before each text that isn't empty, and 0xFF for each space."""
    full = np.diff(offsets) > 0
    out = np.insert(np.where(buf == 32, np.uint8(SPACE), buf), offsets[:-1][full], SPACE)
    return out, offsets + np.concatenate([[0], np.cumsum(full)])


class Tokens:
    """The pre-tokens of some texts, each distinct one segmented once over a trie of all.

    Pre-tokens of more than ``LONG`` bytes are cut into units where no piece reaches over; others are units. ``which[t]``
    is the distinct unit of unit t, ``first`` tells which units a text has, ``n_pretokens`` how many pre-tokens;
    ``score`` and ``count`` are per distinct unit, ``ids()`` gives their pieces.
    """

    def __init__(self, pieces: Pieces, buf: np.ndarray, offsets: np.ndarray):
        self.pieces = pieces
        raw, offsets = model_bytes(buf, offsets)
        gap = raw == SPACE
        head = np.zeros(len(raw) + 1, bool)
        head[:-1][gap] = True
        head[1:-1] &= ~(gap[1:] & gap[:-1])
        head[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(head[:-1])
        end = np.append(start[1:], len(raw)) if len(start) else start
        self.n_pretokens = np.diff(np.searchsorted(start, offsets))
        for t in np.flatnonzero(end - start > LONG):
            head[start[t] + pieces.cuts(raw[start[t] : end[t]])] = True
        start = np.flatnonzero(head[:-1])
        end = np.append(start[1:], len(raw)) if len(start) else start
        self.first = np.searchsorted(start, offsets)
        pre = byte_sums(raw)
        h = range_hash(pre, start, end)
        _, self.rep, self.which = np.unique(h, return_index=True, return_inverse=True)
        self.raw, self.start, self.size = raw, start[self.rep], (end - start)[self.rep]
        n = len(self.rep)
        self.score, self.count = np.zeros(n), np.zeros(n, np.int64)
        self._trie(pre)
        self.long: dict[int, list[int]] = {}
        for t in np.flatnonzero(self.size > LONG):
            self.score[t], own = pieces.segment_long(raw[self.start[t] : self.start[t] + self.size[t]])
            self.long[int(t)], self.count[t] = own, len(own)

    def _trie(self, pre: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds the trie's nodes depth by depth: a prefix that pre-tokens share is one node, scored once."""
        p = self.pieces
        nodes = int(np.minimum(self.size, LONG).sum()) + 1
        best, count = np.zeros(nodes), np.zeros(nodes, np.int32)
        self.parent, self.source, self.piece = (np.zeros(nodes, np.int32) for _ in range(3))
        self.terminal = np.zeros(len(self.size), np.int64)
        live = np.flatnonzero(self.size <= LONG)
        node, made, depth = np.zeros(len(live), np.int64), 1, 0
        while len(live):
            depth += 1
            _, rep, which = np.unique(range_hash(pre, self.start[live], self.start[live] + depth), return_index=True, return_inverse=True)
            own = made + np.arange(len(rep))
            made += len(rep)
            self.parent[own] = node[rep]
            end = self.start[live[rep]] + depth
            byte = self.raw[end - 1]
            above = self.parent[own]
            top, source = best[above] + p.byte_score, above.copy()
            piece, tokens = p.byte_id[byte], count[above] + 1
            for n in range(1, min(depth, p.longest) + 1):
                at, ids = p.find(range_hash(pre, end - n, end))
                value = best[above[at]] + p.score[ids]
                win = value >= top[at]
                at, ids = at[win], ids[win]
                top[at], source[at], piece[at], tokens[at] = value[win], above[at], ids, count[above[at]] + 1
                above = self.parent[above]
            best[own], count[own], self.source[own], self.piece[own] = top, tokens, source, piece
            node = own[which]
            done = self.size[live] == depth
            self.terminal[live[done]] = node[done]
            live, node = live[~done], node[~done]
        short = self.size <= LONG
        self.score[short], self.count[short] = best[self.terminal[short]], count[self.terminal[short]]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's units of a value per distinct unit."""
        total = np.concatenate([[0], np.cumsum(values[self.which])])
        return total[self.first[1:]] - total[self.first[:-1]]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of all texts in order, and where each text's begin."""
        place = np.cumsum(self.count) - self.count
        out = np.zeros(int(self.count.sum()), np.int32)
        live = np.flatnonzero(self.size <= LONG)
        node, at = self.terminal[live], (place + self.count - 1)[live]
        while len(node):
            out[at] = self.piece[node]
            node, at = self.source[node], at - 1
            more = node != 0
            node, at = node[more], at[more]
        for t, own in self.long.items():
            out[place[t] : place[t] + len(own)] = own
        n = self.count[self.which]
        flat = out[np.repeat(place[self.which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return flat, np.concatenate([[0], np.cumsum(n)])[self.first]


def chunk_scores(pieces: Pieces, chunks: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For tokens that begin in the first end bytes of each chunk (raw, end): score and id by (place, length - 1, chunk).

    NEVER stands where there is no token, and behind the end of a shorter chunk.
    """
    n = max(end for _, end in chunks)
    score = np.full((n, pieces.longest, len(chunks)), NEVER)
    ids = np.zeros(score.shape, np.int32)
    for c, (raw, end) in enumerate(chunks):
        pre, at = byte_sums(raw), np.arange(end)
        ids[:end, 0, c] = pieces.byte_id[raw[:end]]
        score[:end, 0, c] = np.where(raw[:end] == SPACE, NEVER, pieces.byte_score)
        for size in range(1, pieces.longest + 1):
            own = at[at + size <= len(raw)]
            hit, found = pieces.find(range_hash(pre, own, own + size))
            better = pieces.score[found] >= score[hit, size - 1, c]
            score[hit[better], size - 1, c], ids[hit[better], size - 1, c] = pieces.score[found[better]], found[better]
    return score, ids


def forward(score: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-plus pass over chunks of one stack: entry (longest, k, chunk) are scores at the first places, for k cases at once.

    Returns best scores by (place, case, chunk), ``longest`` places beyond too, and the last token's length (0: entered
    here). Ties go to the longer token.
    """
    n, longest = score.shape[:2]
    best = np.full((n + longest, *entry.shape[1:]), NEVER)
    best[:longest] = entry[: len(best)]
    back = np.zeros(best.shape, np.int8)
    sizes = np.broadcast_to(np.arange(1, longest + 1, dtype=np.int8)[:, None, None], (longest, *entry.shape[1:]))
    for i in range(n):
        value = best[i] + score[i][:, None]
        better = value > best[i + 1 : i + 1 + longest]
        np.copyto(best[i + 1 : i + 1 + longest], value, where=better)
        np.copyto(back[i + 1 : i + 1 + longest], sizes, where=better)
    return best, back


def transfers(pieces: Pieces, chunks: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """Boundary-state matrices of chunks: from a token that ends i bytes behind the start to one that ends j behind the end."""
    entry = np.full((pieces.longest, pieces.longest, len(chunks)), NEVER)
    entry[np.arange(pieces.longest), np.arange(pieces.longest)] = 0.0
    best, _ = forward(chunk_scores(pieces, chunks)[0], entry)
    return [best[end : end + pieces.longest, :, c].T for c, (_, end) in enumerate(chunks)]


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices; associative."""
    return (a[:, :, None] + b[None]).max(1)


def entered(pieces: Pieces, chunks: list[tuple[np.ndarray, int]], entry: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids by (place, length - 1, chunk), and the last token's length at each place, given the scores of a chunk's entry states."""
    score, ids = chunk_scores(pieces, chunks)
    _, back = forward(score, np.stack(entry, 1)[:, None, :])
    return ids, back[:, 0]


def stops(pieces: Pieces, chunks: list[tuple[np.ndarray, int]], entry: list[np.ndarray]) -> list[np.ndarray]:
    """For each state that a chunk's best paths may leave in, the state in which they entered."""
    _, back = entered(pieces, chunks, entry)
    out = []
    for c, (_, end) in enumerate(chunks):
        at = end + np.arange(pieces.longest)
        while len(live := np.flatnonzero(back[at, c])):
            at[live] -= back[at[live], c]
        out.append(at.astype(np.uint8))
    return out


def backtraces(pieces: Pieces, chunks: list[tuple[np.ndarray, int]], entry: list[np.ndarray], leave: list[int]) -> list[np.ndarray]:
    """The pieces of each chunk's best path that leaves in the given state; ties go to the longer last piece."""
    ids, back = entered(pieces, chunks, entry)
    out = []
    for c, (_, end) in enumerate(chunks):
        own, at = [], end + leave[c]
        while size := int(back[at, c]):
            at -= size
            own.append(ids[at, size - 1, c])
        out.append(np.array(own[::-1], np.int32))
    return out


def decode(pieces: Pieces, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and offsets for runs of ids that begin at first."""
    n = pieces.size[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    raw = pieces.flat[np.repeat(pieces.first[ids] - total[:-1], n) + np.arange(total[-1])]
    offsets = total[first]
    full = np.diff(offsets) > 0
    raw = np.delete(raw, offsets[:-1][full])
    return np.where(raw == SPACE, np.uint8(32), raw), offsets - np.concatenate([[0], np.cumsum(full)])
