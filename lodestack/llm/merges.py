"""Merge replay for byte-pair encodings.

All distinct words of a corpus slice are laid out in one symbol array.  An inverted
index from token pair (named by the rank of its merge) to positions is kept; merges are
applied in rank order, each to all of its positions at once, and only the neighbours of
merged positions are looked up again.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterable, Sequence

import numpy as np

NONE = np.iinfo(np.int32).max


class MergeTable:
    """Merges as sorted arrays: pair key, rank, id of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, ids: int):
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], rank[order].astype(np.int32)
        self.made = np.zeros(int(rank.max(initial=-1)) + 1, np.int32)
        self.made[rank] = made
        # The least rank of a merge in which a token takes part.  Where it is above the
        # rank that makes the token, all positions of a merge can be handled at once.
        least = np.full(ids, NONE, np.int64)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        self.at_once = least[self.made] > np.arange(len(self.made))
        self.first: np.ndarray | None = None
        self.last: np.ndarray | None = None
        self.whole: dict[bytes, int] = {}
        self.bytes_of: list[bytes] = []

    @classmethod
    def from_ranks(cls, path: str) -> MergeTable:
        """A rank file: base64 token and rank on each line."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        a, b, r = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                p, q = ranks.get(token[:cut]), ranks.get(token[cut:])
                if p is not None and q is not None:
                    a.append(p), b.append(q), r.append(rank)
        n = max(ranks.values()) + 1
        table = cls(np.array(a), np.array(b), np.array(r), np.array(r), n)
        table.first = table.last = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        table.whole = ranks
        table.bytes_of = [b""] * n
        for token, rank in ranks.items():
            table.bytes_of[rank] = token
        return table

    @classmethod
    def from_json(cls, path: str) -> MergeTable:
        """A tokenizer file whose words end with a suffix and whose bytes are printable characters."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a = np.array([vocab[p] for p, _ in pairs])
        b = np.array([vocab[q] for _, q in pairs])
        made = np.array([vocab[p + q] for p, q in pairs])
        table = cls(a, b, np.arange(len(pairs)), made, max(vocab.values()) + 1)
        shown = printable_bytes()
        table.first = np.array([vocab[shown[x]] for x in range(256)], np.int32)
        table.last = np.array([vocab[shown[x] + end] for x in range(256)], np.int32)
        return table

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where a pair never merges."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def encode(self, words: Sequence[bytes], kind: str = "<u4") -> list[bytes]:
        """Packed ids of each word.  Words that are tokens are themselves; empty ones have no ids."""
        whole = self.whole.get
        out = [b"" if (t := whole(w)) is None else t.to_bytes(4, "little") for w in words]
        rest = [i for i, w in enumerate(words) if w and not out[i]]
        if not rest:
            return out
        left = [words[i] for i in rest]
        lengths = np.fromiter(map(len, left), np.int64, len(left))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(left), np.uint8)
        symbols = self.first[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        alive = self._replay(symbols, ends, np.repeat(np.arange(len(rest), dtype=np.int32), lengths))
        ids = symbols[alive].astype(kind)
        upto = (np.cumsum(np.add.reduceat(alive, ends - lengths, dtype=np.int64)) * ids.itemsize).tolist()
        packed, begin = ids.tobytes(), 0
        for i, end in zip(rest, upto):
            out[i] = packed[begin:end]
            begin = end
        return out

    def _replay(self, sym: np.ndarray, ends: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Merge ``sym`` in place; true where a symbol is left."""
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[ends[:-1]] = -1
        alive = np.ones(n, bool)
        fresh = np.zeros(n, bool)
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after < n)
        rank[inner] = self.lookup(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            if not len(at):
                return
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for k, one in enumerate(r[np.concatenate(([0], cuts))].tolist()):
                if one in index:
                    index[one].append(at[bounds[k] : bounds[k + 1]])
                else:
                    index[one] = [at[bounds[k] : bounds[k + 1]]]
                    heapq.heappush(heap, one)

        post(inner)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if not self.at_once[r] and len(at) > 1:
                leftmost = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
                if not leftmost.all():
                    index[r] = [at[~leftmost]]
                    heapq.heappush(heap, r)
                    at = at[leftmost]
            if len(at) > 1:
                touching = at[1:] == after[at[:-1]]
                if touching.any():  # a run of one symbol: every second pair, from the left
                    spot = np.arange(len(at))
                    begins = np.concatenate(([True], ~touching))
                    at = at[(spot - np.maximum.accumulate(np.where(begins, spot, 0))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.made[r]
            alive[gone] = False
            rank[gone] = NONE
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            rank[at[~inside]] = NONE
            left = before[at]
            fresh[at] = True
            left = left[left >= 0]
            touched = np.concatenate((at[inside], left[~fresh[left]]))
            fresh[at] = False
            touched.sort()
            rank[touched] = self.lookup(sym[touched], sym[after[touched]])
            post(touched)
        return alive


class PairRanks:
    """Ranks of pairs by open addressing; keys are those of ``MergeTable``."""

    def __init__(self, key: np.ndarray, rank: np.ndarray):
        self.shift = 64 - max(4, int(len(key) * 4).bit_length())
        self.last = (1 << (64 - self.shift)) - 1
        self.key, self.rank = np.full(self.last + 1, -1, np.int64), np.full(self.last + 1, NONE, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.key[slot] < 0
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.key[slot[put]], self.rank[slot[put]] = key[put], rank[put]
            key, rank, slot = key[~put], rank[~put], slot[~put] + 1 & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where a pair never merges."""
        key = left.astype(np.int64) << 20 | right
        slot = self._slot(key)
        held = self.key[slot]
        found = np.where(held == key, self.rank[slot], NONE)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at = slot[open_] + 1 & self.last
            slot[open_], held = at, self.key[at]
            hit = held == key[open_]
            found[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit & (held >= 0)]
        return found


class ShortWords:
    """Merge replay for many short words: those of one length side by side, a column each.

    From the longest down, every word of that many symbols makes its next merge, of least rank and then leftmost, and goes on
    among the words with one symbol less; words without a merge are done.
    """

    #: Bytes of the longest words; a column's cost grows with the square of its length.
    MOST = 48

    def __init__(self, table: MergeTable):
        self.table, self.ranks = table, PairRanks(table.key, table.rank)

    def encode(self, raw: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of words of 1 to ``MOST`` bytes that begin at places of ``raw``, and all ids in their order."""
        n = np.zeros(len(lengths), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        word, sym, rank = np.zeros(0, np.int64), np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
        for length in range(int(lengths.max(initial=0)), 0, -1):
            own = np.flatnonzero(lengths == length)
            if len(own):
                own_sym = self._symbols(raw, begin[own], length)
                own_rank = self.ranks(own_sym[:-1].ravel(), own_sym[1:].ravel()).reshape(length - 1, len(own))
                if len(word):
                    word, sym, rank = np.concatenate((word, own)), np.concatenate((sym, own_sym), 1), np.concatenate((rank, own_rank), 1)
                else:
                    word, sym, rank = own, own_sym, own_rank
            if not len(word):
                continue
            at = self._next(rank)
            over = at < 0
            if over.any():
                n[word[over]] = length
                done.append((word[over], sym[:, over]))
                go = ~over
                word, sym, rank, at = word[go], sym[:, go], rank[:, go], at[go]
            if len(word):
                sym, rank = self._merged(sym, rank, at)
        first = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), "<u4")
        for w, s in done:
            for j, row in enumerate(s):
                ids[first[w] + j] = row
        return n, ids

    def _symbols(self, raw: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
        sym = np.empty((length, len(begin)), np.int32)
        for j in range(length):
            sym[j] = (self.table.first if j < length - 1 else self.table.last)[raw[begin + j]]
        return sym

    def _next(self, rank: np.ndarray) -> np.ndarray:
        """The place of each column's next merge, -1 if there is none."""
        at, least = np.full(rank.shape[1], -1, np.int64), np.full(rank.shape[1], NONE, np.int32)
        for j, row in enumerate(rank):
            less = row < least
            at[less] = j
            np.minimum(least, row, out=least)
        return at

    def _merged(self, sym: np.ndarray, rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every column with the pair at its place merged."""
        columns = np.arange(len(at))
        made = self.table.made[rank[at, columns]]
        left = np.empty((len(sym) - 1, len(at)), np.int32)
        ranks = np.empty((len(rank) - 1, len(at)), np.int32)
        for j in range(len(left)):
            left[j] = np.where(at < j, sym[j + 1], sym[j])
        for j in range(len(ranks)):
            ranks[j] = np.where(at > j, rank[j], rank[j + 1])
        left[at, columns] = made
        c = np.flatnonzero(at > 0)
        ranks[at[c] - 1, c] = self.ranks(left[at[c] - 1, c], made[c])
        c = np.flatnonzero(at < len(ranks))
        ranks[at[c], c] = self.ranks(made[c], left[at[c] + 1, c])
        return left, ranks


def printable_bytes() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [x for x in range(256) if x not in plain]
    shown = {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(moved)}
    return [shown[x] for x in range(256)]


class WordCache(dict):
    """Packed ids of words seen.

    When full, only the words of the slice at hand stay, which costs time but no result.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def learn(self, words: Iterable, encode: Callable[[list], list[bytes]]) -> None:
        """Encode those words that are not held."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            held = {w: self[w] for w in words if w in self}
            self.clear()
            self.update(held)
        if new:
            self.update(zip(new, encode(new)))
