"""Many keywords in one reading of the texts: an Aho-Corasick automaton in arrays.

States are the prefixes of the keywords' UTF-8 bytes, in order of length. Failure arcs lead to the
longest proper suffix that is a state; goto is complete, as a state's missing arcs are those of its
failure state; and each state's outputs are all keywords that end there, its own and those nested in it.
A keyword counts once a text, however often it occurs.

The automaton is built level by level with sorted arrays. Texts are read in stretches that overlap by
the longest keyword, all stretches of a slice in step, so a slice takes as many steps as a stretch is
long. Memory is bounded by the automaton and by SLICE bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE, STRETCH = 4 << 20, 512


class Automaton:
    def __init__(self, words: list[bytes]):
        """words may repeat; outputs name them by their places in the list. An empty word is in every text."""
        self.n_words = len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        data, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length
        self.longest = int(length.max()) if len(words) else 0
        used = np.unique(data)
        self.code = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        self.code[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        state, levels, n = np.zeros(len(words), np.int64), [], 1
        for depth in range(self.longest):
            on = np.flatnonzero(length > depth)
            arcs, place = np.unique(state[on] * self.width + self.code[data[begin[on] + depth]], return_inverse=True)
            levels.append((arcs, np.arange(n, n + len(arcs))))
            state[on] = n + place
            n += len(arcs)
        self.goto, fail = np.zeros((n, self.width), np.int32), np.zeros(n, np.int64)
        for arcs, new in levels:
            parent, by = arcs // self.width, arcs % self.width
            fail[new] = np.where(parent == 0, 0, self.goto[fail[parent], by])
            self.goto[parent, by] = new
            self.goto[new] = self.goto[fail[new]]  # a suffix is shorter: its arcs of this level are there
        self.goto = self.goto.ravel()
        # Outputs: a state's own keywords, then those of its failure state, which has fewer bytes.
        own = np.bincount(state, minlength=n)
        own_begin = np.cumsum(own) - own
        by_state = np.argsort(state, kind="stable")
        total = own.copy()
        total[0] = 0  # empty words end everywhere and are kept apart
        for _, new in levels:
            total[new] += total[fail[new]]
        self.begin = np.r_[0, np.cumsum(total)]
        self.output = np.empty(self.begin[-1], np.int64)
        for _, new in levels:
            mine = _ranges(self.begin[new], own[new])
            self.output[mine] = by_state[_ranges(own_begin[new], own[new])]
            rest = total[fail[new]]
            self.output[_ranges(self.begin[new] + own[new], rest)] = self.output[_ranges(self.begin[fail[new]], rest)]
        self.ends, self.everywhere = total > 0, by_state[: own[0]]

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (text, word), by their places, ordered by text. texts has no NULLs."""
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        codes = self.code[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]]
        edges = (edges - edges[0]).astype(np.int64)
        step = max(STRETCH, 4 * self.longest)
        cuts = -(-np.diff(edges) // step)
        text = np.repeat(np.arange(len(texts)), cuts)
        first = edges[text] + (np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * step
        end = np.minimum(first + step, edges[text + 1])
        first = np.maximum(first - max(0, self.longest - 1), edges[text])
        order = np.argsort(first - end, kind="stable")
        text, first, size = text[order], first[order], (end - first)[order]
        state, seen = np.zeros(len(text), np.int64), [np.zeros(0, np.int64)]
        n_states = len(self.ends)
        for at in range(int(size[0]) if len(size) and self.longest else 0):
            m = int(np.searchsorted(-size, -at))  # the stretches that have a byte here
            now = self.goto[state[:m] * self.width + codes[first[:m] + at]].astype(np.int64)
            state[:m] = now
            hit = np.flatnonzero(self.ends[now])
            seen.append(text[hit] * n_states + now[hit])
        pairs = distinct(np.concatenate(seen))
        text, now = pairs // n_states, pairs % n_states
        count = self.begin[now + 1] - self.begin[now]
        both = np.repeat(text, count) * max(1, self.n_words) + self.output[_ranges(self.begin[now], count)]
        if len(self.everywhere):
            both = np.concatenate([both, (np.arange(len(texts))[:, None] * self.n_words + self.everywhere).ravel()])
        both = distinct(both)
        return both // max(1, self.n_words), both % max(1, self.n_words)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting integers takes a fraction of the time of np.unique's table."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, joined."""
    ahead = np.cumsum(count) - count
    return np.repeat(begin - ahead, count) + np.arange(int(count.sum()))


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with up to most bytes of text in a column, or one row with more."""
    for b in batches:
        edges = np.frombuffer(b.column(column).buffers()[1], np.int32)[b.column(column).offset :][: b.num_rows + 1]
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, side="right")) - 1)
            j = min(j, b.num_rows)
            yield b.slice(i, j - i)
            i = j
