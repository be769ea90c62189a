"""Byte-pair encodings of public tokenizer files.

The texts of a corpus repeat their words, so both coders below work on
white-space delimited words and keep a bounded cache of them.  A word is cut
off only where the pre-tokenizer is bound to cut as well; a text in which that
is not certain (other white space than single blanks and line ends, characters
outside printable ASCII and Latin-1, special strings) goes through the library
whole.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np

from . import common, words

#: Words a worker remembers; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Longer words are not remembered.
CACHE_CHARS = 64

UNSAFE = re.compile("[^\\x20-\\x7e\\n¡-ÿ]")
#: Where blanks do not stand alone between two words.
RUNS = re.compile(r"  |\n\n| \n|\n |^[ \n]|[ \n]$")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Words(dict):
    """Values of words, made on demand."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


class IdCoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``whole`` hands every text to the library unchanged; :meth:`encode` gives
    the same bytes from remembered words where cutting at blanks is safe.
    """

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        conf = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in conf["added_tokens"]]
        pre = conf["pre_tokenizer"]
        #: Blanks are dropped, and words are lower-cased one by one.
        self.drops_blanks = pre["type"] == "Sequence"
        self.bare = Words(self._make)
        self.led = Words(lambda w: self._make(" " + w))
        self.line_end = b"" if self.drops_blanks else self._make("\n")

    def _make(self, s: str) -> bytes:
        ids = self.tokenizer.encode(s, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if UNSAFE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if self.drops_blanks:
            bare = self.bare
            return b"".join([bare[w] for w in text.lower().split()])
        if RUNS.search(text):
            return self.whole(text)
        bare, led, end, parts = self.bare, self.led, self.line_end, []
        for line in text.split("\n"):
            words = line.split(" ")
            parts.append(bare[words[0]])
            words[0] = ""
            parts += [led[w] for w in words if w]
            parts.append(end)
        parts.pop()
        return b"".join(parts)


class HeapCounter:
    """Token counts by heap-and-linked-list byte-pair merging.

    The pairs of a word stand in a heap by (rank, position); the lowest is
    popped, the two symbols are joined in a doubly linked list, and the pairs
    with its neighbours are pushed.  The count is the number of initial symbols
    less the merges; no identifiers are emitted.
    """

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        vocab = conf["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in conf["model"]["merges"]]
        #: (left, right) -> (rank, joined), all symbols as integers.
        self.pairs = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.symbol = {c: i for c, i in vocab.items() if len(c) == 1}
        self.special = [t["content"] for t in conf["added_tokens"]]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = Words(self.merge)
        self.bare = Words(self._pieces)
        self.led = Words(lambda w: self._pieces(" " + w))
        self.line_end = self._pieces("\n")

    def merge(self, piece: str) -> int:
        """Tokens of one pre-token, given in the byte alphabet."""
        pairs = self.pairs
        sym = [self.symbol[c] for c in piece]
        n = len(sym)
        if n < 2:
            return n
        heap = []
        for i in range(n - 1):
            if (hit := pairs.get((sym[i], sym[i + 1]))) is not None:
                heap.append(hit[0] << 32 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges, mask = list(range(1, n + 1)), list(range(-1, n - 1)), 0, (1 << 32) - 1
        while heap:
            top = heapq.heappop(heap)
            i = top & mask
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            hit = pairs.get((sym[i], sym[j]))
            if hit is None or hit[0] != top >> 32:
                continue
            sym[i], sym[j] = hit[1], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (hit := pairs.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, hit[0] << 32 | i)
            h = before[i]
            if h >= 0 and (hit := pairs.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, hit[0] << 32 | h)
        return n - merges

    def _pieces(self, s: str) -> int:
        pieces = self.pieces
        return sum(pieces[p] for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(s)) if s else 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split_special is not None and "<|" in text and (found := self.split_special.findall(text)):
            return len(found) + sum(self.count(s) for s in self.split_special.split(text))
        if UNSAFE.search(text) or RUNS.search(text):
            return self._pieces(text)
        bare, led, total = self.bare, self.led, 0
        lines = text.split("\n")
        for line in lines:
            words = line.split(" ")
            total += bare[words[0]]
            del words[0]
            total += sum([led[w] for w in words])
        return total + self.line_end * (len(lines) - 1)


#: Slots of a worker's table of words; a word whose slot another one takes is made anew.
TABLE = 1 << 22
#: Ids kept in a slot; longer words are made anew in every batch.
KEPT = 6
#: Rows whose words are held at once.
ROWS = 250


class Cut:
    """A column's texts cut into words where cutting at blanks is safe; other rows stay whole.

    ``led`` words follow a single blank, others stand at the start of a row or
    behind a line end (``after_end``).  With ``any_blanks`` blanks are dropped by
    the tokenizer and may stand in any number.
    """

    def __init__(self, column, any_blanks: bool):
        data, at = words.raw(column)
        n = len(at) - 1
        odd = ODD_BYTE[data]
        odd[:-1] |= (data[:-1] == 0xC2) & (data[1:] <= 0xA0)  # U+0080 to U+00A0
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # <| may begin a special string
        if not any_blanks:
            blank = (data == 32) | (data == 10)
            odd[1:] |= blank[1:] & blank[:-1]
            odd[at[:-1][at[:-1] < len(data)]] |= blank[at[:-1][at[:-1] < len(data)]]
            odd[at[1:][at[1:] > 0] - 1] |= blank[at[1:][at[1:] > 0] - 1]
        full = np.diff(at) > 0
        self.whole = np.zeros(n, bool)
        where = np.flatnonzero(odd)
        self.whole[np.searchsorted(at, where, side="right") - 1] = True
        self.whole &= full
        h, start, end = words.words(data, at, fold=any_blanks)
        row = words.owners(at, start)
        if self.whole.any():
            keep = ~self.whole[row]
            h, start, end, row = h[keep], start[keep], end[keep], row[keep]
        self.data, self.at, self.start, self.end, self.row = data, at, start, end, row
        first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        before = data[np.maximum(start - 1, 0)] if len(row) else np.zeros(0, np.uint8)
        self.after_end = ~first & (before == 10) & (not any_blanks)
        self.led = ~first & (before != 10) & (not any_blanks)
        self.key = np.where(self.led, h, words.mixed(h + words.ODD))

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def text(self, r: int) -> str:
        return self.data[self.at[r] : self.at[r + 1]].tobytes().decode("utf-8", "replace")


ODD_BYTE = np.zeros(256, bool)
ODD_BYTE[:32] = True
ODD_BYTE[10] = False
ODD_BYTE[127] = True
ODD_BYTE[0xC4:] = True

class BatchCoder:
    """Ids of an Arrow column of texts, word by word from a table of bounded size.

    What :class:`IdCoder` gives for each text, made for a batch at once.
    """

    def __init__(self, path: str):
        self.one = IdCoder(path)
        self.keys = np.zeros(TABLE, np.uint64)
        self.place = np.zeros(TABLE, np.int32)  # of a slot's word among those below, whose room grows with them
        self.words, self.sizes, self.ids = 1, np.zeros(1 << 12, np.uint8), np.zeros(KEPT << 12, np.uint32)
        self.end = np.frombuffer(self.one.line_end, np.uint32)
        vocab = self.one.tokenizer.get_vocab(with_added_tokens=False)
        self.starts = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a blank, or are a line end
        for token, i in vocab.items():
            self.starts[i] = token[:1] == "\u0120"
        del vocab
        common.trimmed()  # reading the file leaves some freed memory

    def _placed(self, s: int) -> int:
        if not self.place[s]:
            if self.words == len(self.sizes):
                self.sizes, self.ids = (np.r_[x, np.zeros_like(x)] for x in (self.sizes, self.ids))
            self.place[s] = self.words
            self.words += 1
        return int(self.place[s])

    def _encode(self, texts: list[str], led: bool) -> list[np.ndarray]:
        """Ids of words that follow a blank (``led``) or not, many at a time."""
        out: list[np.ndarray] = []
        for a in range(0, len(texts), 4096):
            part = texts[a : a + 4096]
            if led and not self.one.drops_blanks:  # every id that begins with a blank begins a word
                joined = [" " + " ".join(part[i : i + 64]) for i in range(0, len(part), 64)]
                for e in self.one.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
                    ids = np.array(e.ids, np.uint32)
                    cuts = [0, *np.flatnonzero(self.starts[ids])[1:].tolist(), len(ids)]
                    out += [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            else:
                out += [np.array(e.ids, np.uint32) for e in self.one.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def encode(self, column) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every row, made for ``ROWS`` rows at once."""
        return [ids for a in range(0, len(column), ROWS) for ids in self._rows(column.slice(a, ROWS))]

    def _rows(self, column) -> list[bytes]:
        cut = Cut(column, self.one.drops_blanks)
        slot = (cut.key & np.uint64(TABLE - 1)).astype(np.int64)
        known = self.keys[slot] == cut.key
        missing, where = np.unique(cut.key[~known], return_index=True)
        long: dict[int, np.ndarray] = {}
        if len(missing):
            place = np.flatnonzero(~known)[where]
            for led in (True, False):
                some = np.flatnonzero(cut.led[place] == led)
                for m, ids in zip(some.tolist(), self._encode([cut.word(i) for i in place[some].tolist()], led), strict=True):
                    s = int(slot[place[m]])
                    if len(ids) > KEPT or len(ids) == 0:
                        long[int(missing[m])] = ids
                    else:
                        w = self._placed(s)
                        self.keys[s], self.sizes[w] = missing[m], len(ids)
                        self.ids[w * KEPT : w * KEPT + len(ids)] = ids
            known = self.keys[slot] == cut.key
        rest = np.flatnonzero(~known).tolist()  # long words, and words that lost their slot to others of this batch
        lost = {int(cut.key[i]): i for i in rest if int(cut.key[i]) not in long}
        for led in (True, False):
            some = [i for i in lost.values() if cut.led[i] == led]
            for i, ids in zip(some, self._encode([cut.word(i) for i in some], led), strict=True):
                long[int(cut.key[i])] = ids
        place = self.place[slot].astype(np.int64)
        sizes = np.where(known, self.sizes[place], 0).astype(np.int64)
        for i in rest:
            sizes[i] = len(long[int(cut.key[i])])
        lead = cut.after_end * len(self.end)
        ends = np.cumsum(sizes + lead)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        at = ends - sizes
        if len(self.end):
            for k, v in enumerate(self.end.tolist()):
                out[at[cut.after_end] - len(self.end) + k] = v
        kept = np.where(known, sizes, 0)
        of = np.repeat(np.arange(len(kept)), kept)
        k = np.arange(len(of)) - (np.cumsum(kept) - kept)[of]
        out[at[of] + k] = self.ids[(place * KEPT)[of] + k]
        for i in rest:
            out[at[i] : ends[i]] = long[int(cut.key[i])]
        bounds = np.r_[0, ends][np.searchsorted(cut.row, np.arange(len(cut.at)))]
        flat = out.astype("<u4").tobytes()
        rows = [flat[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for r in np.flatnonzero(cut.whole).tolist():
            rows[r] = self.one.whole(cut.text(r))
        return rows


class BatchCounter:
    """Token counts of an Arrow column of texts, word by word from a table of bounded size, words by :class:`HeapCounter`."""

    def __init__(self, path: str):
        self.one = HeapCounter(path)
        self.keys = np.zeros(TABLE, np.uint64)
        self.counts = np.zeros(TABLE, np.int32)

    def count(self, column) -> np.ndarray:
        cut, one = Cut(column, False), self.one
        slot = (cut.key & np.uint64(TABLE - 1)).astype(np.int64)
        known = self.keys[slot] == cut.key
        counts = np.where(known, self.counts[slot], 0).astype(np.int64)
        open_ = np.flatnonzero(~known)
        missing, where, back = np.unique(cut.key[open_], return_index=True, return_inverse=True)
        if len(missing):
            place = open_[where]
            made = np.array([one._pieces(f" {cut.word(i)}" if cut.led[i] else cut.word(i)) for i in place.tolist()], np.int64)
            counts[open_] = made[back]
            self.keys[slot[place]], self.counts[slot[place]] = missing, made
        counts += cut.after_end * one.line_end
        total = np.r_[0, np.cumsum(counts)][np.searchsorted(cut.row, np.arange(len(cut.at)))]
        out = np.diff(total)
        for r in np.flatnonzero(cut.whole).tolist():
            out[r] = one.count(cut.text(r))
        return out


@functools.lru_cache(maxsize=4)
def batch_coder(path: str) -> BatchCoder:
    return BatchCoder(path)


@functools.lru_cache(maxsize=4)
def batch_counter(path: str) -> BatchCounter:
    return BatchCounter(path)


@functools.lru_cache(maxsize=4)
def id_coder(path: str) -> IdCoder:
    return IdCoder(path)


@functools.lru_cache(maxsize=4)
def heap_counter(path: str) -> HeapCounter:
    return HeapCounter(path)


def forget() -> None:
    """Drop the tables that this process holds; the next use makes them anew."""
    for made in (batch_coder, batch_counter, id_coder, heap_counter):
        made.cache_clear()
