"""Token ids of whole texts under a byte-pair tokenizer file whose words end in a suffix.

Bytes, pieces and merges are handled by numpy for a slice of texts at a time. A piece of up to 24 bytes is its own key
(three 64-bit words, no hash stands for it) in an open-addressing table of a fixed size that lives as long as the
worker. Words with other symbols than ASCII and the accented letters of Latin-1, with an apostrophe, a special token or
a longer piece go to the tokenizer itself. Files whose normalizer, pre-tokenizer, model or added tokens are not those
that this stands on go to the tokenizer with their whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np

#: Bytes of text in a slice, bytes of a piece in the table, slots of the table (as a power of two) and words of the other kind kept.
SLICE, WIDTH, BITS, KEPT = 1 << 20, 24, 20, 50_000
BLANK, LETTER, DIGIT, OTHER, ODD, WHOLE = range(6)
_NONE = np.int32(1 << 30)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


#: The settings of a file that pieces in bytes stand on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
UNSET = ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")


def in_bytes(spec: dict) -> bool:
    """Whether texts under this tokenizer file may be cut and merged in bytes.

    Its added tokens have to be found by their "<|", in a word of their own and as they are written.
    """
    model = spec["model"]
    marks = all("<|" in x["content"] and len(x["content"].split()) == 1 and not (x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]) for x in spec.get("added_tokens") or [])
    plain = not any(spec.get(x) for x in ("truncation", "padding", "post_processor")) and not any(model.get(x) for x in UNSET)
    known = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER
    if not (marks and plain and known and model.get("type") == "BPE" and model.get("end_of_word_suffix")):
        return False
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    return max(vocab.values()) < 1 << 20 and len(model["merges"]) < 1 << 25 and all(x in vocab and x + end in vocab for x in _byte_symbols())


def _kinds() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[0x21:0x7F] = OTHER
    kind[[0x20, *range(0x09, 0x0E)]] = BLANK
    kind[0x30:0x3A] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = LETTER
    kind[0x27] = ODD
    return kind


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return [chr(x) if x in set(plain) else chr(256 + rest.index(x)) for x in range(256)]


class Merges:
    """Byte-pair merges of a tokenizers file, for many pieces at once."""

    def __init__(self, model: dict) -> None:
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.first = np.array([vocab[x] for x in symbols], np.int32)
        self.last = np.array([vocab[x + end] for x in symbols], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[x] << 20 | vocab[y] for x, y in pairs], np.int64)
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)

    def score(self, x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of the pairs in one number, the least first; _NONE where a pair does not merge."""
        key = x.astype(np.int64) << 20 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (x >= 0) & (y >= 0), self.rank[at] * np.int32(32) + place, _NONE).astype(np.int32)

    def apply(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of each) for pieces of ``size`` bytes in the rows of ``raw``.

        The pair of least rank, leftmost first, is merged until none is left. A column holds a piece, as a linked list
        of symbols; its last row stands for both ends.
        """
        n, width = raw.shape
        done = np.full((width, n), -1, np.int32)
        row, col = np.arange(width)[:, None], np.arange(n)
        x = np.full((width + 1, n), -1, np.int32)
        x[:width] = np.where(row < size, self.first[raw.T], -1)
        x[size - 1, col] = self.last[raw[col, size - 1]]
        after = np.repeat(np.arange(1, width + 2, dtype=np.int8)[:, None], n, 1)
        after[size - 1, col] = width
        before = np.repeat(np.arange(-1, width, dtype=np.int8)[:, None], n, 1)
        before[0] = width
        best = np.full((width + 1, n), _NONE, np.int32)
        best[: width - 1] = self.score(x[: width - 1], x[1:width], np.broadcast_to(row[: width - 1], (width - 1, n)))
        while True:
            least = best.min(0)
            live = np.flatnonzero(least < _NONE)
            if 2 * len(live) < len(col) or not len(live):
                done[:, col] = x[:width]
                if not len(live):
                    break
                x, after, before, best, col, least = x[:, live], after[:, live], before[:, live], best[:, live], col[live], least[live]
                live = np.arange(len(col))
            else:
                least = least[live]
            p = least & 31
            q = after[p, live]
            r = after[q, live]
            new = self.merged[least >> 5]
            x[p, live] = new
            x[q, live] = -1
            best[q, live] = _NONE
            after[p, live] = r
            before[r, live] = p
            o = before[p, live]
            best[p, live] = self.score(new, x[r, live], p)
            best[o, live] = self.score(x[o, live], new, o)
            best[width] = _NONE
            x[width] = -1
        flat = done.T
        held = flat >= 0
        return flat[held].astype(np.uint32), held.sum(1)


class Pieces:
    """Ids of pieces by their bytes: open addressing in arrays of 2^BITS slots, emptied when two thirds are taken."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.keys = [np.zeros(1 << BITS, np.uint64) for _ in range(3)]
        self.owner = np.zeros(1 << BITS, np.int32)
        self.clear()

    def clear(self) -> None:
        self.at = np.full(1 << BITS, -1, np.int32)
        self.n = np.zeros(1 << BITS, np.uint8)
        self.pool, self.used, self.taken = np.zeros(1 << 20, np.uint32), 0, 0

    def add(self, ids: np.ndarray) -> int:
        """Appends ``ids`` to the pool; where they begin."""
        start, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[start : self.used] = ids
        return start

    def slots(self, key: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """The slot of each piece; new pieces are merged and take a free one."""
        mask = np.uint64((1 << BITS) - 1)
        h = (key[0] * _MIX[0]) ^ (key[1] * _MIX[1]) ^ (key[2] * _MIX[2])
        slot = ((h ^ (h >> np.uint64(29))) * _MIX[0] >> np.uint64(64 - BITS)).astype(np.int64)
        out = slot.copy()
        made: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        todo, k = np.arange(len(slot), dtype=np.int32), key
        while len(todo):
            taken = self.at[slot] != -1
            same = taken & (self.keys[0][slot] == k[0]) & (self.keys[1][slot] == k[1]) & (self.keys[2][slot] == k[2])
            out[todo[same]] = slot[same]
            free = np.flatnonzero(~taken)
            if len(free):
                # one of those that want a free slot gets it; the others look at it again
                self.owner[slot[free]] = free
                free = free[self.owner[slot[free]] == free]
                for mine, x in zip(self.keys, k, strict=True):
                    mine[slot[free]] = x[free]
                self.at[slot[free]] = -2
                made.append(slot[free])
                sizes.append(size[todo[free]])
            slot = np.where(taken & ~same, (slot + 1) & np.int64(mask), slot)
            go = ~same
            todo, slot, k = todo[go], slot[go], [x[go] for x in k]
        if made:
            new, n = np.concatenate(made), np.concatenate(sizes)
            for a in range(0, len(new), 1 << 14):
                s = new[a : a + (1 << 14)]
                raw = np.stack([x[s] for x in self.keys], 1).view(np.uint8)
                ids, many = self.merges.apply(raw, n[a : a + (1 << 14)])
                begin = self.add(ids)
                self.at[s] = begin + np.cumsum(many) - many
                self.n[s] = many
            self.taken += len(new)
        return out


class Encoder:
    """Ids of texts, each followed by ``end_id``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pieces = Pieces(Merges(spec["model"])) if in_bytes(spec) else None
        self.words: dict[bytes, np.ndarray] = {}

    def _whole(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words by the tokenizer itself."""
        words = [w if b"<|" in w else w.lower() for w in words]
        new = list(set(words).difference(self.words))
        found = {}
        for a in range(0, len(new), 1024):
            some = new[a : a + 1024]
            coded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
            found.update((w, np.array(x.ids, np.uint32)) for w, x in zip(some, coded, strict=True))
        out = [found[w] if w in found else self.words[w] for w in words]
        if len(self.words) > KEPT:
            self.words.clear()
        self.words.update((w, x) for w, x in found.items() if len(w) <= 128)
        return out

    def _slice(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size + 1) - 1  # each text and a line feed
        buf = b"\n".join(texts) + b"\n" + b"\0" * (WIDTH + 1)
        raw = np.frombuffer(buf, np.uint8)
        n = int(ends[-1]) + 1
        low, kind = _LOWER[raw], _KIND[raw]
        accent = np.flatnonzero(raw[:n] == 0xC3)
        if len(accent):
            second = raw[accent + 1]
            letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
            accent, second = accent[letter], second[letter]
            kind[accent] = kind[accent + 1] = LETTER
            low[accent + 1] = np.where(second <= 0x9E, second + 0x20, second)
        odd = kind[:n] == ODD
        odd |= (raw[:n] == 0x3C) & (raw[1 : n + 1] == 0x7C)
        kind[n] = BLANK
        bound = np.empty(n + 1, bool)
        bound[0] = True
        np.not_equal(kind[1 : n + 1], kind[:n], out=bound[1:])
        bound[:n] |= kind[:n] == DIGIT
        at = np.flatnonzero(bound)
        long = at[:-1][(np.diff(at) > WIDTH) & (kind[at[:-1]] != BLANK)]
        odd[long] = True
        odd = np.flatnonzero(odd)
        slow, slow_end = odd[:0], odd[:0]
        if len(odd):
            word = np.concatenate([[False], kind[:n] != BLANK, [False]])
            edge = np.flatnonzero(word[1:] != word[:-1])
            hit = np.unique(np.searchsorted(edge[::2], odd, "right") - 1)
            slow, slow_end = edge[::2][hit], edge[1::2][hit]
            step = np.zeros(n + 1, np.int8)
            step[slow] = 1
            step[slow_end] -= 1
            kind[:n][np.cumsum(step[:n], dtype=np.int8) > 0] = WHOLE
            np.not_equal(kind[1 : n + 1], kind[:n], out=bound[1:])
            bound[:n] |= kind[:n] == DIGIT
            at = np.flatnonzero(bound)
        many = np.diff(at, append=n + 1)
        held = kind[at] != BLANK
        at, many = at[held], many[held]
        whole = kind[at] == WHOLE
        start, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if self.pieces.taken > (2 << BITS) // 3 - SLICE // 4:
            self.pieces.clear()
        fast = np.flatnonzero(~whole)
        if len(fast):
            a, m = at[fast], many[fast]
            words = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
            key = [words[np.minimum(a + 8 * j, n + WIDTH - 8)] & _MASKS[np.clip(m - 8 * j, 0, 8)] for j in range(3)]
            slot = self.pieces.slots(key, m)
            start[fast], count[fast] = self.pieces.at[slot], self.pieces.n[slot]
        mark = self.pieces.used
        if len(slow):
            coded = self._whole([buf[a:b] for a, b in zip(slow.tolist(), slow_end.tolist(), strict=True)])
            sizes = np.array([len(x) for x in coded])
            begin = self.pieces.add(np.concatenate(coded))
            start[whole], count[whole] = begin + np.cumsum(sizes) - sizes, sizes
        upto = np.concatenate([[0], np.cumsum(count)])
        flat = np.arange(upto[-1]) + np.repeat(start - upto[:-1], count)
        cut = upto[np.searchsorted(at, ends)]
        ids = np.insert(self.pieces.pool[flat], cut, np.uint32(end_id))
        self.pieces.used = mark  # words of the other kind leave the pool
        return ids, np.diff(cut, prepend=0) + 1

    def encode(self, texts: list[bytes], end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of slices of ``texts``, in order."""
        a = 0
        while a < len(texts):
            b, held = a, 0
            while b < len(texts) and (held < SLICE or b == a):
                held += len(texts[b])
                b += 1
            if self.pieces is None:
                yield self._library(texts[a:b], end_id)
            else:
                yield self._slice(texts[a:b], end_id) if held < 4 * SLICE else self._parts(texts[a:b], end_id)
            a = b

    def _library(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As _slice, by the tokenizer alone."""
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        coded = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        ids = [np.array([*x.ids, end_id], np.uint32) for x in coded]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def _parts(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As _slice, for texts that are too long for one: cut at blanks, which no piece reaches over."""
        ids, many = [], []
        for t in texts:
            total, a = 0, 0
            while a < len(t):
                b = min(len(t), a + SLICE)
                while b < len(t) and _KIND[t[b]] != BLANK:
                    b += 1
                some, _ = self._slice([t[a:b]], end_id)
                ids.append(some[:-1])
                total, a = total + len(some) - 1, b
            ids.append(np.array([end_id], np.uint32))
            many.append(total + 1)
        return np.concatenate(ids), np.array(many)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; its table is of a fixed size."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
