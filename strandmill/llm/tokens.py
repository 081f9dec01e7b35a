"""Whole-text token ids with the tokenizers library, remembering the ids of words.

A byte-level BPE file cuts text by a fixed pattern before it merges bytes, and each
cut is merged alone. Here numpy finds those cuts in texts of Latin letters, many texts at a
time; the library's BPE model merges each distinct cut once, and a table of bounded size
holds the ids by the cut's hash. A hit counts only if all its characters agree, so ids are
exact. Other texts are split at single spaces between non-space characters (always a
cut), and the parts with other characters or with special tokens go to the library
whole. Files of any other kind get every text whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

_ENCODERS: dict = {}
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼½¾"
#: Classes of the code points below _OTHER: white space, letter, number, anything else. _OTHER itself ends a text, and what is white space to Python only is unknown.
_WHITE, _LETTER, _NUMBER, _ELSE, _END, _UNKNOWN = range(6)
_OTHER = 0x250
_KINDS = np.array(
    [_UNKNOWN if 0x1C <= c <= 0x1F else next(k for k, p in ((_WHITE, r"\s"), (_LETTER, f"[{_LETTERS}]"), (_NUMBER, f"[{_NUMBERS}]"), (_ELSE, "(?s:.)")) if re.match(p, chr(c))) for c in range(_OTHER)] + [_END],
    np.uint8,
)
_SAFE = re.compile(r"(?<=\S) (?=\S)").split
_BASE = 0x5851F42D4C957F2D
_BETWEEN = b"\xc0"
#: Characters that are cut at a time, and those of the longest cut that is remembered.
BLOCK, LONGEST = 1 << 19, 64
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 1 << 14), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base][:n]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _begins(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """First characters of the cuts: contractions; runs of letters, of numbers, or of other signs, each with one space before it;
    white space up to the last character before such a run.
    """
    before = np.concatenate([np.array([_END], np.uint8), kinds[:-1]])
    white = kinds == _WHITE
    word = ~white & (kinds != _END)
    begins = kinds == _END
    begins |= white & ((before != _WHITE) | np.concatenate([word[1:], [False]]))
    word &= kinds != before
    word[1:] &= points[:-1] != 32
    begins |= word
    marks = np.flatnonzero((points == 39) & begins)
    if len(marks):
        tail = np.concatenate([points, np.full(2, _OTHER, np.uint32)])
        a, b = tail[marks + 1], tail[marks + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        begins[marks[one | two] + 1] = False
        begins[marks[one] + 2] = True
        begins[marks[two] + 3] = True
    return np.flatnonzero(begins)


class _Table:
    """Cuts by hash: their characters and ids, in arrays of bounded size; emptied as a whole when full."""

    def __init__(self, entries: int):
        self.entries = entries
        self.slots = 1 << (2 * entries - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.count = 0
        self.chars, self.ids = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.uint32)
        self.char_at, self.id_at = np.zeros((2, 1 << 12), np.int64)  # where each cut starts; the next one's start is its end

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.entry[slot], -1)
        open_ = np.flatnonzero((found < 0) & (self.keys[slot] != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (self.slots - 1)
            here = self.keys[slot]
            hit = here == keys[open_]
            found[open_[hit]] = self.entry[slot[hit]]
            on = ~hit & (here != 0)
            open_, slot = open_[on], slot[on]
        return found

    def add(self, chars: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """Store cuts and return their entries; without ``keys`` they aren't found again."""
        n, at = len(sizes), self.count
        for name, more in (("chars", chars), ("ids", ids)):
            used = int((self.char_at if name == "chars" else self.id_at)[at])
            kept = getattr(self, name)
            if used + len(more) > len(kept):
                kept = np.concatenate([kept, np.zeros(max(len(kept), len(more)), kept.dtype)])
                setattr(self, name, kept)
            kept[used : used + len(more)] = more
        if at + n + 1 > len(self.char_at):
            more = np.zeros(max(len(self.char_at), n + 1), np.int64)
            self.char_at, self.id_at = np.concatenate([self.char_at, more]), np.concatenate([self.id_at, more])
        self.char_at[at + 1 : at + n + 1] = self.char_at[at] + np.cumsum(sizes)
        self.id_at[at + 1 : at + n + 1] = self.id_at[at] + np.cumsum(counts)
        self.count += n
        entries = np.arange(at, at + n, dtype=np.int32)
        if keys is not None:
            slot, left = self._slot(keys), np.arange(n)
            while len(left):
                free = self.keys[slot[left]] == 0
                self.keys[slot[left[free]]] = keys[left[free]]
                done = self.keys[slot[left]] == keys[left]
                self.entry[slot[left[done]]] = entries[left[done]]
                left = left[~done]
                slot[left] = (slot[left] + 1) & (self.slots - 1)
        return entries


class Encoder:
    """``ids(text)``: the ids of one text as a uint32 array; ``batch(texts)``: those of many."""

    def __init__(self, path: str, entries: int = 800_000):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        cut = self.tokenizer.pre_tokenizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = isinstance(self.model, models.BPE) and isinstance(cut, pre_tokenizers.ByteLevel) and not cut.add_prefix_space and self.tokenizer.normalizer is None
        if self.pieces:  # byte-level files may also be told not to cut
            self.pieces = [p for p, _ in cut.pre_tokenize_str("a b's\nc, 12")] == ["a", "Ġb", "'s", "Ċ", "c", ",", "Ġ12"]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in letters]
        self.shown = np.zeros(256, np.uint16)
        self.shown[letters] = letters
        self.shown[rest] = 256 + np.arange(len(rest))
        self.table = _Table(entries)
        self.edge = self._edge(path) if self.pieces else None

    def _edge(self, path: str) -> int | None:
        """The id of a byte that never occurs in UTF-8, if it merges with nothing: it parts cuts that are merged in one call."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        sign = self._shown(_BETWEEN)
        merges = ("".join(m) if isinstance(m, list) else m for m in model["merges"])
        return None if any(sign in m for m in merges) else model["vocab"].get(sign)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their counts) of cuts: their bytes, as the characters that byte-level files show them by, merged by the library's model."""
        ids, counts = array("I"), []
        raw = [c.encode() for c in cuts]
        if self.edge is None:
            for c in raw:
                mine = [t.id for t in self.model.tokenize(self._shown(c))]
                ids.extend(mine)
                counts.append(len(mine))
            return np.frombuffer(ids, np.uint32), np.array(counts, np.int64)
        for i in range(0, len(raw), 128):
            ids.extend([t.id for t in self.model.tokenize(self._shown(_BETWEEN.join(raw[i : i + 128])))])
            ids.append(self.edge)
        flat = np.frombuffer(ids, np.uint32)
        edges = np.flatnonzero(flat == self.edge)
        return flat[flat != self.edge], np.diff(edges, prepend=-1) - 1

    def _shown(self, raw: bytes) -> str:
        return self.shown[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")

    def _known(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        points = _points(text)
        return not len(points) or bool((points.max() < _OTHER) and (_KINDS[points] != _UNKNOWN).all())

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their counts by text)."""
        joined = "\U0010ffff".join([*texts, ""])
        points = np.minimum(_points(joined), _OTHER)
        kinds = _KINDS[points]
        if not (kinds == _UNKNOWN).any() and np.count_nonzero(kinds == _END) == len(texts) and not any(s in joined for s in self.special):
            return self._cut(joined, points, kinds)
        parts = [self._known_or_parts(t) for t in texts]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _known_or_parts(self, text: str) -> np.ndarray:
        return self._one(text) if self._known(text) else self._parts(text)

    def _one(self, text: str) -> np.ndarray:
        points = np.append(_points(text), np.uint32(_OTHER))
        return self._cut(text + "\U0010ffff", points, _KINDS[points])[0]

    def _cut(self, joined: str, points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their counts by text) of known texts, each followed by an end."""
        begin = _begins(points, kinds)
        n = len(points)
        sizes = np.diff(begin, append=n)
        final = kinds[begin] == _END
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * _powers(pow(_BASE, -1, 1 << 64), n), out=total[1:])
        keys = ((total[begin + sizes] - total[begin]) * _powers(_BASE, n + 1)[begin + sizes]) | np.uint64(1)  # no key is 0
        table = self.table
        if table.count > table.entries:
            table.clear()
        entry = table.find(keys)
        hit = np.flatnonzero(entry >= 0)
        size = table.char_at[entry[hit] + 1] - table.char_at[entry[hit]]
        same = size == sizes[hit]
        entry[hit[~same]] = -1
        hit, size = hit[same], size[same]
        if len(hit):
            ends = np.cumsum(size)
            step = np.arange(ends[-1])
            stored = table.chars[np.repeat(table.char_at[entry[hit]] - ends + size, size) + step]
            wrong = stored != points[np.repeat(begin[hit] - ends + size, size) + step]
            if wrong.any():
                entry[hit[np.unique(np.searchsorted(ends, np.flatnonzero(wrong), side="right"))]] = -1
        entry[final] = -1
        missed = np.flatnonzero((entry < 0) & ~final)
        if len(missed):
            texts_of: dict[str, int] = {}
            spans = zip(begin[missed].tolist(), (begin[missed] + sizes[missed]).tolist())
            which = np.array([texts_of.setdefault(joined[a:b], len(texts_of)) for a, b in spans])
            cuts = list(texts_of)
            ids, counts = self._merge(cuts)
            first = missed[np.unique(which, return_index=True)[1]]
            lengths = sizes[first]
            own = keys[first]
            keep = lengths <= LONGEST
            # Of cuts that share a hash, and of those whose hash the table has already, none is found again.
            values, back, times = np.unique(own, return_inverse=True, return_counts=True)
            keep &= (times[back] == 1) & (table.find(own) < 0)
            new = np.zeros(len(cuts), np.int32)
            ends = np.cumsum(lengths)
            chars = points[np.repeat(begin[first] - ends + lengths, lengths) + np.arange(ends[-1])].astype(np.uint16)
            of_char, of_id = np.repeat(keep, lengths), np.repeat(keep, counts)
            for some, keyed in ((keep, True), (~keep, False)):
                if some.any():
                    new[some] = table.add(chars[of_char == keyed], lengths[some], ids[of_id == keyed], counts[some], own[some] if keyed else None)
            entry[missed] = new[which]
        counts = np.where(final, 0, table.id_at[entry + 1] - table.id_at[entry])
        ends = np.cumsum(counts)
        where = np.repeat(table.id_at[entry] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        return table.ids[where], np.diff(ends[final], prepend=0)

    def _parts(self, text: str) -> np.ndarray:
        """Ids of a text that isn't known as a whole."""
        out, pre, now = [], "", []

        def known():
            if now:
                # Parts end before a space, so their cuts are those of the text they make up.
                out.append(self._one("".join(now)).tobytes())
                now.clear()

        for part in _SAFE(text):
            part = pre + part
            pre = " "
            if self._known(part):
                now.append(part)
            else:
                known()
                out.append(self._whole(part))
        known()
        return np.frombuffer(b"".join(out), np.uint32)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their counts): the ids of all texts in one uint32 array, in order. Null texts are empty."""
        if not self.pieces:
            found = [np.frombuffer(self._whole(t or ""), np.uint32) for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)
        parts, counts = [], np.zeros(len(texts), np.int64)
        group, size = [], 0

        def together():
            if group:
                flat, n = self._together([texts[i] for i in group])
                parts.append(flat)
                counts[group] = n
                group.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > BLOCK:  # at safe places, so that one long text doesn't take one large block
                together()
                size = 0
                found = [self._known_or_parts(p) for p in _sections(text)]
                parts += found
                counts[i] = sum(map(len, found))
                continue
            if size + len(text) > BLOCK:
                together()
                size = 0
            group.append(i)
            size += len(text)
        together()
        return np.concatenate([np.zeros(0, np.uint32), *parts]), counts

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``batch``'s ids and counts with ``end_id`` behind each text, if there is one."""
    if end_id is None:
        return flat, counts
    out = np.full(len(flat) + len(counts), end_id, np.uint32)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
    return out, counts + 1


def _sections(text: str):
    """Sections of about ``BLOCK`` characters; each but the first starts at a single space between non-space characters, always a cut,
    unless special tokens hold one.
    """
    at = 0
    find = re.compile(r"(?<=\S) (?=\S)").search
    while len(text) - at > BLOCK and (m := find(text, at + BLOCK)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encoder(path: str) -> Encoder:
    """One encoder a process and file; Python workers are reused over tasks, and so is what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
