"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has one BPE encoding, so it has one last token, and the
encoding of the prefix is that of the shorter one without it, and the token. ``Prefixes`` stores this
last token for each byte. A token may end a prefix if it fits behind the last token of what is before it: if merging
their bytes never joins the two. Whether it does depends on the two tokens alone and is remembered.
So encoding takes time in proportion to the bytes, whatever the text; appended bytes leave all
stored tokens valid; and behind an edit the stored tokens hold again once as many bytes as
the longest token has agree. ``Document`` does the same for texts that a pattern cuts into matches first.

This holds for vocabularies whose tokens are all made by merges of tokens with lower ranks, which is
checked on loading. Ids are the ranks of the file.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, table
from .tokens import Encoder, _Table

NEVER = 1 << 62
#: Remembered pairs, remembered matches, and characters of a match that is remembered.
MOST_PAIRS, MOST_MATCHES, LONGEST_MATCH = 1 << 20, 800_000, 64
#: Characters that are cut at a time.
BLOCK = 1 << 18
_LOADED: dict = {}


def default_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(ranks: dict[bytes, int], data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """Tokens of ``data`` by plain merging, lowest rank and leftmost first, and the two parts of the last merge."""
    parts, last = [data[i : i + 1] for i in range(len(data))], None
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Vocabulary:
    """Tokens, the pair of tokens that each is merged from, and an automaton that finds all tokens of a text."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        self.size = max(ranks.values()) + 1
        self.longest = max(map(len, ranks))
        self.bytes: list[bytes] = [b""] * self.size
        self.pair: dict[int, int] = {}
        left, right = array("q", [-1]) * self.size, array("q", [-1]) * self.size
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            if len(token) > 1:
                whole, last = merged(ranks, token)
                a, b = (ranks[x] for x in last) if last else (-1, -1)
                if len(whole) > 1 or any(len(x) > 1 and ranks[x] >= rank for x in last):
                    raise ValueError(f"token {rank} isn't a merge of earlier tokens")
                left[rank], right[rank] = a, b
                self.pair[a * self.size + b] = rank
        self.automaton.make_automaton()
        self.left, self.right = left, right
        self._fits: dict[int, bool] = {}
        self._ends: dict[int, list[int]] = {}
        self._starts: dict[int, list[int]] = {}

    def _edge(self, token: int, side: array, kept: dict[int, list[int]]) -> list[int]:
        """The tokens that stand at one edge of ``token`` while it is merged, from a byte to itself."""
        found = kept.get(token)
        if found is None:
            found = [token]
            while side[found[-1]] >= 0:
                found.append(side[found[-1]])
            found.reverse()
            kept[token] = found
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens never joins them. Each side is merged on its own up to the first join: a token at
        the edge stands until the rank of the one that takes it up, and of equal ranks the left one is merged first.
        """
        ends, starts = self._edge(a, self.right, self._ends), self._edge(b, self.left, self._starts)
        i = j = 0
        while True:
            x = ends[i + 1] if i + 1 < len(ends) else NEVER
            y = starts[j + 1] if j + 1 < len(starts) else NEVER
            joined = self.pair.get(ends[i] * self.size + starts[j], NEVER)
            if joined < x and joined <= y and joined != NEVER:
                return False
            if x == y == NEVER:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``."""
        key = a * self.size + b
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= MOST_PAIRS:
                self._fits.clear()
            found = self._fits[key] = self._apart(a, b)
        return found

    def extend(self, text: str, last: array, upto: int | None = None) -> None:
        """Append to ``last`` the last tokens of the prefixes of ``text`` (bytes as latin-1) that it lacks."""
        done, remembered, fits = len(last), self._fits.get, self.fits
        size = self.size
        for end, (token, n) in self.automaton.iter(text, max(0, done - self.longest + 1), len(text) if upto is None else upto):
            if end != len(last):  # known before, or found among the longer tokens that end here
                continue
            start = end - n
            if start >= 0:
                fit = remembered(last[start] * size + token)
                if not (fits(last[start], token) if fit is None else fit):
                    continue
            last.append(token)

    def backwards(self, last: array, upto: int) -> array:
        """Ids of the first ``upto`` bytes."""
        out = array("i")
        while upto:
            out.append(last[upto - 1])
            upto -= len(self.bytes[last[upto - 1]])
        out.reverse()
        return out


class Prefixes:
    """A byte string with the last token of each of its prefixes: 4 bytes a byte."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, "", array("i")
        self.append(data)

    def append(self, data: bytes) -> None:
        """Put bytes behind; no stored token changes."""
        self.text += data.decode("latin-1")
        self.vocabulary.extend(self.text, self.last)

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the first ``upto`` bytes, or of all."""
        return self.vocabulary.backwards(self.last, len(self.text) if upto is None else upto).tolist()

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of the bytes from ``start`` to ``stop``. Tokens before stay; those behind are found anew until as many
        bytes as the longest token has agree with the old ones. Returns how many were found anew.
        """
        if not 0 <= start <= stop <= len(self.text):
            raise ValueError("no such bytes")
        old, width = self.last, self.vocabulary.longest
        self.text = self.text[:start] + data.decode("latin-1") + self.text[stop:]
        self.last = old[:start]
        edge, shift = start + len(data), len(data) - (stop - start)
        at, agreed = edge, 0
        self.vocabulary.extend(self.text, self.last, edge)
        while at < len(self.text) and agreed < width:
            upto = min(len(self.text), at + width)
            self.vocabulary.extend(self.text, self.last, upto)
            for i in range(at, upto):
                agreed = agreed + 1 if self.last[i] == old[i - shift] else 0
                if agreed == width:
                    del self.last[i + 1 :]
                    upto = i + 1
                    break
            at = upto
        anew = len(self.last) - start
        self.last.extend(old[len(self.last) - shift :])
        return anew


def _ranges(points: list[int]) -> str:
    """A part of a character class."""
    out = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Cutter:
    """Matches of the pattern as the tiktoken library finds them.

    The ``regex`` module may know letters and numbers of a later Unicode version. The library is asked once which
    characters are such to it, and texts with others get a pattern without them.
    """

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        odd = {}
        for kind in ("L", "N"):
            mine = regex.findall(rf"\p{{{kind}}}", "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000))))
            library = tiktoken.Encoding("kinds", pat_str=rf"\p{{{kind}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            known = set(bytes(library.encode_ordinary("".join(mine))).decode())
            odd[kind] = [ord(c) for c in mine if c not in known]
        self.plain = regex.compile(pattern)
        unknown = sorted(odd["L"] + odd["N"])
        self.unknown = self.exact = None
        if unknown:
            self.unknown = regex.compile(f"[{_ranges(unknown)}]")
            narrowed = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{_ranges(unknown)}])")
            for kind, points in odd.items():
                if points:
                    narrowed = narrowed.replace(rf" ?\p{{{kind}}}+", rf" ?(?:(?![{_ranges(points)}])\p{{{kind}}})+")
            self.exact = regex.compile(narrowed)

    def pattern(self, text: str):
        return self.exact if self.unknown and not text.isascii() and self.unknown.search(text) else self.plain

    def blocks(self, text: str):
        """Lists of matches that together are all of ``text``'s, of about ``BLOCK`` characters each.

        A match depends on at most two characters behind it, so those that end two or more before the end of a block are sure.
        """
        find, at, size = self.pattern(text).findall, 0, BLOCK
        while at < len(text):
            end = min(len(text), at + size)
            found, now = find(text, at, end), end
            if end < len(text):
                while found and now + 2 > end:
                    now -= len(found.pop())
            if found:
                yield found
                at, size = now, BLOCK
            else:
                size *= 2


class Document:
    """A text with its matches, each with the last tokens of its prefixes; edits redo what they change.

    A match depends on the text from its start to two characters behind it, so an edit leaves the matches that
    end two characters before it, and those behind it from the first place where a new match starts with an old one.
    """

    def __init__(self, vocabulary: Vocabulary, cutter: Cutter, text: str = ""):
        self.vocabulary, self.cutter, self.text = vocabulary, cutter, ""
        self.starts: list[int] = []
        self.parts: list[Prefixes] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> int:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, text: str) -> int:
        """Put ``text`` in place of the characters from ``start`` to ``stop``. Returns how many matches were found anew."""
        if not 0 <= start <= stop <= len(self.text):
            raise ValueError("no such characters")
        bounds = [*self.starts, len(self.text)]
        kept = max(0, bisect_left(bounds, start - 1) - 1) if start > 1 else 0
        while kept and bounds[kept] + 2 > start:
            kept -= 1
        shift = len(text) - (stop - start)
        old = {b + shift: i for i, b in enumerate(self.starts) if b >= stop}
        before = self.text
        self.text = self.text[:start] + text + self.text[stop:]
        at, starts, parts = (bounds[kept] if self.starts else 0), [], []
        tail = len(self.starts)
        for m in self.cutter.pattern(self.text).finditer(self.text, at):
            if m.start() in old and self.cutter.pattern(before) is self.cutter.pattern(self.text):
                tail = old[m.start()]
                break
            starts.append(m.start())
            parts.append(self._part(None if parts or kept == len(self.parts) or self.starts[kept] >= stop else self.parts[kept], m[0]))
        self.starts[kept:] = starts + [b + shift for b in self.starts[tail:]]
        self.parts[kept:] = parts + self.parts[tail:]
        return len(starts)

    def _part(self, part: Prefixes | None, match: str) -> Prefixes:
        """``match`` as a change of ``part``, the old match that begins where it does: what they share at both ends is kept."""
        data = match.encode()
        if part is None:
            return Prefixes(self.vocabulary, data)
        new, was = data.decode("latin-1"), part.text
        same = next((i for i, (a, b) in enumerate(zip(new, was)) if a != b), min(len(new), len(was)))
        if same == len(was):
            part.append(data[same:])
            return part
        tail = next((i for i in range(min(len(new), len(was)) - same) if new[-1 - i] != was[-1 - i]), min(len(new), len(was)) - same)
        part.replace(same, len(was) - tail, data[same : len(data) - tail])
        return part

    def ids(self) -> list[int]:
        return [i for p in self.parts for i in p.ids()]


class PrefixBpe(Encoder):
    """Whole texts to ids and back. ``Encoder`` finds the matches of Latin texts many at a time and remembers the ids of matches, in
    bounded memory; any other text is cut by the pattern. Matches that aren't remembered are encoded by their prefixes.
    """

    def __init__(self, path: str, pattern: str, entries: int = MOST_MATCHES):
        self.vocabulary, self.cutter = Vocabulary(read_ranks(path)), Cutter(pattern)
        self.pieces, self.special, self.table = True, [], _Table(entries)
        self.known: dict[str, array] = {}

    def _last(self, match: str) -> array:
        text, last = match.encode().decode("latin-1"), array("i")
        self.vocabulary.extend(text, last)
        return self.vocabulary.backwards(last, len(text))

    def _merge(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = array("i"), []
        for cut in cuts:
            found = self._last(cut)
            ids.extend(found)
            counts.append(len(found))
        return np.frombuffer(ids, np.uint32), np.array(counts, np.int64)

    def _whole(self, text: str) -> bytes:
        out, known = array("i"), self.known
        for matches in self.cutter.blocks(text):
            for m in matches:
                found = known.get(m)
                if found is None:
                    found = self._last(m)
                    if len(m) <= LONGEST_MATCH:
                        if len(known) >= MOST_MATCHES:
                            known.clear()
                        known[m] = found
                out.extend(found)
        return out.tobytes()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


def prefix_bpe(path: str, pattern: str) -> PrefixBpe:
    """One a process, file and pattern; Python workers are reused over tasks, and so is what it remembers."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = PrefixBpe(path, pattern)
    return _LOADED[path, pattern]


def _pattern(pattern: str | None) -> str:
    import public_tokenizers

    return pattern or public_tokenizers.PATTERN


def encoded(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): every whole text's ids, null and empty texts none.

    Rows that repeat or share a doc_id are encoded each. No other column is read, so extra ones may have any names.
    """
    kind, pattern = docs.schema["doc_id"].dataType.simpleString(), _pattern(pattern)

    def run(batches):
        bpe = prefix_bpe(path, pattern)
        for batch in arrow_batches(batches, 512, "text", 4 << 20):
            flat, counts = bpe.batch(batch.column("text").to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes) from (doc_id, ids); null ids give null."""
    kind, pattern = rows.schema["doc_id"].dataType.simpleString(), _pattern(pattern)

    def run(batches):
        bpe = prefix_bpe(path, pattern)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                lists = part.column("ids")
                data = [None if not i.is_valid else bpe.decode(i.values.to_numpy().tolist()) for i in lists]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(data, pa.binary())], names=["doc_id", "ids", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``decoded`` rows."""
    said = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op11_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    path = default_path()
    return digests(decoded(encoded(table(spark, sf_dir, "documents"), path), path))
