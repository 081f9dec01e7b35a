"""Line-first cleaning: rules judge each line, failed lines go, and documents that lose too much are rejected.

Rules of a line, over its words (runs of anything but ASCII white space):

* navigation: at least ``nav_marks`` separators (``| > » › · •``) standing as words or between words, and one for every ``nav_words`` words or fewer; or a short line made of menu words
* boilerplate: a fixed phrase of licences, cookie notices and page furniture
* symbols: over a third of its words end in or are made of symbols
* shouting: ends most of its words with ``!``
* repetition: at least 12 words of which under a fifth differ
* punctuation: at least ``open_words`` words, no sentence mark anywhere and none of the line's words a number, or a bracket or brace at its end (code)

Blank lines neither fail nor count. A document whose lines keep less than ``least`` of its
words is rejected; so is one that fails the base rules on the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

_MARKS = frozenset("| > » › · • ›› || >>".split())
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BOILERPLATE = re.compile(
    r"\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|javascript (?:is )?(?:disabled|required)"
    r"|click here|read more|sign (?:in|up)|log ?in|subscribe (?:now|to)|share (?:this|on)|skip to (?:main )?content|back to top|lorem ipsum|©)",
    re.I,
)
_MENU = frozenset("home about contact login register menu search next previous prev help faq sitemap share print news shop cart blog archive".split())
_SENTENCE = re.compile(r"[.!?…:;。！？]")
_ODD_END = re.compile(r"[#*$%&|<>]{2,}$")


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    failed: bool


def repeated(w: list) -> int:
    """Words that lie in a 3-word window occurring at least twice."""
    n = len(w)
    if n < 4:
        return 0
    windows = list(zip(w, w[1:], w[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, end = 0, 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def base_rules(text: str | None) -> Base:
    """Counts over the whole text, and whether it has under 50 words or over half of them repeated."""
    data = (text or "").encode()
    w = data.split()
    chars = len(b"".join(w).decode())
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    repeat = repeated(w)
    return Base(len(w), chars, sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))), dup, repeat, len(w) < 50 or 100 * repeat > 50 * len(w))


def failing_rule(line: str, nav_marks: int = 3, nav_words: int = 4, open_words: int = 12) -> str | None:
    """The first rule that a line fails, or None."""
    w = line.split()
    n = len(w)
    if not n:
        return None
    if "|" in line or ">" in line or "»" in line or "›" in line or "·" in line or "•" in line:
        marks = sum(x in _MARKS for x in w)
        if marks >= nav_marks and marks * nav_words >= n - marks:
            return "navigation"
    if n <= 8 and all(x.strip(",.|/").lower() in _MENU for x in w):
        return "navigation"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 5 and _SYMBOLS.search(line) and 3 * sum(_ODD_END.search(x) is not None or not any(map(str.isalnum, x)) for x in w) > n:
        return "symbols"
    if n >= 5 and "!" in line and 2 * sum(x[-1] == "!" for x in w) > n:
        return "shouting"
    if n >= 12 and 5 * len(set(w)) < n:
        return "repetition"
    if line.rstrip()[-1] in "{};" or n >= open_words and not _SENTENCE.search(line) and not any(c.isdigit() for c in line):
        return "punctuation"
    return None


def cleaned(text: str | None) -> tuple[str, int, int, dict[str, int]]:
    """(text without failed lines, words before, words after, failed lines by rule)."""
    kept, before, after, failed = [], 0, 0, Counter()
    for line in (text or "").split("\n"):
        n = len(line.encode().split())
        before += n
        rule = failing_rule(line)
        if rule:
            failed[rule] += 1
        else:
            after += n
            kept.append(line)
    return "\n".join(kept), before, after, dict(failed)


def clean(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """One row a row of ``docs``: doc_id, the base counts, base_failed, kept, text (cleaned), n_words_left, failed_lines.

    Null texts are empty: no words, so base_failed and not kept. Repeated rows are judged alike.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "text", "n_words_left", "failed_lines"]

    def run(batches):
        for batch in arrow_batches(batches, 256, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_rules(text)
                new, before, after, failed = cleaned(text)
                rows.append((*base[:5], base.failed, not base.failed and after >= least * before, new, after, list(failed.items())))
            columns = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int64(), pa.map_(pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, text string, n_words_left long, failed_lines map<string, long>")


def op7_line_rules(spark, sf_dir: str) -> DataFrame:
    found = clean(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left", F.aggregate(F.map_values("failed_lines"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_failed_lines"))
