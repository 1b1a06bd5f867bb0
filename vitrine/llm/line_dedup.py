"""Line dedup by winnowing over line hashes.

A line is a stretch of words up to a line end or a punctuation mark, so that a
passage that begins or ends within a sentence loses little at its ends.  Runs of
lines that just reach ``GRAM_WORDS`` words are hashed from their lines' hashes;
every window of lines that just reaches ``MIN_WORDS`` words selects the least of
the hashes within it as a fingerprint.  Equal windows select equal fingerprints,
so two equal runs of that many words always share one.  Documents that share a
fingerprint go on: their windows around shared fingerprints, and the runs from a
window's first line that end before the next window does, are joined by content
with the first place each occurs at.  These runs are the shortest ones back from
each line end, so together they cover every maximal equal run up to both its ends;
the lines of a later run are deleted, those of the first occurrence stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm.common import values_of

MIN_WORDS = 25     # a run of so many words is found for certain
GRAM_WORDS = 12    # words of the runs that fingerprints are chosen from


MARKS = ".!?,;:"
WIDE_MARKS = "。！？，、；："
# Scripts written without spaces: kana, Han, Thai to Khmer, fullwidth forms.
WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
WIDE_WORD = 2      # characters of such a script that count as one word


def lines_of(text: str | None) -> tuple[list[int], list[int], list[str], list[int]]:
    """(starts, ends, contents, words) of the lines that are not blank.  Lines end
    with line ends, and with one of ``MARKS`` before a space or one of
    ``WIDE_MARKS``; a content is the line without white space around, its words
    are what spaces separate, and as many more as the characters of scripts
    without spaces make."""
    lines, over, wide = split(text)
    ends = np.cumsum([len(line) + over for line in lines], dtype=np.int64)
    starts, ends = [0, *ends[:-1].tolist()], ends.tolist()
    held = [i for i, line in enumerate(lines) if not (line.isspace() or not line)]
    contents = [lines[i].strip() for i in held]
    return [starts[i] for i in held], [ends[i] for i in held], contents, words_of(contents, wide)


def split(text: str | None) -> tuple[list[str], int, bool]:
    """(lines, characters of a line's end that they lack, whether a script without spaces occurs)."""
    text = text or ""
    # The cuts keep all offsets: a mark's space becomes a line end.
    for mark in MARKS:
        text = text.replace(mark + " ", mark + "\n")
    if WIDE.search(text) is not None:
        return wide_lines(text), 0, True
    return text.split("\n"), 1, False


def words_of(contents: list[str], wide: bool) -> list[int]:
    if wide:
        return [c.count(" ") + 1 + len(WIDE.findall(c)) // WIDE_WORD for c in contents]
    return [c.count(" ") + 1 for c in contents]


def wide_lines(text: str) -> list[str]:
    """Lines with their ends, also cut after ``WIDE_MARKS`` (and a line end that follows)."""
    return re.findall(f"[^\\n{WIDE_MARKS}]*(?:[{WIDE_MARKS}]\\n?|\\n|\\Z)", text)


class Hashes:
    """128-bit hashes of runs of lines, as polynomials in their lines' hashes
    modulo 2^64 (twice), for any run from running sums."""

    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self):
        self.powers = self.inverses = np.ones((1, 2), np.uint64)

    def grow(self, n: int) -> None:
        n = 1 << max(n, 1024).bit_length()
        steps = np.ones((2, n, 2), np.uint64)
        for c, base in enumerate(self.BASES):
            steps[0, 1:, c], steps[1, 1:, c] = base, pow(base, -1, 1 << 64)
        self.powers, self.inverses = np.multiply.accumulate(steps, axis=1)

    def of(self, contents: list[str], first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """int64 of shape (runs, 2)."""
        import xxhash

        if len(contents) >= len(self.powers):
            self.grow(len(contents) + 1)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, contents)), np.uint64).reshape(-1, 2)
        sums = np.zeros((len(h) + 1, 2), np.uint64)
        np.cumsum(h * self.powers[:len(h)], axis=0, out=sums[1:])
        mixed = (sums[stop] - sums[first]) * self.inverses[first]
        mixed ^= mixed >> np.uint64(32)
        return mixed.view(np.int64)


class Windows:
    """The windows of a batch of texts, all lines of the batch numbered through."""

    def __init__(self, texts: list[str | None], hashes: Hashes, min_words: int, gram_words: int):
        self.contents: list[str] = []
        words: list[int] = []
        counts = []
        for text in texts:
            lines, _, wide = split(text)
            some = [c for line in lines if (c := line.strip())]
            self.contents += some
            words += words_of(some, wide)
            counts.append(len(some))
        self.hashes = hashes
        ends = np.cumsum(counts, dtype=np.int64)
        self.text_of_line = np.repeat(np.arange(len(counts)), counts)
        self.first_line = ends - counts
        last = np.repeat(ends, counts)
        reach = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
        stop = np.searchsorted(reach, reach[:-1] + min_words)
        self.start = np.flatnonzero(stop <= last)      # a window does not leave its text
        self.stop = stop[self.start]
        self.text = self.text_of_line[self.start]
        # Runs from window i's first line end before self.until[i]: there the next window, or the text, ends.
        following = np.append(stop[1:], len(last) + 1)
        self.until = np.maximum(np.minimum(following[self.start], last[self.start] + 1), self.stop + 1)
        # Window i holds the grams from its first line on that end within it.
        gram_stop = np.searchsorted(reach, reach[:-1] + gram_words)
        self.grams = hashes.of(self.contents, np.arange(len(last)), np.minimum(gram_stop, len(last)))[:, 0]
        self.whole = gram_stop <= last
        beyond = np.searchsorted(gram_stop, self.stop, "right")
        padded = np.append(self.grams, np.int64(2 ** 63 - 1))
        self.least = (np.minimum.reduceat(padded, np.stack([self.start, beyond], 1).ravel())[::2]
                      if len(self.start) else np.zeros(0, np.int64))

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, fingerprint, places): one for each stretch of windows that select
        the same; 2 places where the text holds any gram twice, else 1."""
        fresh = np.ones(len(self.least), bool)
        fresh[1:] = (self.least[1:] != self.least[:-1]) | (self.text[1:] != self.text[:-1])
        text, grams = self.text_of_line[self.whole], self.grams[self.whole]
        order = np.lexsort((grams, text))
        text, grams = text[order], grams[order]
        twice = np.unique(text[1:][(text[1:] == text[:-1]) & (grams[1:] == grams[:-1])])
        return self.text[fresh], self.least[fresh], 1 + np.isin(self.text[fresh], twice)

    def sharing(self, text: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Numbers of the windows whose fingerprint is among those (text, print)."""
        spread = np.int64(-7046029254386353131)
        return np.flatnonzero(np.isin(self.least + self.text * spread, prints + text * spread))

    def runs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, stop) of the runs of those windows: each window itself, and longer
        ones that the next window does not reach the end of.  At most one a line end
        besides the windows."""
        n = self.until[which] - self.stop[which]
        window = np.repeat(which, n)
        return window, self.stop[window] + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)

    def contents_of(self, window: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.hashes.of(self.contents, self.start[window], stop)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
               gram_words: int = GRAM_WORDS) -> DataFrame:
    """``docs`` with the lines of later repeated runs deleted from the text, and
    the columns removed_words and removed_lines (replaced if present).

    A line is deleted if it lies in a run of whole lines with ``min_words`` words
    at least that occurs before: in a row of smaller id, or earlier in the same
    text without overlap.  White space around lines does not count.
    Texts that lose nothing stay as they are, null ones too; a text that loses
    all its lines becomes empty.  A null id comes before all others.  Rows with
    equal id and text count as one.  An empty table gives no rows."""
    extra = ("removed_words", "removed_lines")
    names = [c for c in docs.columns if c.lower() not in extra]
    text = F.col(text_col)
    packed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text")).alias("_doc"),
                         text.alias("_text"), F.struct(*(c for c in names if c != text_col)).alias("_row"))
    with C.Scratch(docs.sparkSession) as scratch:
        doc = packed.schema["_doc"].dataType.simpleString()
        rows = packed.select("_doc", "_text")

        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                found = Windows([t for t, in values_of(batch, "_text")], hashes, min_words, gram_words)
                take, prints, places = found.fingerprints()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(prints, pa.int64()),
                                                  pa.array(places, pa.int64())], ["_doc", "print", "n"])

        prints = scratch.table(rows.mapInArrow(C.tidy(select), f"_doc {doc}, print long, n long"))
        total = prints.count()
        repeated = scratch.table(prints.groupBy("print").agg(F.sum("n").alias("places"), F.count("*").alias("size")).filter("places > 1"))
        suspects = scratch.table(C.join_hot(prints, repeated, "print", "size", total).groupBy("_doc").agg(F.collect_set("print").alias("prints")))

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                rows = list(values_of(batch, "_text", "prints"))
                found = Windows([t for t, _ in rows], hashes, min_words, gram_words)
                shared = [np.array(p, np.int64) for _, p in rows]
                which = found.sharing(np.repeat(np.arange(len(rows)), [len(p) for p in shared]),
                                      np.concatenate(shared) if shared else np.zeros(0, np.int64))
                which, stop = found.runs(which)
                content, text = found.contents_of(which, stop), found.text[which]
                at = found.start[which] - found.first_line[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text, pa.int64())), *(pa.array(x, pa.int64()) for x in (
                        content[:, 0], content[:, 1], at, stop - found.start[which]))], ["_doc", "gram", "gram2", "at", "size"])

        flagged = C.likely(rows, "_doc", suspects.select("_doc"), suspects.count()).filter("_maybe").select("_doc", "_text")
        places = scratch.table(flagged.join(suspects, "_doc").mapInArrow(
            grams, f"_doc {doc}, gram long, gram2 long, at long, size long"))
        first = scratch.table(places.groupBy("gram", "gram2").agg(
            F.min(F.struct("_doc", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
        later = C.join_hot(places, first, ["gram", "gram2"], "n", places.count()).filter(
            (F.col("first._doc") < F.col("_doc")) | ((F.col("first._doc") == F.col("_doc")) & (F.col("first.at") + F.col("size") <= F.col("at"))))
        cuts = scratch.table(later.groupBy("_doc").agg(F.collect_set(F.shiftleft("at", 31) + F.col("size")).alias("cuts")))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, lost_words, lost_lines = [], [], []
                for value, runs in values_of(batch, "_text", "cuts"):
                    starts, ends, _, words = lines_of(value)
                    packed_runs = np.array(runs or (), np.int64)
                    at, size = packed_runs >> 31, packed_runs & (2 ** 31 - 1)
                    edges = np.bincount(at, minlength=len(starts) + 1) - np.bincount(at + size, minlength=len(starts) + 1)
                    gone = np.cumsum(edges[:-1]) > 0
                    if gone.any():
                        kept, at = [], 0
                        for i in np.flatnonzero(gone):
                            kept.append(value[at:starts[i]])
                            at = ends[i]
                        value = "".join([*kept, value[at:]]).strip()
                    texts.append(value), lost_words.append(int(np.array(words, int)[gone].sum())), lost_lines.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lost_words, pa.int64()), pa.array(lost_lines, pa.int64())],
                                                 ["_row", "_text", *extra])

        row = packed.schema["_row"].dataType.simpleString()
        # The small tables that the result still reads outlive the scratch folder as checkpoints.
        cuts = cuts.checkpoint()
        marked = C.likely(packed, "_doc", cuts.select("_doc"), cuts.count())
        changed = marked.filter("_maybe").join(cuts, "_doc", "left").select("_row", "_text", "cuts").mapInArrow(
            cut, f"_row {row}, _text string, removed_words long, removed_lines long")
        same = marked.filter("NOT _maybe").select("_row", "_text", F.lit(0).cast("long").alias("removed_words"), F.lit(0).cast("long").alias("removed_lines"))
        columns = [F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names]
        return changed.unionByName(same).select(*columns, *extra)
