"""Periodic runs: stretches of words that repeat with one period, four times or more.

A run with period q over words s..s+L holds one maximal pair: the stretch from s
and the stretch from s + q, both of L - q words, equal, with different words
before them and after them.  The other way round, a maximal pair of length l and
distance d with l >= 3d is such a stretch whole, so nothing needs extending; of
the pairs with one start and end the least distance is the period.

Pairs come from the tree of LCP intervals of a document's suffix array, worked
up from the leaves.  An interval keeps its positions in text order, each with the
class of the word to its left.  When a smaller child is merged, each of its
positions looks at the positions within a third of the LCP.  Equal stretches so
close lie a period apart, so all but the first of them have the same word to
their left, and only the first one or the position itself can make pairs: the
classes are read only where they differ.  Intervals with an LCP under five words
make no pair with l >= 3d and l + d >= 6, so only suffixes whose first five words
occur twice are sorted at all.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 6
MIN_REPEATS = 4


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    column = np.empty(len(words), dtype=object)
    column[:] = words
    return pd.factorize(column)[0].astype(np.int64)


def renumbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of pairs, in their order.  ``second`` is -1 or more."""
    return np.unique(first * (int(second.max(initial=0)) + 2) + second + 1, return_inverse=True)[1]


def shifted(rank: np.ndarray, by: int) -> np.ndarray:
    """The ranks ``by`` places on; -1 past the end."""
    out = np.full(len(rank), -1, np.int64)
    if by < len(rank):
        out[:-by] = rank[by:]
    return out


def repeated_suffixes(numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes whose first ``least`` words occur more than once, in order, and
    those words' group."""
    rank, have = numbers, 1
    while have < least:  # ranks by the first ``have`` words: the next step may overlap
        step = min(have, least - have)
        rank = renumbered(rank, shifted(rank, step))
        have += step
    whole = len(numbers) - least + 1
    group = rank[:whole]
    active = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    order = sort_suffixes(rank, active, least)
    return order, group[order]


def sort_suffixes(rank: np.ndarray, active: np.ndarray, have: int) -> np.ndarray:
    """``active`` in the order of their suffixes.  ``rank`` orders all by their first
    ``have`` words; sorting by the next ``have`` doubles that until none are equal."""
    place = np.empty(len(rank), np.int64)
    place[np.argsort(rank, kind="stable")] = np.arange(len(rank))
    # A suffix's rank is the place of the first of its equals: it stays right while they are told apart.
    low = np.full(int(rank.max(initial=0)) + 1, len(rank))
    np.minimum.at(low, rank, place)
    rank = low[rank]
    done = []
    while len(active):
        ahead = active + have
        key = np.where(ahead < len(rank), rank[np.minimum(ahead, len(rank) - 1)], -1)
        order = np.lexsort((key, rank[active]))
        active, key = active[order], key[order]
        base = rank[active]
        new_group = np.concatenate(([True], base[1:] != base[:-1]))
        new_key = new_group | np.concatenate(([True], key[1:] != key[:-1]))
        index = np.arange(len(active))
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        key_start = np.maximum.accumulate(np.where(new_key, index, 0))
        rank[active] = base + key_start - group_start
        alone = new_key & np.concatenate((new_key[1:], [True]))
        done.append(active[alone])
        active = active[~alone]
        have *= 2
    order = np.concatenate(done) if done else active
    return order[np.argsort(rank[order], kind="stable")]


def common_prefixes(numbers: list[int], order: list[int], group: list[int], least: int) -> list[int]:
    """For each suffix in ``order``, the words it shares with the one before it if
    both begin alike (0 otherwise).  A suffix shares one word less than the suffix
    that starts a word earlier, or more."""
    n = len(numbers)
    before = {p: order[i - 1] for i, p in enumerate(order) if i and group[i] == group[i - 1]}
    shared: dict[int, int] = {}
    last, length = -2, 0
    for p in sorted(before):
        length = max(length - 1, least) if p == last + 1 else least
        q = before[p]
        stop = n - max(p, q)
        while length < stop and numbers[p + length] == numbers[q + length]:
            length += 1
        shared[p] = length
        last = p
    return [shared.get(p, 0) for p in order]


def pairs_with(position: int, others: list[int], length: int, numbers: list[int]) -> Iterator[tuple[int, int]]:
    """(start, distance) of the pairs of ``position`` with ``others`` (sorted) that
    differ on the left and lie within a third of ``length``."""
    def left(p: int) -> int:
        return numbers[p - 1] if p else -1

    reach = length // (MIN_REPEATS - 1)
    at = bisect_left(others, position)
    first = bisect_left(others, position - reach, 0, at)
    # Of those before, only the first may have another word to its left.
    if first < at and left(others[first]) != left(position):
        yield others[first], position - others[first]
    # Those after share the word to their left.
    if at < len(others) and others[at] - position <= reach and left(others[at]) != left(position):
        while at < len(others) and others[at] - position <= reach:
            yield position, others[at] - position
            at += 1


def maximal_pairs(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, distance, length) of the maximal pairs with length >= 3 * distance
    and 6 words or more in all; a position before the first word, like one after
    the last, equals nothing."""
    least = MIN_WORDS - 1   # of a pair at distance 1; at greater distances l >= 3d asks for more
    if len(numbers) < MIN_WORDS:
        return
    suffixes, groups = repeated_suffixes(numbers, least)
    if not len(suffixes):
        return
    words, order = numbers.tolist(), suffixes.tolist()
    shared = common_prefixes(words, order, groups.tolist(), least)
    stack: list[tuple[int, list[int]]] = []     # open intervals: LCP, positions so far

    def merged(length: int, a: list[int], b: list[int]) -> Generator[tuple[int, int, int], None, list[int]]:
        large, small = (a, b) if len(a) >= len(b) else (b, a)
        for p in small:
            for start, distance in pairs_with(p, large, length, words):
                if length + distance >= MIN_WORDS:
                    yield start, distance, length
        for p in small:
            insort(large, p)
        return large

    for i, p in enumerate(order):
        length = shared[i + 1] if i + 1 < len(order) else 0
        child = [p]
        # Close the intervals that are deeper than what is shared with the next suffix.
        while stack and stack[-1][0] > length:
            depth, positions = stack.pop()
            child = yield from merged(depth, positions, child)
        if not length:
            continue
        if stack and stack[-1][0] == length:
            stack[-1] = (length, (yield from merged(length, stack[-1][1], child)))
        else:
            stack.append((length, child))


def runs_of(numbers: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and then period."""
    best: dict[tuple[int, int], int] = {}
    for start, distance, length in maximal_pairs(numbers):
        key = (start, length + distance)
        if distance < best.get(key, distance + 1):
            best[key] = distance
    return np.array(sorted((s, n, q) for (s, n), q in best.items()), np.int64).reshape(-1, 3)[:, [0, 1, 2]]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def greatest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; the least start, then period on ties."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  split: Callable[[int | None, str | None], list[bytes]] | None = None, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_runs, runs (start, length,
    period of each), the run with the greatest length / period (start, length,
    period, exponent_milli; nulls without a run), runs_sha256, collapsed_sha256 and
    collapsed, the text of the words that no run holds after its first period (null
    unless ``with_text``).

    A run has the smallest period q, six words and 4q words at least, and ends
    where a neighbouring word breaks the period.  Null and empty texts have no
    words and no run.  ``split`` gives the words of a row by its id and text.
    Rows that repeat are treated alike; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    split = split or (lambda _, text: words_of(text))
    kind = dict(rows.dtypes)["_id"]
    found = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    types = [pa.int64(), pa.int64(), found, *[pa.int64()] * 4, pa.string(), pa.string(), pa.string()]
    names = ["n_words", "n_runs", "runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split(key, text.as_py())
                runs = runs_of(numbers_of(words))
                kept = words
                if len(runs):
                    gone = dropped(len(words), runs).tolist()
                    kept = [w for w, g in zip(words, gone) if not g]
                collapsed = b" ".join(kept)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                top = greatest(runs)
                row = (len(words), len(runs), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()],
                       *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
                       hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(),
                       collapsed.decode("utf-8", "surrogatepass") if with_text else None)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], ["_id", *names])

    return rows.mapInArrow(scan, f"_id {kind}, n_words long, n_runs long, runs array<struct<start: long, length: long, period: long>>, "
                                 "start long, length long, period long, exponent_milli long, runs_sha256 string, "
                                 "collapsed_sha256 string, collapsed string").withColumnRenamed("_id", id_col)
