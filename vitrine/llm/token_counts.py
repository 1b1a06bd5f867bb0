"""Token counts per section, by attributing tokens of whole documents.

A document is encoded once, as a whole; each token's span is joined to the
sections it meets, by sorted borders.  A token that crosses a border goes to one
section by an explicit rule: ``first`` (that of its first byte, the default),
``last`` (of its last byte) or ``most`` (of most of its bytes, the earlier on
ties).  So the counts of a document's sections add up to its token count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import values_of
from vitrine.llm.secrets import RANKS, encoder

RULES = ("first", "last", "most")


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a border) per section.  Tokens end at byte
    ``ends`` and start where the one before ends; section i covers the bytes
    from ``borders[i]`` to ``borders[i + 1]``."""
    n = len(borders) - 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, ends - 1, "right") - 1
    owner = last.copy() if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for t in crossing:
            parts = np.arange(first[t], last[t] + 1)
            overlap = np.minimum(borders[parts + 1], ends[t]) - np.maximum(borders[parts], starts[t])
            owner[t] = parts[np.argmax(overlap)]
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def sections_of(values: list[str | None]) -> list[tuple[int, str]]:
    """(field number, section) of a row's fields, to be joined: a field's lines,
    each with its line end.  Fields end with a line end of their own but for the last."""
    out = []
    for f, value in enumerate(values):
        value = (value or "") + ("\n" if f < len(values) - 1 else "")
        out += [(f, line + "\n") for line in value.split("\n")[:-1]]
        if tail := value.split("\n")[-1]:
            out.append((f, tail))
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), rule: str = "first",
                 ranks: str = RANKS) -> DataFrame:
    """One row per section: the id, field, section (0, 1, ... in the document),
    start and end (code points, end exclusive), n_tokens, n_crossing (tokens among
    them that cross a border) and doc_tokens (of the whole document).

    The document is its fields joined by line ends; null counts as empty.  A
    document without text gives one section of no tokens.  Rows that repeat an
    id are counted each.  Other columns are not read."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).alias("_id"), *(F.col(c).cast("string").alias(f"_field{i}") for i, c in enumerate(fields)))
    names = [f"_field{i}" for i in range(len(fields))]
    titles = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        size = np.zeros(enc.n_vocab, np.int64)
        for i in range(enc.n_vocab):
            try:
                size[i] = len(enc.decode_single_token_bytes(i))
            except KeyError:
                pass  # a number without a token
        for batch in batches:
            take: list[int] = []
            field: list[str] = []
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for r, values in enumerate(values_of(batch, *names)):
                parts = sections_of(list(values)) or [(0, "")]
                borders = np.cumsum([0, *(len(p.encode()) for _, p in parts)])
                chars = np.cumsum([0, *(len(p) for _, p in parts)])
                tokens = np.asarray(enc.encode_ordinary("".join(p for _, p in parts)), np.int64)
                counts, crossing = attribute(np.cumsum(size[tokens]), borders, rule)
                n = len(parts)
                take += [r] * n
                field += [titles[f] for f, _ in parts]
                for column, value in zip(columns, (np.arange(n), chars[:-1], chars[1:], counts[:n], crossing[:n], np.full(n, len(tokens)))):
                    column.append(value)
            if take:
                arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), pa.array(field, pa.string()), *arrays],
                                                 ["_id", "field", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(count, f"_id {kind}, field string, section long, start long, end long, n_tokens long, "
                                  "n_crossing long, doc_tokens long").withColumnRenamed("_id", id_col)
