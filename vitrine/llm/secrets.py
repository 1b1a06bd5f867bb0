"""Secret scans: fixed patterns, and a token-efficiency test.

Natural words compress to few tokens of a byte-pair vocabulary; random strings
do not.  A run of key characters with few characters per token is reported as
``random``, unless it is a digest of a usual length, a UUID, a number, an
identifier made of word-like pieces, or lies within a span found by a pattern.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import values_of

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MIN_RANDOM = 20          # characters of a run worth testing
MAX_CHARS_PER_TOKEN = 2.2
# The patterns of the contract.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")   # runs are maximal, so this drops the short ones
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
# The last one is possessive, as no other split of an identifier can match: one pass over runs of any length.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})|[0-9+/_=-]+"
    r"|(?P<identifier>(?:(?:[A-Z]*+[a-z]{2,}+|[A-Z]{2,}+)[0-9]{0,2}+[+/_=-]*+)++))")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
KINDS = ("assign", "access", "hex", "random")


def encoder(path: str = RANKS):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start and kind."""
    low = text.lower()
    spans = []
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def word_like(run: str, tokens: Callable[[str], int]) -> bool:
    """Whether the pieces of an identifier take few tokens for their letters, as
    lower-case words after a space: the form that a vocabulary holds words in."""
    pieces = PIECE.findall(run)
    return sum(map(len, pieces)) > MAX_CHARS_PER_TOKEN * tokens(" " + " ".join(pieces).lower())


def random_spans(text: str, found: list[tuple[int, int, int]], tokens: Callable[[str], int]) -> list[tuple[int, int, int]]:
    """Runs that take many tokens for their length and overlap no span in ``found``."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        known = KNOWN.fullmatch(run)
        if (known and not known["identifier"]) or any(s < m.end() and m.start() < e for s, _, e in found):
            continue
        if len(run) <= MAX_CHARS_PER_TOKEN * tokens(run) and not (known and word_like(run, tokens)):
            out.append((m.start(), 3, m.end()))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """One row per row of ``docs``: the id, n_assign, n_access, n_hex, n_random,
    base_sha256 (of the list of pattern spans) and spans (all).

    Offsets are code points, ends exclusive; a span is the whole match.  Null
    counts as empty; without a span the list is empty.  Other columns are not
    read; repeated rows are scanned alike."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, in values_of(batch, "_text"):
                text = text or ""
                base = pattern_spans(text)
                every = sorted(base + random_spans(text, base, lambda run: len(enc.encode_ordinary(run))))
                kinds = [k for _, k, _ in every]
                row = (*(kinds.count(k) for k in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:])],
                ["_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(scan, f"_id {kind}, n_assign long, n_access long, n_hex long, n_random long, "
                                 "base_sha256 string, spans string").withColumnRenamed("_id", id_col)
