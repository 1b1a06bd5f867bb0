"""SentencePiece encoding and decoding by Viterbi over an Aho-Corasick automaton.

The automaton over all pieces reads a text once; at each position its output
links give every piece that ends there, longest first, and each relaxes the best
score of that end.  On ties the longer last piece wins.  Characters without a
piece become byte pieces.  Between two characters that no piece holds side by
side the text is cut: the best path is the concatenation of the parts' best
paths, and a task remembers those of short parts.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm.common import values_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"      # stands for a space in pieces
CACHE = 400_000      # parts a task remembers
CACHE_CHARS = 64     # of at most so many characters


class Parts(dict):
    """The ids of parts, found when first asked for; parts of at most ``CACHE_CHARS``
    characters are remembered.  Looking up a remembered part is no Python call."""

    def __init__(self, find: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.find = find

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.find(part)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[part] = ids
        return ids


class Spelling(dict):
    """The text of ids; unknown ids are U+2047."""

    def __missing__(self, i: int) -> str:
        return "\u2047"


class Pieces:
    """A vocabulary: pieces with scores, byte pieces, and the automaton."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: dict[int, int], unk_id: int):
        import ahocorasick

        # Bytes over 127 stand as the lone surrogates that "surrogateescape" turns back into bytes.
        self.text = Spelling({i: p.replace(MARK, " ") for p, i, _ in pieces})
        self.text |= {i: chr(b if b < 128 else 0xDC00 + b) for b, i in byte_ids.items()}
        self.byte_ids = byte_ids
        self.unk_id = unk_id
        self.automaton = ahocorasick.Automaton()
        for piece, i, score in pieces:
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.unk_score = min((s for _, _, s in pieces), default=0.0) - 10.0
        inside = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in pieces)
        self.part = re.compile(r".+" if inside else rf"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.single = {p for p, _, _ in pieces if len(p) == 1}
        self.pairs = {p[i:i + 2] for p, _, _ in pieces for i in range(len(p) - 1)}
        self.known = Parts(self.ids_of)

    @classmethod
    def load(cls, path: str = MODEL) -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        special = {i for i in every if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        return cls([(sp.id_to_piece(i), i, sp.get_score(i)) for i in every if i not in special and not sp.is_unused(i)],
                   {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}, sp.unk_id())

    def spell(self, char: str) -> list[int]:
        """A character without a piece: its bytes, or unk where the vocabulary has none."""
        ids = [self.byte_ids.get(b, -1) for b in char.encode()]
        return [self.unk_id] if -1 in ids else ids

    def viterbi(self, part: str) -> tuple[int, ...]:
        """The best path over one part."""
        n = len(part)
        # Both by the last character of a path; best[-1] is that of the empty path.
        best: list[float] = [float("-inf")] * n + [0.0]
        chosen: list = [None] * n
        if self.single.issuperset(part):
            for end, piece in self.automaton.iter(part):
                score = best[end - piece[0]] + piece[2]
                if score > best[end]:
                    best[end] = score
                    chosen[end] = piece
        else:
            matches = self.automaton.iter(part)
            at, piece = next(matches, (n, None))
            for end in range(n):
                while at == end:
                    score = best[end - piece[0]] + piece[2]
                    if score > best[end]:
                        best[end], chosen[end] = score, piece
                    at, piece = next(matches, (n, None))
                if part[end] not in self.single and best[end - 1] + self.unk_score > best[end]:
                    best[end], chosen[end] = best[end - 1] + self.unk_score, (1, -1, self.unk_score)
        path: list[int] = []
        end = n - 1
        while end >= 0:
            size, i, _ = chosen[end]
            if i >= 0:
                path.append(i)
            else:
                path += reversed(self.spell(part[end]))
            end -= size
        path.reverse()
        return tuple(path)

    def ids_of(self, part: str) -> tuple[int, ...]:
        pairs = self.pairs
        cuts = () if part[1:].isalpha() else [i for i, two in enumerate(map(operator.add, part, part[1:]), 1) if two not in pairs]
        if not cuts:
            return self.viterbi(part)
        return tuple(itertools.chain.from_iterable(self.known[part[i:j]] for i, j in zip([0, *cuts], [*cuts, len(part)])))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        ids: list[int] = []
        # A space mark that the text itself holds is spelled in bytes, so that it comes back.
        for i, stretch in enumerate(text.split(MARK)):
            if i:
                ids += self.spell(MARK)
            marked = stretch.replace(" ", MARK)
            ids.extend(itertools.chain.from_iterable(map(self.known.__getitem__, self.part.findall(marked if i else MARK + marked))))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids U+2047."""
        joined = "".join(map(self.text.__getitem__, ids))
        try:
            joined.encode()
        except UnicodeEncodeError:
            joined = joined.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return joined[1:] if joined.startswith(" ") else joined


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ids array<int>, n_tokens long and round_trip (decoding the
    ids gives the text again).  A null or empty text has no ids and round-trips
    to the empty text.  Columns of those names are replaced; others are kept."""
    rest = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "round_trip")]
    rows = docs.select(F.col(text_col).alias("_text"), F.struct(*rest).alias("_row"))
    row = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for batch in batches:
            texts = [t or "" for t, in values_of(batch, "_text")]
            ids = [pieces.encode(t) for t in texts]
            same = [pieces.decode(i) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(same, pa.bool_())],
                ["_row", "ids", "n_tokens", "round_trip"])

    return rows.mapInArrow(C.tidy(run), f"_row {row}, ids array<int>, n_tokens long, round_trip boolean").select(
        "_row.*", "ids", "n_tokens", "round_trip")


def decode(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with decoded string, the text of the ids (null ids: empty)."""
    rest = [c for c in rows.columns if c.lower() != "decoded"]
    packed = rows.select(F.col(ids_col).alias("_ids"), F.struct(*rest).alias("_row"))
    row = packed.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([pieces.decode(i or []) for i, in values_of(batch, "_ids")], pa.string())], ["_row", "decoded"])

    return packed.mapInArrow(C.tidy(run), f"_row {row}, decoded string").select("_row.*", "decoded")
