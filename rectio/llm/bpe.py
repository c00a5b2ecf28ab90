"""BPE encoding and decoding by tree concatenation.

Long unsplit text is halved down to leaves, the leaves are encoded on their own (long documents
on different tasks), and neighbours are joined: a window around the cut is encoded again and
grows until its tokens meet those of both sides. Two token sequences that share one token at one
place can be spliced there, since a BPE sequence is right exactly if every adjacent pair of
its tokens is, and each pair of the spliced one stands in one of the two.

A blank or a line feed always ends a token, so the units between them are encoded alone and
remembered by their text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a unit that are encoded at once; longer units are halved.
LEAF_CHARS = 256
#: Characters of a document that one task encodes; longer documents are dealt out in pieces.
PIECE_CHARS = 65536
#: Characters on each side of a cut that are encoded again first.
WINDOW_CHARS = 32
#: Units that a worker remembers.
CACHE_UNITS = 300_000
_ROWS_OUT = 256


@dataclass
class Tokens:
    """Tokens of a text: their ids, and the characters from ``start`` to ``end`` that each covers."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def part(self, first: int, last: int) -> Tokens:
        return Tokens(self.ids[first:last], self.start[first:last], self.end[first:last])

    def moved(self, by: int) -> Tokens:
        return Tokens(self.ids, self.start + by, self.end + by)

    @staticmethod
    def concat(parts: list[Tokens]) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(*((p.ids, p.start, p.end) for p in parts))))

    def to_bytes(self) -> bytes:
        return np.stack([self.ids, self.start, self.end]).astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tokens:
        return cls(*np.frombuffer(data, "<i8").reshape(3, -1))


def _clean(tokens: Tokens) -> np.ndarray:
    """Which tokens begin and end between characters, so that no other token shares one of theirs."""
    if not len(tokens.ids):
        return np.zeros(0, dtype=bool)
    before = np.concatenate([[-1], tokens.end[:-1]])
    after = np.concatenate([tokens.start[1:], [1 << 62]])
    return (before <= tokens.start) & (tokens.end <= after) & (tokens.start < tokens.end)


def _meet(side: Tokens, window: Tokens, leftmost: bool, low: int, high: int) -> tuple[int, int] | None:
    """Places in ``side`` and ``window`` of a token that both have at the same characters, outside low to high."""
    at = {(i, s, e): k for k, (i, s, e, ok) in enumerate(zip(side.ids.tolist(), side.start.tolist(), side.end.tolist(), _clean(side).tolist())) if ok}
    clean = _clean(window) & ((window.end <= low) if leftmost else (window.start >= high))
    order = range(len(window.ids)) if leftmost else range(len(window.ids) - 1, -1, -1)
    for k in order:
        if clean[k] and (found := at.get((int(window.ids[k]), int(window.start[k]), int(window.end[k])))) is not None:
            return found, k
    return None


class Codec:
    """Encodes and decodes with the vocabulary file at ``path``, as the tokenizers library does."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None:
            raise ValueError("only vocabularies whose tokens are decoded side by side are covered")
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.reach = max([0, *(len(x) - 1 for x in special)])  # a special token at a cut may reach so far
        self.leaf_chars, self.window_chars = leaf_chars, window_chars
        self.known: dict[str, tuple[bytes, str]] = {}

    def leaf(self, text: str) -> Tokens:
        coded = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)
        return Tokens(np.array(coded.ids, dtype=np.int64), offsets[:, 0], offsets[:, 1])

    def join(self, left_text: str, left: Tokens, right_text: str, right: Tokens) -> Tokens:
        """Tokens of both texts side by side, from the tokens of each."""
        text, cut = left_text + right_text, len(left_text)
        right = right.moved(cut)
        width = self.window_chars + self.reach
        near = (cut - self.reach, cut + self.reach)
        while True:
            low, high = max(0, cut - width), min(len(text), cut + width)
            window = self.leaf(text[low:high]).moved(low)
            from_left = left.part(int(np.searchsorted(left.end, low, "right")), len(left.ids))
            skipped = len(left.ids) - len(from_left.ids)
            meets_left = (0, -1) if low == 0 else _meet(from_left, window, True, *near)
            to_right = right.part(0, int(np.searchsorted(right.start, high, "left")))
            meets_right = (0, len(window.ids)) if high == len(text) else _meet(to_right, window, False, *near)
            if meets_left and meets_right and meets_left[1] < meets_right[1]:
                before = left.part(0, 0 if low == 0 else skipped + meets_left[0] + 1)
                after = right.part(len(right.ids) if high == len(text) else meets_right[0], len(right.ids))
                return Tokens.concat([before, window.part(meets_left[1] + 1, meets_right[1]), after])
            if low == 0 and high == len(text):
                return window
            width *= 2

    def tree(self, text: str) -> Tokens:
        """Tokens of a text of any length, by halves."""
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.tree(left), right, self.tree(right))

    def decode_ids(self, ids: list[int]) -> str:
        names = self.names
        return " ".join([names[i] for i in ids])

    def _pack(self, ids) -> tuple[bytes, str]:
        return np.asarray(ids, dtype="<u4").tobytes(), self.decode_ids(list(ids))

    def units(self, texts: list[str]) -> list[list[str]]:
        """The units of each text; afterwards all of them are known."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        fresh = list({unit for units in split for unit in units} - self.known.keys())
        short = [unit for unit in fresh if len(unit) <= self.leaf_chars]
        for first in range(0, len(short), 4096):
            part = short[first : first + 4096]
            for unit, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[unit] = self._pack(coded.ids)
        for unit in fresh:
            if len(unit) > self.leaf_chars:
                self.known[unit] = self._pack(self.tree(unit).ids.tolist())
        return split

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text the ids as little-endian unsigned 32-bit integers, and the decoded text."""
        out = []
        for units in self.units(texts):
            packed = [self.known[unit] for unit in units]
            out.append((b"".join([ids for ids, _ in packed]), " ".join([name for _, name in packed if name])))
        return out


@dataclass
class Piece:
    """An encoded stretch of a text. Its first and last unit may go on in the neighbours."""

    head_text: str
    head: Tokens
    body: bytes | None  # None: the head is all there is
    tail_text: str
    tail: Tokens | None

    @classmethod
    def of(cls, codec: Codec, text: str) -> Piece:
        [units] = codec.units([text])
        head = codec.tree(units[0])
        if len(units) == 1:
            return cls(units[0], head, None, "", None)
        body = b"".join([codec.known[unit][0] for unit in units[1:-1]])
        return cls(units[0], head, body, units[-1], codec.tree(units[-1]))

    def followed_by(self, codec: Codec, other: Piece) -> Piece:
        text, tokens = (self.head_text, self.head) if self.body is None else (self.tail_text, self.tail)
        both_text, both = text + other.head_text, codec.join(text, tokens, other.head_text, other.head)
        if self.body is None:
            return Piece(both_text, both, other.body, other.tail_text, other.tail)
        if other.body is None:
            return Piece(self.head_text, self.head, self.body, both_text, both)
        body = self.body + both.ids.astype("<u4").tobytes() + other.body
        return Piece(self.head_text, self.head, body, other.tail_text, other.tail)

    def ids(self) -> bytes:
        parts = [self.head.ids.astype("<u4").tobytes()]
        if self.body is not None:
            parts += [self.body, self.tail.ids.astype("<u4").tobytes()]
        return b"".join(parts)


def join_pieces(codec: Codec, pieces: list[Piece]) -> Piece:
    while len(pieces) > 1:
        pairs = [a.followed_by(codec, b) for a, b in zip(pieces[::2], pieces[1::2])]
        pieces = pairs + pieces[len(pairs) * 2 :]
    return pieces[0]


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every row.

    ``ids`` is binary, little-endian unsigned 32-bit integers; ``decoded`` is their decoded text.
    ``path`` must lead to the vocabulary on every worker. A null or empty text has no tokens,
    repeated rows and null ids are kept, an empty table gives none. Texts of more than
    ``piece_chars`` characters are encoded in pieces on different tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids binary, decoded string"
    names = ["doc_id", "n_tokens", "ids", "decoded"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS_OUT):
                part = batch.slice(first, _ROWS_OUT)
                coded = codec.encode(part.column(1).to_pylist())
                ids = [x for x, _ in coded]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([x for _, x in coded], pa.string())],
                    names=names,
                )

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                pieces = [text[k : k + piece_chars] for k in range(0, len(text), piece_chars)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(pieces), pa.int64()), pa.array([row] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.string())],
                    names=["doc_id", "row", "piece", "text"],
                )

    def piecewise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                piece = Piece.of(codec, part.column(3)[0].as_py())
                more = [piece.head_text, piece.head.to_bytes(), piece.body, piece.tail_text, piece.tail and piece.tail.to_bytes()]
                kinds = [pa.string(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *(pa.array([x], kind) for x, kind in zip(more, kinds))],
                    names=["doc_id", "row", "piece", "head_text", "head", "body", "tail_text", "tail"],
                )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(path)
        pieces = [
            Piece(x.head_text, Tokens.from_bytes(x.head), x.body, x.tail_text, None if x.tail is None else Tokens.from_bytes(x.tail))
            for x in group.sort_values("piece").itertuples()
        ]
        ids = join_pieces(codec, pieces).ids()
        decoded = codec.decode_ids(np.frombuffer(ids, "<u4").tolist())
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1].array, "n_tokens": [len(ids) // 4], "ids": [ids], "decoded": [decoded]})

    long = F.length("text") > piece_chars
    pieces = rows.where(long).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    pieces = pieces.mapInArrow(cut_up, "doc_id long, row long, piece long, text string").repartition("row", "piece")
    coded = pieces.mapInArrow(piecewise, "doc_id long, row long, piece long, head_text string, head binary, body binary, tail_text string, tail binary")
    return rows.where(~long).mapInArrow(whole, schema).unionByName(coded.groupBy("row").applyInPandas(merge, schema))


def decode_documents(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the decoded text of a binary column of ids; null ids decode to null."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in coded.schema.fields if f.name != out_col] + [T.StructField(out_col, T.StringType())])
    picked = coded.select(*[c for c in coded.columns if c != out_col])
    at = picked.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            texts = [None if x is None else codec.decode_ids(np.frombuffer(x, "<u4").tolist()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return picked.mapInArrow(run, schema)
