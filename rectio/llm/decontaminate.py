"""Benchmark decontamination with suffix arrays over the training text.

Spark deals the documents into shards of about a million words. Each shard is indexed by a
suffix array over its words, every suffix of every benchmark item is binary-searched in it,
and the search gives the longest verbatim match of the suffix, its places, and the occurrences
of the item's windows. Benchmark items are taken in blocks of bounded size, so neither the
driver nor a task holds more than a block of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rectio.llm.common import cut, unused

WINDOW = 13
SHARD_WORDS = 1_000_000
#: UTF-8 bytes of item text that are indexed together, and blocks that are broadcast for one pass over the documents.
BLOCK_BYTES = 8_000_000
PASS_BLOCKS = 4

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


@dataclass
class Block:
    """Some benchmark items as word numbers from 1; ``suffix`` and ``item`` tell each word's place."""

    ids: list[str]
    vocabulary: dict[bytes, int]
    words: np.ndarray
    item: np.ndarray
    left: np.ndarray  # words from here to the end of the item
    start: np.ndarray  # place within the item
    width: np.ndarray  # words of the window that starts here, 0 where none does

    @classmethod
    def of(cls, rows: Sequence[tuple[str, str]], window: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        words: list[int] = []
        item, left, start, width = [], [], [], []
        for number, (_, text) in enumerate(rows):
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            n = len(own)
            words += own
            item += [number] * n
            left += range(n, 0, -1)
            start += range(n)
            width += [window if n - i >= window else n if i == 0 else 0 for i in range(n)]
        arrays = [np.array(x, dtype=np.int64) for x in (words, item, left, start, width)]
        return cls([key for key, _ in rows], vocabulary, *arrays)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of the known words (numbers over 0), sorted by up to ``depth`` words from there.

    Prefix doubling; a round sorts only places that are still tied. Unknown words are zero:
    they equal one another here, and no query passes over one.
    """
    n = len(words)
    places = np.flatnonzero(words)
    if not len(places):
        return places
    bits = max(1, int(words.max()).bit_length())
    done = max(1, min(62 // bits, depth))
    padded = np.concatenate([words, np.zeros(done, dtype=np.int64)])
    key = np.zeros(len(places), dtype=np.int64)
    for k in range(done):
        key = (key << bits) | padded[places + k]
    order = np.argsort(key, kind="stable")
    array, key = places[order], key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    rank = np.zeros(n, dtype=np.int64)
    rank[array] = first + 1
    slots = np.arange(len(array))
    while done < depth:
        head = rank[array[slots]]
        tied = np.concatenate([head[1:] == head[:-1], [False]])
        tied[1:] |= tied[:-1].copy()
        slots, head = slots[tied], head[tied]
        if not len(slots):
            break
        members = array[slots]
        beyond = members + done
        tail = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], 0)
        key = head * (len(array) + 2) + tail
        order = np.argsort(key, kind="stable")
        members, key = members[order], key[order]
        array[slots] = members
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[members] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] + 1
        done *= 2
    return array


def _bound(words, array, low, high, offset, wanted, above):
    """Binary search of many ranges at once for the first word not below (or above) the wanted one."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        place = array[middle] + offset
        value = np.where(place < len(words), words[np.minimum(place, len(words) - 1)], 0)
        right = value <= wanted[open_] if above else value < wanted[open_]
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def search(words: np.ndarray, array: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every test suffix: longest match, one place of it, and the range of its window in the array."""
    suffixes = len(block.words)
    longest = np.zeros(suffixes, dtype=np.int64)
    place = np.full(suffixes, -1, dtype=np.int64)
    window_low = np.zeros(suffixes, dtype=np.int64)
    window_high = np.zeros(suffixes, dtype=np.int64)
    live = np.arange(suffixes)
    low, high = np.zeros(suffixes, dtype=np.int64), np.full(suffixes, len(array), dtype=np.int64)
    depth = 0
    while len(live):
        wanted = block.words[live + depth]
        new_low = _bound(words, array, low, high, depth, wanted, False)
        new_high = _bound(words, array, new_low, high, depth, wanted, True)
        depth += 1
        found = new_low < new_high
        live, low, high = live[found], new_low[found], new_high[found]
        longest[live] = depth
        place[live] = array[low]
        whole = block.width[live] == depth
        window_low[live[whole]], window_high[live[whole]] = low[whole], high[whole]
        more = block.left[live] > depth
        live, low, high = live[more], low[more], high[more]
    return longest, place, window_low, window_high


def _shards(texts: list[str | None], vocabulary: dict[bytes, int], most: int) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(first row, words of each row, word numbers with an unknown word after each row)."""
    number = vocabulary.get
    first, counts, words = 0, [], []
    for row, text in enumerate(texts):
        own = [number(w, 0) for w in words_of(text)]
        if words and len(words) + len(own) > most:
            yield first, counts, np.array(words, dtype=np.int64)
            first, counts, words = row, [], []
        counts.append(len(own))
        words += own
        words.append(0)
    if counts:
        yield first, counts, np.array(words, dtype=np.int64)


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each is from."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which], which


def hits_of(texts: list[str | None], block: Block) -> Iterator[tuple[int, int, np.ndarray, list[str]]]:
    """For each text: row, words, mask of hit words, and the items with occurring windows."""
    depth = int(block.left.max(initial=1))
    for first, counts, words in _shards(texts, block.vocabulary, SHARD_WORDS):
        array = suffix_array(words, depth)
        _, _, low, high = search(words, array, block)
        slots, which = _spans(low, high)
        places = array[slots]
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + block.width[which], -1)
        hit = np.cumsum(change)[:-1] > 0
        starts = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)])
        rows = np.searchsorted(starts, places, side="right") - 1
        pairs = np.unique(rows * max(1, len(block.ids)) + block.item[which])
        items: dict[int, list[str]] = {}
        for pair in pairs.tolist():
            items.setdefault(pair // len(block.ids), []).append(block.ids[pair % len(block.ids)])
        for row, n in enumerate(counts):
            yield first + row, n, hit[starts[row] : starts[row] + n], items.get(row, [])


def _blocks(items: DataFrame, item_id: str, item_text: str, window: int) -> list[Block] | Iterator[Block]:
    rows, size = [], 0
    picked = items.select(F.col(item_id).cast("string"), F.col(item_text).cast("string"))
    for key, text in picked.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).toLocalIterator():
        own = len(text.encode("utf-8", "surrogatepass"))
        if rows and size + own > BLOCK_BYTES:
            yield Block.of(rows, window)
            rows, size = [], 0
        rows.append((key, text))
        size += own
    yield Block.of(rows, window)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated`` (each after ``prefix``).

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer; words
    inside any occurrence of one are hit, and a document is contaminated if at least a twentieth
    of its words is hit. Null and word-less documents have no words and are clean; null items and
    items without words have no window. Repeated rows and repeated items are each treated alike;
    an item id counts once, and texts of any length are read whole. An empty benchmark leaves every
    document clean. Columns of ``docs`` that have one of these names give way; use ``prefix`` to keep them.

    One pass over the documents searches ``PASS_BLOCKS`` blocks of the benchmark, which each task
    holds; only a benchmark beyond that takes further passes, each over a written copy.
    """
    names = [prefix + x for x in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {x.lower() for x in names}])
    mask_name, items_name = unused(docs, "mask", "items")
    state = T.StructType([T.StructField(mask_name, T.BinaryType()), T.StructField(items_name, T.ArrayType(T.StringType()))])
    result = T.StructType([
        T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.LongType()),
        T.StructField(names[3], T.StringType()), T.StructField(names[4], T.BooleanType()),
    ])
    width = len(docs.columns)
    at = docs.columns.index(text_col)

    def step(df: DataFrame, shared: list[Broadcast], first: bool, last: bool) -> DataFrame:
        schema = T.StructType(docs.schema.fields + (result.fields if last else state.fields))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).cast(pa.string()).to_pylist()
                masks = [None] * len(texts) if first else batch.column(width).to_pylist()
                known = [[] for _ in texts] if first else batch.column(width + 1).to_pylist()
                hits = [None if m is None else np.unpackbits(np.frombuffer(m, np.uint8)).astype(bool) for m in masks]
                for block in shared:
                    for row, n, hit, found in hits_of(texts, block.value):
                        hits[row] = hit if hits[row] is None else hit | hits[row][:n]
                        known[row] = known[row] + found
                if last:
                    out = [
                        (len(hit), int(hit.sum()), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), 0 < len(hit) <= 20 * int(hit.sum()))
                        for hit, own in ((hit, sorted(set(found))) for hit, found in zip(hits, known))
                    ]
                else:
                    out = [(np.packbits(hit).tobytes(), found) for hit, found in zip(hits, known)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()) if last else (pa.binary(), pa.list_(pa.string()))
                more = [pa.array(list(x), kind) for x, kind in zip(zip(*out) if out else [()] * len(kinds), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], names=schema.names)

        return df.mapInArrow(run, schema)

    df, waiting, first = docs, [], True
    for block in _blocks(items, item_id, item_text, window):
        if len(waiting) == PASS_BLOCKS:
            df, first = cut(step(df, waiting, first, False)), False
            for past in waiting:
                past.destroy()
            waiting = []
        waiting.append(docs.sparkSession.sparkContext.broadcast(block))
    return step(df, waiting, first, True)


def longest_matches(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = 1,
) -> DataFrame:
    """Longest verbatim match of every benchmark suffix, over all shards, and one place of it.

    Returns ``(item_id, item_word, length, doc_id, doc_word)``; suffixes that match fewer than
    ``least`` words have no row. Of equal lengths the smallest document and place are told.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "item_id string, item_word long, length long, doc_id long, doc_word long"
    parts = []
    for block in _blocks(items, item_id, item_text, WINDOW):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            depth = int(block.left.max(initial=1))
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, counts, words in _shards(batch.column(1).to_pylist(), block.vocabulary, SHARD_WORDS):
                    longest, place, _, _ = search(words, suffix_array(words, depth), block)
                    own = np.flatnonzero(longest >= max(1, least))
                    starts = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)])
                    rows = np.searchsorted(starts, place[own], side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block.ids[i] for i in block.item[own].tolist()], pa.string()),
                            pa.array(block.start[own]), pa.array(longest[own]),
                            pa.array([ids[first + r] for r in rows.tolist()], pa.int64()), pa.array(place[own] - starts[rows]),
                        ],
                        names=["item_id", "item_word", "length", "doc_id", "doc_word"],
                    )

        parts.append(picked.mapInArrow(run, schema))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = F.max_by(F.struct("length", "doc_id", "doc_word"), F.struct("length", -F.col("doc_id"), -F.col("doc_word")))
    return every.groupBy("item_id", "item_word").agg(best.alias("best")).select("item_id", "item_word", "best.*")


def decontaminate(docs: DataFrame, items: DataFrame, **kwargs) -> DataFrame:
    """``docs`` without the contaminated documents, with its own columns only, whatever their names."""
    [prefix] = unused(docs, "dc_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    marked = contamination(docs, items, prefix=prefix, **kwargs)
    return marked.where(f"NOT {prefix}contaminated").select(*[F.col(f"`{c}`") for c in docs.columns])
