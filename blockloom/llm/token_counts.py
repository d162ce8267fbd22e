"""Token counts by byte-pair merging, without identifiers.

A piece of text starts as one symbol per byte. A heap holds the rank of every adjacent pair that has
one and a linked list holds the symbols; the lowest pair is popped and merged until no pair has a
rank. The count of a piece is its symbols less its merges, so n symbols take O(n log n) even where
one piece is a whole text.

Null text counts as empty: zero bytes, zero tokens. Rows are counted one by one, so repeated rows,
ties and null ids pass through unchanged; an empty table gives an empty result. Texts are never cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import slices

CACHED_CHARS = 16 << 20  # characters of remembered chunks per task; a full cache is emptied


def load_merges(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Ranks of symbol pairs and the added special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
    return {pair: rank for rank, pair in enumerate(pairs)}, [t["content"] for t in spec["added_tokens"]]


def byte_stand_ins() -> dict[int, str]:
    """The printable character of each byte: its own where it prints, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merged_length(piece: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair has a rank."""
    symbols = list(piece)
    n = len(symbols)
    if n < 2:
        return n
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank_of = ranks.get
    rank_at: list[int | None] = [*map(rank_of, zip(symbols, symbols[1:], strict=False))]
    rank_at.append(None)
    heap = [rank << 32 | at for at, rank in enumerate(rank_at) if rank is not None]
    heapify(heap)
    left = n
    while heap:
        entry = heappop(heap)
        at = entry & 0xFFFFFFFF
        if rank_at[at] != entry >> 32:
            continue  # a neighbour was merged since
        gone = after[at]
        symbols[at] += symbols[gone]
        rank_at[gone] = None
        following = after[at] = after[gone]
        left -= 1
        if following < n:
            before[following] = at
            rank = rank_at[at] = rank_of((symbols[at], symbols[following]))
            if rank is not None:
                heappush(heap, rank << 32 | at)
        else:
            rank_at[at] = None
        previous = before[at]
        if previous >= 0:
            rank = rank_at[previous] = rank_of((symbols[previous], symbols[at]))
            if rank is not None:
                heappush(heap, rank << 32 | previous)
    return left


def counter(ranks: dict[tuple[str, str], int], specials: list[str]) -> Callable[[str], int]:
    """A function from text to its number of tokens; each special string is one token.

    Texts are cut into chunks at single spaces, and counts of chunks and pieces are remembered.
    Chunks of a plain word and its punctuation are cut directly; the library's byte-level splitter
    cuts all others, so both agree on every code point.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    # A single space that follows a non-space always starts a new piece, so texts split there safely.
    doubled = re.compile(r"\s ").search
    split_safely = re.compile(r"(?<=\S) ").split
    cut_specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))).split
    plain_word = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)").fullmatch
    stand_in = byte_stand_ins()
    cut_pieces = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    of_piece: dict[str, int] = {}
    of_chunk: dict[str, int] = {}
    kept_chars = 0

    def plain(text: str) -> int:
        total = 0
        for piece, _ in cut_pieces(text):
            known = of_piece.get(piece)
            if known is None:
                known = of_piece[piece] = merged_length(piece, ranks)
            total += known
        return total

    def whole(text: str) -> int:
        if not specials:
            return plain(text)
        parts = cut_specials(text)
        return sum(map(plain, parts)) + len(parts) - 1

    def word(chunk: str) -> int:
        """Tokens of a space and the chunk."""
        parts = plain_word(chunk)
        if parts is None:
            return whole(" " + chunk)
        head, tail = parts.groups()
        if not head.isascii():
            head = head.encode().decode("latin-1").translate(stand_in)
        piece = stand_in[32] + head
        known = of_piece.get(piece)
        if known is None:
            known = of_piece[piece] = merged_length(piece, ranks)
        return known + (of_piece.get(tail) or plain(tail)) if tail else known

    def chunks(found: list[str]) -> int:
        nonlocal kept_chars
        for chunk in set(found).difference(of_chunk):
            of_chunk[chunk] = word(chunk)
            kept_chars += len(chunk)
        total = sum(map(of_chunk.__getitem__, found))
        if kept_chars > CACHED_CHARS:
            of_piece.clear()
            of_chunk.clear()
            kept_chars = 0
        return total

    def count(text: str) -> int:
        first, *rest = split_safely(text) if doubled(text) else text.split(" ")
        if not first and rest:  # a leading space belongs to what follows
            return chunks(rest)
        return whole(first) + chunks(rest)

    return lambda text: count(text) if text else 0


def token_counts(docs: DataFrame, merges_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of `docs`.

    The merge table is read once by the driver and broadcast: its size is that of a vocabulary,
    whatever the corpus.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_merges(merges_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*shared.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col(id_col), F.col(text_col))
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
