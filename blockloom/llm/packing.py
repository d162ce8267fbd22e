"""Best-fit packing of tokenised documents by hierarchical residuals.

Every task tokenises its texts and packs its pieces best-fit, largest first. Bins that are full but
for a few tokens are final; the others become items of the next round, where they are dealt to fewer
tasks and packed again, and so on up the tree. A task of any round holds a bounded number of bins, so
the tree narrows only as fast as bins fill up; it ends with one task, or when a round merges next to
nothing (what is left then are bins over half full, which no two of them can share). Every round is
written to the shared folder, so bins never change when a task is run again.

A bin is one row that carries its pieces: at most one per token of its capacity. Texts never move.

Null text counts as empty: a document of the end token alone. Repeated rows are packed as often as
they occur. Only documents over the capacity are cut; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import quoted, slices
from blockloom.session import written

CAPACITY = 2048
END = 0  # the id after every document
NEARLY_FULL = 8  # tokens of room at most
ITEMS_PER_TASK = 50_000
LEAST_GAIN = 0.001  # a round that saves a smaller share of its bins is the last
MEMBER = ["doc_id", "piece", "start", "length", "ids_crc32", "offset"]
CACHED_CHARS = 2 << 20  # characters of chunks, and of their parts, learnt per Python worker before older ones are forgotten


def encoder(spec: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian 32-bit bytes, by the tokenizers library.

    Where a vocabulary ignores case, marks the ends of words and drops white space between them, the ids of a text
    are those of its chunks between white space: every different word is encoded once, many in one call, and
    the word ends tell their ids apart. With any other vocabulary texts are encoded whole.
    """
    import numpy as np
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    tokenizer = Tokenizer.from_str(spec)
    parts = json.loads(spec)
    suffix = parts["model"].get("end_of_word_suffix")
    if not suffix or "Lowercase" not in json.dumps(parts.get("normalizer")):

        def whole(text: str) -> bytes:
            return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

        return lambda texts: [whole(text) for text in texts]
    ends_word = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    ends_word[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    # Python also splits at these four separators, the library does not: such texts are encoded whole.
    odd = re.compile(r"[\x1c-\x1f]").search
    # The vocabulary ignores case and cuts letters from punctuation, so these share the ids of their parts.
    plain_word = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)").fullmatch
    ids: dict[str, bytes] = {}  # of chunks, and of parts: a part alone is a chunk with the same ids
    older: dict[str, bytes] = {}  # of those learnt before; what is met again moves over, the rest is forgotten
    kept_chars = 0

    def ids_of(text: str) -> bytes:
        # A batch of one goes the way that tracks no offsets.
        found = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, "<u4").tobytes()

    def learn(parts: list[str]) -> None:
        for start in range(0, len(parts), 500):
            some = parts[start : start + 500]
            raw = ids_of(" ".join(some))
            ends = (np.flatnonzero(ends_word[np.frombuffer(raw, "<u4")]) * 4 + 4).tolist()
            if len(ends) == len(some):
                ids.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:
                ids.update((part, ids_of(part)) for part in some)

    def unknown(words: set[str]) -> set[str]:
        """Those that were never met or are forgotten."""
        nonlocal kept_chars
        words = words.difference(ids)
        kept_chars += sum(map(len, words))
        met = [word for word in words if word in older]
        ids.update(zip(met, map(older.__getitem__, met), strict=True))
        return words.difference(met)

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal ids, older, kept_chars
        found = [None if odd(text) else text.split() for text in texts]
        split = {}
        for chunk in unknown(set().union(*(chunks for chunks in found if chunks))):
            match = plain_word(chunk)
            if match:
                split[chunk] = (match[1].lower(), match[2])
            else:
                ids[chunk] = ids_of(chunk)
        learn(list(unknown({part for pair in split.values() for part in pair if part})))
        for chunk, (head, tail) in split.items():
            ids[chunk] = ids[head] + ids[tail] if tail else ids[head]
        out = [
            ids_of(text) if chunks is None else b"".join(map(ids.__getitem__, chunks))
            for text, chunks in zip(texts, found, strict=True)
        ]
        if kept_chars > CACHED_CHARS:
            ids, older, kept_chars = {}, ids, 0
        return out

    return encode


def shared_encoder(held: dict) -> Callable[[list[str]], list[bytes]]:
    """The encoder of a broadcast {"spec": tokenizer file}: each Python worker builds it once and keeps its words."""
    if "encode" not in held:
        held["encode"] = encoder(held["spec"])
    return held["encode"]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest item first, each into the fullest bin with room for it."""
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some bin has room r
    bins = []
    for item in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, []
            bins.append(chosen)
        chosen.append(item)
        room -= size
        if room:
            by_room[room].append(chosen)
            rooms |= 1 << room
    return bins


def _packed(members: pa.ListArray, capacity: int) -> pa.RecordBatch:
    """Bins made of the given ones: (used, members with their new offsets)."""
    import numpy as np

    starts = members.offsets.to_numpy().astype(np.int64)
    lengths = members.values.field("length").to_numpy()
    total = np.concatenate([[0], np.cumsum(lengths)])
    used = total[starts[1:]] - total[starts[:-1]]
    bins = best_fit(used.tolist(), capacity)
    order = np.fromiter((i for b in bins for i in b), np.int64, len(used))
    moved = members.take(pa.array(order))
    counts = np.diff(starts)[order]
    per_bin = np.add.reduceat(counts, np.cumsum([0, *map(len, bins[:-1])])) if len(bins) else np.zeros(0, np.int64)
    edges = np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int64)
    flat = moved.flatten()
    lengths = flat.field("length").to_numpy()
    running = np.concatenate([[0], np.cumsum(lengths)])
    offsets = running[:-1] - np.repeat(running[edges[:-1]], per_bin)
    fields = [flat.type.field(i) for i in range(flat.type.num_fields)]
    columns = [pa.array(offsets, pa.int64()) if f.name == "offset" else flat.field(f.name) for f in fields]
    values = pa.StructArray.from_arrays(columns, fields=fields)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(running[edges[1:]] - running[edges[:-1]], pa.int64()),
            pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values),
        ],
        names=["used", "members"],
    )


def _in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from slices(iter([batch]), 5000)


def local_bins(docs: DataFrame, spec: str, capacity: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """Bins of the pieces of `docs`, packed within each task: (used, members)."""
    narrow = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast({"spec": spec})  # a vocabulary, whatever the corpus
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared_encoder(shared.value)
        last = end.to_bytes(4, "little")
        step = 4 * capacity
        pieces: list[tuple] = []
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not pieces:
                return
            types = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(v, t) for v, t in zip(zip(*pieces, strict=True), types, strict=True)]
            values = pa.StructArray.from_arrays(columns, names=MEMBER)
            single = pa.ListArray.from_arrays(pa.array(range(len(pieces) + 1), pa.int32()), values)
            pieces.clear()
            yield from _in_slices(_packed(single, capacity))

        for batch in slices(batches, 200):
            id_type = batch.column(0).type
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += last
                for number, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    pieces.append((doc_id, number, at // 4, len(part) // 4, zlib.crc32(part), 0))
            if len(pieces) >= ITEMS_PER_TASK:
                yield from flush()
        yield from flush()

    fields = "piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint"
    return narrow.mapInArrow(run, f"used long, members array<struct<doc_id: {kind}, {fields}>>")


def merged_bins(bins: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """Underfull bins dealt over `tasks` tasks and packed again as items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [batch.column(1) for batch in batches if batch.num_rows]
        if got:
            yield from _in_slices(_packed(pa.concat_arrays(got), capacity))

    return bins.repartition(tasks).mapInArrow(run, bins.schema)


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of `docs`."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    level = written(local_bins(docs, spec, capacity, end, id_col, text_col), "bins")
    final = []
    underfull = F.col("used") < capacity - NEARLY_FULL
    before = None
    while True:
        open_bins = level.filter(underfull)
        bins, members = open_bins.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        tasks = max(-(-bins // ITEMS_PER_TASK), -(-members // (20 * ITEMS_PER_TASK)), 1)
        if bins < 2 or before is not None and (before[1] == 1 or bins > before[0] * (1 - LEAST_GAIN)):
            final.append(level)
            break
        final.append(level.filter(~underfull))
        level = written(merged_bins(open_bins, capacity, tasks), "bins")
        before = bins, tasks
    packed = final[0]
    for more in final[1:]:
        packed = packed.unionByName(more)
    # One row per bin, read from the shared folder: the numbers only have to differ.
    numbered = packed.withColumn("sequence_id", F.monotonically_increasing_id())
    numbered = numbered.select("sequence_id", F.explode("members").alias("m"))
    return numbered.select(*[F.col(f"m.{c}") for c in MEMBER[:-1]], "sequence_id", "m.offset")
