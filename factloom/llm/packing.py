"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing: each partition packs its pieces best-fit in
decreasing order; bins that are nearly full are final, the others travel up a
tree, as items, and meet those of ``FAN_IN`` partitions in the next best-fit
round, until one node is left.  Each level is written in the shared folder, so a
lost executor repeats one level at most and the ids that were given stay.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, ranges, slices, small_batches, text_bytes, union

FAN_IN = 8
#: Words that a worker remembers before it starts afresh.
WORDS = 100_000
#: Bytes of text that are tokenised at once.
CHUNK = 500_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long, load int, open boolean, node long"


#: Byte-level vocabularies write each byte as a sign of its own: the printable ones as they are, the others from U+0100 on.
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class WordTokenizer:
    """Ids of whole texts from a word-level tokenizer, each distinct word encoded once.

    Words never cross white space in this vocabulary's pre-tokenizer, so a text's
    ids are those of its chunks between ASCII white space in a row; whatever else
    counts as white space stays inside a chunk, for the tokenizer to see.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.lengths, self.starts, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def learn(self, words: list[str]) -> None:
        """A word of lower-case letters goes to the vocabulary's model as it is; all else through the whole tokenizer."""
        model, got = self.tokenizer.model, []
        for w in words:
            if w.isalpha() and (w.isascii() or unicodedata.is_normalized("NFC", w)) and w == w.lower():
                if not w.isascii():
                    w = w.encode().decode("latin-1").translate(BYTE_SIGNS)
                got.append([t.id for t in model.tokenize(w)])
            else:
                got.append(self.tokenizer.encode(w, add_special_tokens=False).ids)
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(size) - size])
        self.lengths = np.concatenate([self.lengths, size])
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end."""
        if len(self.index) > WORDS:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # nothing may come or go of a special token
            # A letter and the signs after it are different words already; apart, they are seen more often.
            texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,!|&*%$#?;:]+)", r"\1 \2")
            texts = pc.ascii_lower(texts)  # of a slice it would be wrong; the line above has copied it
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = self.index
        new = [w for w in words if w not in index]
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.learn(new)
        known = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        code = known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        lengths = self.lengths[code]
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        return self.flat[ranges(self.starts[code], lengths)], np.concatenate([[0], np.cumsum(lengths)])[bounds]


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """A row for each piece of each document: its ids and ``end_id``, cut only where longer than ``capacity``.

    A null text counts as empty, so it gives one piece of length 1.
    """
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        tokenizer = _tokenizers[tokenizer_path]
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_bytes(texts)
            for a, b in slices(offsets, CHUNK):
                ids, bounds = tokenizer.encode(texts[a:b])
                owner, start, length, crc = [], [], [], []
                for k in range(b - a):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), capacity):
                        part = own[at : at + capacity]
                        owner.append(a + k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part))
                at = np.array(start, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array((at // capacity).astype(np.int32)), pa.array(at), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def best_fit(loads: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, by best fit in decreasing order of load."""
    out = np.zeros(len(loads), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i in np.argsort(-loads, kind="stable").tolist():
        size = int(loads[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        out[i] = b
        if room > size:
            free[room - size].append(b)
            mask |= 1 << (room - size)
    return out


def _pack_node(rows: dict[str, np.ndarray], capacity: int, level: int, last: bool, first_id: int) -> tuple[dict[str, np.ndarray], int]:
    """One best-fit round over the bins of one node: pieces with their new bin, offset and whether that bin stays open."""
    bins, at, load = np.unique(rows["sequence_id"], return_inverse=True, return_index=False), None, None
    bins, inverse = bins
    load = np.bincount(inverse, rows["length"], len(bins)).astype(np.int64)
    into = best_fit(load, capacity)
    total = np.bincount(into, load).astype(np.int64)
    # Offsets: the bins that make a new one follow each other.
    order = np.lexsort((np.arange(len(bins)), into))
    before = np.cumsum(load[order]) - load[order]
    begin = np.zeros(len(total), np.int64)
    seen, first = np.unique(into[order], return_index=True)
    begin[seen] = before[first]
    shift = np.zeros(len(bins), np.int64)
    shift[order] = before - begin[into[order]]
    if last:
        is_open = np.zeros(len(total), bool)
    elif level < 2:
        is_open = total < capacity - (capacity >> (6 - 2 * level))
    else:
        # After a best-fit round one bin at most is half empty; it travels on with the emptiest others as hosts.
        is_open = np.zeros(len(total), bool)
        is_open[np.argsort(total, kind="stable")[: FAN_IN + 1]] = True
        is_open &= total < capacity - (capacity >> 4)
    b = into[inverse]
    return rows | {"sequence_id": first_id + b, "offset": rows["offset"] + shift[inverse], "load": total[b], "open": is_open[b]}, len(total)


def _round(df: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    names = [x.split()[0] for x in PLACED.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        here = TaskContext.get().partitionId()
        doc = whole.column("doc_id").combine_chunks()
        rows = {c: whole.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "start", "length", "ids_crc32")}
        rows["row"] = np.arange(whole.num_rows)
        if level:
            rows |= {c: whole.column(c).to_numpy(zero_copy_only=False) for c in ("sequence_id", "offset", "node")}
        else:
            rows |= {"sequence_id": rows["row"], "offset": np.zeros(whole.num_rows, np.int64), "node": np.full(whole.num_rows, here, np.int64)}
        next_id = (level << 56) | (here << 32)
        for node in np.unique(rows["node"]):
            part = {c: v[rows["node"] == node] for c, v in rows.items()}
            placed, made = _pack_node(part, capacity, level, last, next_id)
            next_id += made
            placed["node"] = placed["node"] // FAN_IN
            kinds = {"piece": pa.int32(), "load": pa.int32(), "open": pa.bool_()}
            cols = [doc.take(pa.array(placed["row"])) if c == "doc_id" else pa.array(placed[c]).cast(kinds.get(c, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, PLACED)


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """``items`` (the columns of :func:`pieces`) with ``sequence_id`` and ``offset``; every sequence is gapless from 0."""
    levels = [materialise(_round(items, capacity, 0, False), "pack-0")]
    while True:
        is_open = levels[-1].where("open")
        nodes = is_open.agg(F.max("node"), F.countDistinct("node")).first()
        if nodes[1] == 0:
            break
        last = nodes[0] == 0
        spread = is_open.repartition(int(nodes[1]), "node")
        levels.append(materialise(_round(spread, capacity, len(levels), last), f"pack-{len(levels)}"))
        if last:
            break
    placed = union([x.where("not open") for x in levels])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise and pack ``docs`` (``doc_id, text``); other columns are ignored.  An empty table gives no rows."""
    return pack(materialise(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
