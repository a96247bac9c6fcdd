"""SentencePiece encoding and decoding with a unigram model.

The pieces are read from a model file with their log scores. A file of a unigram
model has them; one of merges has ranks, from which they follow by the law of
Zipf and Mandelbrot (``log_scores``), as no tokenizer is trained here. They form a
double-array trie; encoding finds every piece at every place of a batch of
texts by walking the trie for all places at once, and the best segmentation by
Viterbi, for all segments of the batch at once. A character that is no piece
becomes its bytes. Spaces are written as U+2581 and one is put before the text.

Segments are what no piece can cross: where pieces have the marker only at
their start, a text is cut before each marker that follows another character.
For other models a text is one segment.

As in the format itself, a U+2581 in the text decodes to a space.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm import flat

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_MARK = MARK.encode()

#: Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0
WINDOW = 1024


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    out = []
    for number, value in _fields(data):
        if number == 1:
            own = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own[2])[0], own[3]))
    return out


#: The shift of Mandelbrot's form of Zipf's law: frequencies go as 1 / (rank + SHIFT).
SHIFT = 2.7
UNIGRAM = 1


def model_type(data: bytes) -> int:
    """1 for a unigram model, 2 for merges: field 3 of the trainer's message, which is field 2 of the file."""
    for number, value in _fields(data):
        if number == 2:
            return dict(_fields(value)).get(3, UNIGRAM)
    return UNIGRAM


def log_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Pieces of a model of merges, whose scores are minus their rank, with log probabilities: log of 1 / (rank + SHIFT), less the log of the sum over all pieces.

    They are rounded to multiples of 2^-20, whose sums are exact, so that ties are ties in whatever order a text is summed.
    """
    ranks = {i: -s + SHIFT for i, (_, s, k) in enumerate(pieces) if k in (NORMAL, USER)}
    total = math.log(sum(1 / r for r in ranks.values())) if ranks else 0.0
    return [(p, round((-math.log(ranks[i]) - total) * 2**20) / 2**20 if i in ranks else s, k) for i, (p, s, k) in enumerate(pieces)]


def build_trie(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double-array trie of sorted distinct keys: base, check and the key's place or -1 by node.

    The child of node s by byte b is t = base[s] + b if check[t] == s.
    """
    size = 1 << 12
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    free_from = 1
    todo = [(0, 0, len(keys), 0)]
    while todo:
        node, a, b, depth = todo.pop()
        if a < b and len(keys[a]) == depth:
            value[node] = a
            a += 1
        if a == b:
            continue
        heads, starts = [], []
        for i in range(a, b):
            if not heads or keys[i][depth] != heads[-1]:
                heads.append(keys[i][depth])
                starts.append(i)
        at = np.array(heads)
        # Places are tried WINDOW at a time, from the first window that is not nearly full.
        while size >= free_from + WINDOW and (check[free_from : free_from + WINDOW] >= 0).sum() > WINDOW * 0.95:
            free_from += WINDOW
        place = max(free_from - heads[0], 1)
        while True:
            while place + WINDOW + 256 >= size:
                grow = np.zeros(size, np.int32)
                base, check, value = np.concatenate([base, grow]), np.concatenate([check, grow - 1]), np.concatenate([value, grow - 1])
                size *= 2
            free = np.ones(WINDOW, bool)
            for h in heads:
                free &= check[place + h : place + h + WINDOW] < 0
            if free.any():
                place += int(free.argmax())
                break
            place += WINDOW
        base[node] = place
        check[place + at] = node
        todo += [(place + h, s, e, depth + 1) for h, s, e in zip(heads, starts, [*starts[1:], b], strict=True)]
    return base, check, value


@dataclass
class Encoder:
    base: np.ndarray
    check: np.ndarray
    piece_at: np.ndarray
    scores: np.ndarray
    unknown: int
    unknown_score: float
    byte_ids: np.ndarray
    text: np.ndarray
    text_starts: np.ndarray
    splits: bool

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]]) -> Encoder:
        kinds = np.array([k for _, _, k in pieces])
        usable = [(p.encode(), i) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER) and p]
        usable.sort()
        base, check, value = build_trie([p for p, _ in usable])
        ids = np.array([i for _, i in usable], np.int32)
        at = np.where(value >= 0, ids[np.maximum(value, 0)], -1).astype(np.int32)
        scores = np.array([s for _, s, _ in pieces])
        byte_ids = np.full(256, -1, np.int32)
        plain = []
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                byte_ids[int(p[3:5], 16)] = i
                plain.append(bytes([int(p[3:5], 16)]))
            else:
                plain.append(b"" if k in (CONTROL, UNUSED) else p.encode())
        starts = np.concatenate([[0], np.cumsum([len(p) for p in plain])])
        unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        lowest = scores[kinds == NORMAL].min()
        splits = not any(MARK in p.lstrip(MARK) for p, _ in ((b.decode(), i) for b, i in usable))
        return cls(base, check, at, scores, unknown, float(lowest - UNKNOWN_PENALTY), byte_ids, np.frombuffer(b"".join(plain), np.uint8), starts, splits)

    def _matches(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of every piece in data that starts at a character and crosses no break."""
        whole = np.flatnonzero((data & 0xC0) != 0x80)
        limit = breaks[np.searchsorted(breaks, whole, "right")]
        at, node, start = whole, np.zeros(len(whole), np.int32), whole
        found = []
        while len(at):
            more = at < limit
            at, node, start, limit = at[more], node[more], start[more], limit[more]
            to = self.base[node] + data[at]
            ok = self.check[to] == node
            ok &= to != 0
            at, node, start, limit = at[ok] + 1, to[ok], start[ok], limit[ok]
            piece = self.piece_at[node]
            hit = piece >= 0
            found.append((start[hit], at[hit], piece[hit]))
        # A character without a piece of its own is unknown.
        ends = np.append(whole[1:], len(data))[: len(whole)]
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (whole[:0], whole[:0], whole[:0])
        size = np.zeros(len(data) + 1, np.int64)
        size[whole] = ends - whole
        alone = np.zeros(len(data) + 1, bool)
        alone[start[end - start == size[start]]] = True
        left = whole[~alone[whole]]
        return np.concatenate([start, left]), np.concatenate([end, left + size[left]]), np.concatenate([piece, np.full(len(left), self.unknown)])

    def viterbi(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each segment of data, in order, the start of each piece, and the segments' scores.

        ``starts``: where segments start. Between segmentations of one score, the one whose last
        pieces start first is taken.
        """
        breaks = np.append(starts, len(data))
        start, end, piece = self._matches(data, breaks)
        own = np.searchsorted(breaks, start, "right") - 1
        offset = end - breaks[own]
        order = np.lexsort((start, end, offset))
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        score = np.where(piece == self.unknown, self.unknown_score, self.scores[piece])
        best = np.full(len(data) + 1, -np.inf)
        back = np.full(len(data) + 1, -1, np.int64)
        # best is kept by place; a segment's first place is also the last of the segment before it.
        begin = start == breaks[own[order]]
        edges = np.append(np.flatnonzero(np.diff(offset, prepend=-1)), len(offset))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            value = score[a:b] + np.where(begin[a:b], 0.0, best[start[a:b]])
            heads = np.flatnonzero(np.diff(end[a:b], prepend=-1))
            top = np.maximum.reduceat(value, heads)
            place = end[a:b][heads]
            first = np.flatnonzero(value == np.repeat(top, np.diff(np.append(heads, b - a))))[::-1]
            best[place] = top
            back[end[a:b][first]] = a + first
        ids, places = [], []
        at, begins = breaks[1:].copy(), breaks[:-1]
        live = np.flatnonzero(at > begins)
        while len(live):
            match = back[at[live]]
            ids.append(piece[match])
            places.append(start[match])
            at[live] = start[match]
            live = live[at[live] > begins[live]]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(places, kind="stable")
        return ids[order], places[order], best[breaks[1:]]

    def _by_distinct(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``viterbi``, with the work done once for each distinct segment."""
        sizes = np.diff(np.append(starts, len(data)))
        _, first, which = np.unique(flat.word_hashes(data, starts, starts + sizes), return_index=True, return_inverse=True)
        own = sizes[first]
        own_starts = np.cumsum(own) - own
        distinct = data[np.repeat(starts[first] - own_starts, own) + np.arange(own.sum())]
        same = (own[which] == sizes).all() and (data == distinct[np.repeat(own_starts[which] - starts, sizes) + np.arange(len(data))]).all()
        if not same:  # two segments of one hash
            return self.viterbi(data, starts)
        ids, places, scores = self.viterbi(distinct, own_starts)
        edges = np.append(np.searchsorted(places, own_starts), len(places))
        counts = np.diff(edges)[which]
        total = np.cumsum(counts)
        at = np.repeat(edges[:-1][which] - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)
        return ids[at], places[at] + np.repeat(starts - own_starts[which], counts), scores[which]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's ids start (one more entry: the end), and each text's score."""
        all_ids, counts, totals = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in flat.pieces(column, 1 << 20):
            texts = pc.fill_null(column.slice(a, b - a).cast(pa.large_string()), "")
            marked = pc.replace_substring(texts, " ", MARK)
            lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), pa.scalar(MARK, pa.large_string()))
            joined = pc.binary_join_element_wise(lead, marked, pa.scalar("", pa.large_string()))
            offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
            raw = joined.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
            cut = np.zeros(len(data) + 1, bool)
            cut[offsets[:-1]] = True
            if self.splits and len(data) > 2:
                mark = np.zeros(len(data) + 1, bool)
                mark[: len(data) - 2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
                after = np.zeros(len(data) + 4, bool)
                after[np.flatnonzero(mark) + 3] = True
                cut |= mark & ~after[: len(data) + 1]
            starts = np.flatnonzero(cut[: len(data)])
            ids, places, scores = self._by_distinct(data, starts)
            # Unknown characters become their bytes.
            fall = np.flatnonzero(ids == self.unknown)
            if len(fall):
                ends = np.append(places[1:], len(data))
                sizes = np.ones(len(ids), np.int64)
                sizes[fall] = ends[fall] - places[fall]
                new = np.repeat(ids, sizes)
                inside = np.repeat(np.cumsum(sizes) - sizes, sizes)
                step = np.arange(len(new)) - inside
                where = np.repeat(places, sizes) + step
                lost = new == self.unknown
                new[lost] = self.byte_ids[data[where[lost]]]
                ids, places = new, where
            edge = np.searchsorted(places, offsets)
            counts.append(np.diff(edge))
            all_ids.append(ids.astype(np.int32))
            totals.append(np.bincount(np.searchsorted(offsets, starts, "right") - 1, scores, b - a) if len(starts) else np.zeros(b - a))
        counts = np.concatenate(counts)
        return np.concatenate(all_ids), np.concatenate([[0], np.cumsum(counts)]), np.concatenate(totals)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids: pieces and bytes in order, markers as spaces, without the first one."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        sizes = self.text_starts[ids + 1] - self.text_starts[ids]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        plain = self.text[np.repeat(self.text_starts[ids], sizes) + inside].tobytes()
        return plain.replace(_MARK, b" ").removeprefix(b" ")


def load_encoder(path: str = DEFAULT_MODEL) -> Encoder:
    with open(path, "rb") as f:
        data = f.read()
    pieces = read_model(data)
    return Encoder.of(pieces if model_type(data) == UNIGRAM else log_scores(pieces))


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids, n_pieces, n_bytes (of them, bytes), log_score and round_trip of every row.

    The model file is read on the driver; tasks get its trie. Map-only. A null
    or empty text has no ids and score 0. round_trip: the ids decode to the
    text, bytes and all; false only for texts with a U+2581. Repeated rows each
    give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_encoder(model))
    schema = docs.select(*keep).schema
    for name, kind in (("ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("n_bytes", T.LongType()), ("log_score", T.DoubleType()), ("round_trip", T.BooleanType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        is_byte = np.zeros(len(encoder.scores), bool)
        is_byte[encoder.byte_ids[encoder.byte_ids >= 0]] = True
        for whole in batches:
            for a, b in flat.pieces(whole.column(whole.num_columns - 1), 2 << 20):
                x = whole.slice(a, b - a)
                texts = x.column(x.num_columns - 1)
                ids, edges, scores = encoder.encode(texts)
                sums = np.concatenate([[0], np.cumsum(is_byte[ids])])
                same = [encoder.decode(ids[i:j]) == (t.as_py() or "").encode() for i, j, t in zip(edges[:-1], edges[1:], texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], lists, pa.array(np.diff(edges)), pa.array(sums[edges[1:]] - sums[edges[:-1]]), pa.array(scores), pa.array(same, pa.bool_())], names=schema.names)
            flat.release()

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids") -> DataFrame:
    """All columns of ``rows`` and decoded, the text of the column ``ids``, in place of a column of that name.

    Pieces and bytes in order, markers as spaces, without the first one. Map-only.
    Null ids give null; ids that the model lacks, and bytes that are no UTF-8, give null too.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load_encoder(model))
    kept = rows.drop("decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])

    def text(encoder: Encoder, own: list[int] | None) -> str | None:
        if own is None or any(i is None or not 0 <= i < len(encoder.scores) for i in own):
            return None
        try:
            return encoder.decode(np.array(own, np.int64)).decode()
        except UnicodeDecodeError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            column = x.column(x.schema.get_field_index(ids))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([text(shared.value, own) for own in column.to_pylist()], pa.string())], names=schema.names)
            flat.release()

    return kept.mapInArrow(run, schema)
