"""Cost-balanced packing of tokenized documents into sequences of fixed capacity."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .scratch import only

#: Tokens and documents packed together at most (one longer document stands alone).
GROUP_TOKENS, GROUP_DOCS = 4_000_000, 8_192
#: Characters of a text that is split in Python: the encoder's own splitter overflows on a million white-space characters.
LONG_TEXT = 500_000


Vocabulary = tuple[str, str, tuple[tuple[str, int], ...]]


def default_vocabulary() -> Vocabulary:
    """Path of the rank file of the 50k byte-level vocabulary, its split pattern, and its added tokens with their ids.

    The ranks are the ids of byte_bpe_50k.json and the added tokens are those
    that file lists: where a text holds the string of one, it is that one id,
    as the file's own tokenizer has it. Encoding by ranks gives the same ids
    about four times as fast (tests compare the two).
    """
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added


class Encoder:
    """Text to ids, by ranks and added tokens."""

    def __init__(self, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...]):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = pattern
        self.added = dict(added)
        self.between = regex.compile("|".join(regex.escape(t) for t in self.added)) if added else None

    def encode(self, text: str) -> list[int]:
        """The ids of a text of any length, in time that grows with it; what lies between added tokens is split by itself."""
        if self.between is None or not any(token in text for token in self.added):
            return self._plain(text)
        ids, at = [], 0
        for found in self.between.finditer(text):
            ids += self._plain(text[at : found.start()])
            ids.append(self.added[found[0]])
            at = found.end()
        return ids + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        if len(text) < LONG_TEXT:
            return self.ranks.encode_ordinary(text)
        pieces = (m[0].encode() for m in regex.finditer(self.pattern, text))
        return [i for piece in pieces for i in self.ranks._encode_single_piece(piece)]


_encoders: dict[Vocabulary, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The encoder of a vocabulary, loaded once in each Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(*vocabulary)
    return _encoders[vocabulary]


def capacities(tokens: int, capacity: int) -> list[int]:
    """Lengths of sequences that hold exactly `tokens`: full ones, then powers of two for the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    lengths: list[int], capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048
) -> list[tuple[int, int, int, int, int]]:
    """Assign documents to sequences: pieces (document, start, length, sequence, offset).

    A document costs linear * length + quadratic * length**2, as attention
    within it does. Documents longer than the capacity are cut into full
    sequences and a remainder. Remainders go, the most costly first, to the
    sequence of least cost with room for them; where none has room, the piece
    that the emptiest sequence has room for goes there and the rest queues
    again. The sequences hold all tokens exactly, so none is padded.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    queue: list[tuple[int, int, int]] = []
    sequence = 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            queue.append((-(n % capacity), doc, whole * capacity))
    size = np.array(capacities(-sum(q[0] for q in queue), capacity), np.int64)
    room, cost = size.copy(), np.zeros(len(size))
    heapq.heapify(queue)
    while queue:
        left, doc, start = heapq.heappop(queue)
        n = -left
        fits = room >= n
        if fits.any():
            to = int(np.argmin(np.where(fits, cost, np.inf)))
            taken = n
        else:
            to = int(np.argmax(room))
            taken = int(room[to])
            heapq.heappush(queue, (taken - n, doc, start + taken))
        pieces.append((doc, start, taken, sequence + to, int(size[to] - room[to])))
        room[to] -= taken
        cost[to] += linear * taken + quadratic * taken * taken
    return pieces


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    vocabulary: Vocabulary | None = None,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    with_ids: bool = False,
) -> DataFrame:
    """Tokenize every document and pack all tokens into sequences of at most `capacity`.

    Each task packs what it reads, in groups of bounded size, so nothing is
    shuffled and a lost task packs the same rows again. A document's ids are
    its text's and then `end_id`. Returns one row for each piece: doc_id, start
    (ids of the document before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (place in
    the sequence; the pieces of a sequence leave no gap) and, if wanted, ids.
    Sequences are full but for a few of each group that have a power of two as
    their length, so none is padded.

    Null and empty text: `end_id` alone. Null or repeated ids: each row is a
    document of its own. Documents of one cost are taken in the order of their
    rows. A very long text is encoded whole and closes its group, which then
    holds it and what was read before it. Empty table: no rows. Extra columns
    are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()

    def group_out(group: list[tuple[object, np.ndarray]], first: int, kind: pa.DataType) -> tuple[pa.RecordBatch, int]:
        pieces = pack([len(ids) for _, ids in group], capacity, linear, quadratic)
        docs_, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        parts = [group[d][1][s : s + n] for d, s, n in zip(docs_, start, length, strict=True)]
        columns = [
            pa.array([group[d][0] for d in docs_], kind),
            pa.array(start),
            pa.array(length),
            pa.array(np.array([zlib.crc32(p.tobytes()) for p in parts], np.int64)),
            pa.array(np.array([len(group[d][1]) for d in docs_], np.int64)),
            pa.array(sequence + first),
            pa.array(offset),
        ]
        if with_ids:
            at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names), int(sequence.max()) + 1

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        first = TaskContext.get().partitionId() << 32
        group: list[tuple[object, np.ndarray]] = []
        held = 0
        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "")
                ids.append(end_id)
                group.append((key.as_py(), np.array(ids, "<u4")))
                held += len(ids)
                if held >= GROUP_TOKENS or len(group) >= GROUP_DOCS:
                    out, used = group_out(group, first, kind)
                    yield out
                    first, group, held = first + used, [], 0
        if group:
            yield group_out(group, first, kind)[0]

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids array<int>" * with_ids
    )
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)
