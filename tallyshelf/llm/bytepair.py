"""Byte-level BPE as a monoid: halves are encoded alone and joined at the seam, decoding concatenates up the tree.

The token sequences of byte strings form a monoid under ``join``. The encoding of ``a + b`` differs from those of ``a`` and ``b``
only near the seam; a window of tokens around the seam is encoded anew and grows until the tokens outside are
proved stable: a sequence is the encoding of its bytes exactly when every adjacent pair of its tokens encodes to
itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Byte strings up to this length are merged directly.
LEAF_BYTES = 4
# Longer ones are merged with a heap, in time in proportion to their length (but for its logarithm).
SHORT_BYTES = 256
# Seams of more tokens are not remembered, so that what a worker holds stays small.
SEAM_TOKENS = 32
# Above every rank.
NO_RANK = 1 << 60
# Distinct pieces, leaves and seams that a worker remembers; forgotten ones only cost time.
REMEMBERED = 300_000


class BytePairs:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.stable = lru_cache(REMEMBERED // 3)(lambda a, b: self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b])
        self.leaf = lru_cache(REMEMBERED // 3)(self._merge)
        self.short_seam = lru_cache(REMEMBERED // 3)(lambda *ids: self._merge(b"".join(map(self.bytes_of.__getitem__, ids))))
        self.known = _Known(self)

    def _merge(self, piece: bytes) -> list[int]:
        """The rule itself: the adjacent pair of lowest rank is joined, leftmost first, until none is left."""
        if len(piece) > SHORT_BYTES:
            return self._merge_long(piece)
        get = self.ranks.get
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [get(piece[k : k + 2], NO_RANK) for k in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == NO_RANK:
                break
            at = pairs.index(best)
            del pairs[at]
            parts[at] += parts.pop(at + 1)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NO_RANK)
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same rule with a heap of the pairs by rank and place; entries whose pair has changed since are passed over."""
        get = self.ranks.get
        size = len(piece)
        ends = list(range(1, size + 1))  # of the part that begins at a place
        before = list(range(-1, size - 1))  # where the part before it begins
        rank = [get(piece[k : k + 2], NO_RANK) for k in range(size - 1)] + [NO_RANK]  # of the pair that begins there
        heap = [(r, k) for k, r in enumerate(rank) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            best, at = heapq.heappop(heap)
            if rank[at] != best:
                continue
            other = ends[at]
            rank[other] = NO_RANK
            ends[at] = end = ends[other]
            if end < size:
                before[end] = at
                rank[at] = get(piece[at : ends[end]], NO_RANK)
                if rank[at] != NO_RANK:
                    heapq.heappush(heap, (rank[at], at))
            else:
                rank[at] = NO_RANK
            left = before[at]
            if left >= 0:
                rank[left] = get(piece[left:end], NO_RANK)
                if rank[left] != NO_RANK:
                    heapq.heappush(heap, (rank[left], left))
        ids, at = [], 0
        while at < size:
            ids.append(self.ranks[piece[at : ends[at]]])
            at = ends[at]
        return ids

    def seam(self, ids: list[int]) -> list[int]:
        """The encoding of the bytes of a window of tokens."""
        if len(ids) <= SEAM_TOKENS:
            return self.short_seam(*ids)
        return self._merge(b"".join(map(self.bytes_of.__getitem__, ids)))

    def encode_piece(self, piece: bytes, done: dict[bytes, list[int]] | None = None) -> list[int]:
        """Token ids of one byte string, by halves; ``done`` holds the halves met in it, of which a run has few."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) <= LEAF_BYTES:
            return self.leaf(piece)
        done = {} if done is None else done
        if piece not in done:
            half = len(piece) // 2
            done[piece] = self.join(self.encode_piece(piece[:half], done), self.encode_piece(piece[half:], done))
        return done[piece]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of ``left`` and then ``right``, two encodings; a side that does not stand has its window doubled."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        before, after = 1, 1
        while True:
            window = self.seam(left[-before:] + right[:after])
            left_stands = before == len(left) or self.stable(left[-before - 1], window[0])
            right_stands = after == len(right) or self.stable(window[-1], right[after])
            if left_stands and right_stands:
                return left[:-before] + window + right[after:]
            before = before if left_stands else min(2 * before, len(left))
            after = after if right_stands else min(2 * after, len(right))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; the pattern's matches are encoded apart."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a token sequence, concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Known(dict):
    """Encodings of pieces met before."""

    def __init__(self, pairs: BytePairs) -> None:
        super().__init__()
        self.pairs = pairs

    def __missing__(self, piece: str) -> bytes:
        ids = self.pairs.encode_piece(piece.encode())
        self[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


@cache
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """The encoder for a file of ranks (a token in base 64 and its rank per line), once per worker."""
    with open(path, "rb") as lines:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs (doc_id, text)``.

    Digests of the ids (little-endian unsigned 32-bit) and of the bytes they decode to. Null counts as the empty text, which
    has no token; any doc_id may be null or repeated; an empty table gives an empty one. Very long texts and runs of one character are encoded
    whole. Other columns are not read.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            n, ids_digest, bytes_digest = [], [], []
            for text in batch.column(1):
                packed = pairs.encode(text.as_py() or "")
                n.append(len(packed) // 4)
                ids_digest.append(hashlib.sha256(packed).hexdigest())
                decoded = pairs.decode(np.frombuffer(packed, "<u4").tolist())
                bytes_digest.append(hashlib.sha256(decoded).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(bytes_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(per_batch, fields)
