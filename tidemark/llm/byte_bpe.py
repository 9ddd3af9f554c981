"""Byte-level BPE by a monoid tree: halves are encoded and joined, decoding concatenates.

The element of the monoid is the token list of a byte string. Its unit is the empty list; the product
re-encodes a window around the seam and widens it until the tokens next to the window are settled: a
token list is the encoding of its bytes exactly if each neighbouring pair is the encoding of the
pair's bytes, so a seam whose pairs all pass can't change any token outside.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidemark.llm.common import fields, slices

#: Bytes up to which a piece is merged directly.
LEAF_BYTES = 24
#: Tokens on each side of a seam in the first window.
SEAM_TOKENS = 2
#: Distinct words a task remembers: those of late, and of the ones before them those that were met again. As many
#: pieces of words are remembered beside them.
MEMORY_WORDS = 400_000
#: Above all ranks: a pair that is no token.
NEVER = 1 << 60
#: Unicode white space, as the splitting pattern's \\s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.fine = regex.compile(pattern)
        # A word with the space before it, or white space: no match of the pattern crosses these.
        self.coarse = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.settled = lru_cache(maxsize=50_000)(self._settled)

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a byte string: the lowest rank merges first, the leftmost of equals."""
        if len(piece) > 8 * LEAF_BYTES:
            return self._merge_long(piece)
        if len(piece) < 2:
            return [self.ranks[piece]] if piece else []
        ends = list(range(1, len(piece) + 1))
        rank = self.ranks.get
        pairs = [rank(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            del pairs[i], ends[i]
            start = ends[i - 1] if i else 0
            if i:
                pairs[i - 1] = rank(piece[ends[i - 2] if i > 1 else 0 : ends[i]], NEVER)
            if i < len(pairs):
                pairs[i] = rank(piece[start : ends[i + 1]], NEVER)
        return [self.ranks[piece[a:b]] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs over linked parts, for windows that had to grow."""
        n, rank = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # part i is piece[i:end[i]] while alive
        before = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= stop or end[middle] != stop:
                continue
            alive[middle] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := rank(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _settled(self, left: int, right: int) -> bool:
        return self.merge(self.vocabulary[left] + self.vocabulary[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product of two encodings."""
        if not left or not right:
            return left or right
        width = SEAM_TOKENS
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            seam = b"".join(map(self.vocabulary.__getitem__, left[i:] + right[:j]))
            whole = i == 0 and j == len(right)
            middle = self.merge(seam)
            if whole or (
                (i == 0 or self.settled(left[i - 1], middle[0])) and (j == len(right) or self.settled(middle[-1], right[j]))
            ):
                return left[:i] + middle + right[j:]
            width *= 2

    def tree(self, piece: bytes) -> list[int]:
        """Tokens of a piece: its halves' tokens, joined."""
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def piece(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern; a match that is in the vocabulary is its own token."""
        own = self.ranks.get(piece)
        return self.tree(piece) if own is None else [own]

    def _word(self, word: str) -> bytes:
        out, known = [], self.pieces
        if len(known) > MEMORY_WORDS:
            known.clear()
        for match in self.fine.findall(word):
            ids = known.get(match)
            if ids is None:
                ids = known[match] = b"".join([i.to_bytes(4, "little") for i in self.piece(match.encode())])
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The text's tokens as little-endian unsigned 32-bit integers."""
        if len(self.words) > MEMORY_WORDS // 2:
            self.words, self.before = {}, self.words
        words, known, before = self.coarse.findall(text), self.words, self.before
        for word in set(words).difference(known):
            ids = before.get(word)
            known[word] = self._word(word) if ids is None else ids
        return b"".join(map(known.__getitem__, words))

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed tokens: concatenation is associative, so any tree gives the same."""
        ids = memoryview(packed).cast("I").tolist() if packed else []
        return b"".join(map(self.vocabulary.__getitem__, ids))


def load(rank_path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file (lines of base64 bytes and a rank)."""
    with open(rank_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return ByteBpe(ranks, pattern)


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """The table with ``ids`` (packed little-endian unsigned 32-bit tokens) and ``n_tokens`` added.

    Whole texts, each match of the pattern by itself, without special tokens. A null or empty text has no
    tokens. Columns of these names that the table has are replaced; all others, repeated rows and the
    order of partitions stay. An empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in (ids, n_tokens)]
    rest = docs.select(*[docs[c] for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_path, pattern)
        for batch in slices(batches):
            packed = [bpe.encode(t) if t else b"" for t in batch.column(text).to_pylist()]
            columns = [batch.column(c) for c in kept] + [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, n_tokens])

    out = StructType([*rest.schema.fields, StructField(ids, BinaryType()), StructField(n_tokens, LongType())])
    return rest.mapInArrow(run, out)


def decode_ids(table: DataFrame, rank_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The table with ``decoded``, the bytes of the packed tokens in ``ids``, added; null reads as no tokens."""
    kept = [c for c in table.columns if c != decoded]
    rest = table.select(*[table[c] for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_path, pattern)
        for batch in slices(batches):
            values = [bpe.decode(p or b"") for p in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(values, pa.binary())], names=[*kept, decoded])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(decoded, BinaryType())]))


def token_digests(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the packed tokens and of the bytes they decode to, of every row.

    A null or empty text has no tokens and decodes to nothing; repeated rows stay; an empty table gives none; other
    columns are not read.
    """
    rows = fields(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_path, pattern)
        for batch in slices(batches):
            packed = [bpe.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            columns = [pa.array([len(p) // 4 for p in packed], pa.int64())]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in values]) for values in (packed, map(bpe.decode, packed))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
