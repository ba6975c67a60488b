"""Byte-level BPE encoding and decoding as reductions over a monoid tree.

A text is cut by the vocabulary's pattern, and each match is encoded by itself. The
encodings of byte strings form a monoid under `joined`: halves are encoded by
recursion, and neighbours are joined by merging a window around their boundary anew.
The window grows, doubling, on each side where its outermost token is not the one
that stood there before.

Where it is, all tokens further out are proved stable. Tokens that each merge to
themselves are the encoding of their bytes if and only if every two neighbours merge
to just these two: the first merge across a boundary would be the first one in that
pair alone too, for the lower rank and then the leftmost pair come first in both. A
token that stays at the window's edge has its old neighbour, with which it stood
that test already.

Decoding concatenates the tokens' bytes up the same tree. Matches repeat a lot, so
their ids are kept in a bounded memo for each worker.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Byte strings up to this length are leaves of the encoding tree (merging one takes
#: less time than joining its halves), id lists up to this length those of the
#: decoding tree.
LEAF_BYTES, LEAF_IDS = 12, 1024
#: Matches kept by a worker, and the longest one kept.
MEMO_MATCHES = 400_000
MEMO_CHARS = 64
#: Merged windows kept by a worker, and the longest one kept.
MEMO_WINDOWS = 300_000
MEMO_WINDOW_BYTES = 32
#: Windows that leave fewer tokens outside than this are widened to everything.
NEAR = 2
#: Byte strings up to this length are merged by scans, longer ones by a heap.
SHORT = 64
#: Above every rank.
NONE = 1 << 40
#: Matches of a text that are held at a time.
BATCH_MATCHES = 100_000

assert array("I").itemsize == 4 and sys.byteorder == "little"


class ByteCodec:
    """Encoder and decoder for one table of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES):
        import regex

        self.ranks = ranks
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("only vocabularies that hold all single bytes are supported")
        self.shown = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        #: Every two tokens that make a token, packed, with that token.
        self.shift = max(self.shown).bit_length()
        self.pair_ids = {}
        for token, own in self.ranks.items():
            for cut in range(1, len(token)):
                x, y = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if x is not None and y is not None:
                    self.pair_ids[x << self.shift | y] = own
        self.pattern = regex.compile(pattern)
        self.leaf_bytes = max(leaf_bytes, 1)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.windows: dict[bytes, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Byte-pair merging by its definition: the lowest rank first, the leftmost of
        equals, until no neighbours make a token. Takes n log n steps."""
        n, rank = len(data), self.ranks.get
        if n <= SHORT:
            pair, shift = self.pair_ids.get, self.shift
            ids = [self.byte_ids[b] for b in data]
            pairs = [pair(x << shift | y, NONE) for x, y in zip(ids, ids[1:])]
            while pairs and (least := min(pairs)) != NONE:
                at = pairs.index(least)
                ids[at] = least
                del ids[at + 1], pairs[at]
                if at:
                    pairs[at - 1] = pair(ids[at - 1] << shift | least, NONE)
                if at < len(pairs):
                    pairs[at] = pair(least << shift | ids[at + 1], NONE)
            return ids
        ends = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n))  # where the part to the left begins
        heap = []
        for i in range(n - 1):
            r = rank(data[i : i + 2])
            if r is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        dead = bytearray(n + 1)
        while heap:
            r, i = heapq.heappop(heap)
            if dead[i] or (middle := ends[i]) == n or rank(data[i : ends[middle]]) != r:
                continue  # one of the two parts has changed since
            dead[middle] = 1
            end = ends[i] = ends[middle]
            before[end] = i
            if end < n and (r := rank(data[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i))
            if i and (r := rank(data[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def _window(self, data: bytes) -> list[int]:
        """merged(), kept for short strings: windows and leaves repeat far more than
        matches do. Its lists are shared, and never changed."""
        found = self.windows.get(data)
        if found is None:
            found = self.merged(data)
            if len(data) <= MEMO_WINDOW_BYTES:
                if len(self.windows) >= MEMO_WINDOWS:
                    self.windows.clear()
                self.windows[data] = found
        return found

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: the encoding of two byte strings one after the
        other, from their encodings."""
        n, m = len(left), len(right)
        if not n or not m:
            return left or right
        i = j = 1
        while True:
            if i + j + NEAR > n + m:  # next to everything: windows short of it mostly fail
                i, j = n, m
            some = left[n - i :] + right[:j]
            data = b"".join([self.shown[t] for t in some])
            if i == n and j == m:
                return self.merged(data)
            window = self._window(data)
            left_open = i < n and window[0] != left[n - i]
            right_open = j < m and window[-1] != right[j - 1]
            if not left_open and not right_open:
                return left[: n - i] + window + right[j:]
            if left_open:
                i = min(2 * i, n)
            if right_open:
                j = min(2 * j, m)

    def reduced(self, data: bytes) -> list[int]:
        """Encode halves, join them."""
        if len(data) <= self.leaf_bytes:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.reduced(data[:half]), self.reduced(data[half:]))

    def _packed(self, match: str) -> bytes:
        packed = self.memo.get(match) or self.older.get(match)
        if packed is None:
            data = match.encode()
            whole = self.ranks.get(data)
            packed = array("I", [whole] if whole is not None else self.reduced(data)).tobytes()
        if len(match) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_MATCHES:
                # Two generations: what is still in use moves on to the new one.
                self.older, self.memo = self.memo, {}
            self.memo[match] = packed
        return packed

    def _matches(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BATCH_MATCHES:
            yield self.pattern.findall(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while batch := list(islice(found, BATCH_MATCHES)):
            yield batch

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for matches in self._matches(text):
            found = list(map(self.memo.get, matches))
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = self._packed(matches[at])
            out.append(b"".join(found))
        return b"".join(out)

    def decode_packed(self, packed: bytes) -> bytes:
        """The bytes of packed ids: those of both halves, one after the other. Ids
        that the vocabulary does not have give nothing."""
        ids = memoryview(packed).cast("I") if packed else ()
        if len(ids) <= LEAF_IDS:
            return b"".join([self.shown.get(t, b"") for t in ids])
        half = len(ids) // 2 * 4
        return self.decode_packed(packed[:half]) + self.decode_packed(packed[half:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> ByteCodec:
    return ByteCodec(read_ranks(ranks_path), pattern)


def encode_bytes(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids_le") -> DataFrame:
    """Add the ids of every text as packed little-endian uint32 (`out_col`), without
    special tokens.

    Null counts as the empty text, which has no ids. Every row is encoded by itself,
    so repeated rows have equal ids, and a table without rows gives none. Other
    columns stay; one already named out_col is replaced. The file of ranks is opened
    where the code runs, so it must exist on every worker.
    """

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        c = codec(ranks_path, pattern)
        return pa.array((c.encode_packed(t.as_py() or "") for t in texts), pa.binary())

    return docs.withColumn(out_col, packed(F.col(text_col)))


def decode_bytes(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids_le", out_col: str = "decoded") -> DataFrame:
    """Add the bytes of packed ids (`out_col`, binary).

    Null ids give no bytes, and neither do ids that the vocabulary does not have;
    the bytes need not be UTF-8 where ids were not made by encoding. Repeated rows
    are decoded alike, and a table without rows gives none. Other columns stay; one
    already named out_col is replaced.
    """

    @F.arrow_udf("binary")
    def shown(ids: pa.Array) -> pa.Array:
        c = codec(ranks_path, pattern)
        return pa.array((c.decode_packed(x.as_py() or b"") for x in ids), pa.binary())

    return df.withColumn(out_col, shown(F.col(ids_col)))


def default_ranks() -> tuple[str, str]:
    """File of ranks and pattern of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op12_byte_bpe(spark, sf_dir):
    ranks, pattern = default_ranks()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode_bytes(encode_bytes(docs, ranks, pattern), ranks, pattern)
    return both.select(
        "doc_id",
        F.expr("octet_length(ids_le) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
