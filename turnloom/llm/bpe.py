"""Byte-level BPE encoding and decoding.

A text is split into pieces by the tokenizer's pattern, each piece is merged by itself. Within a
piece a segment tree over its byte positions stores the leftmost minimum pair rank: the root names
the next merge, and a merge changes the pairs of two live neighbours only, so it costs a few
logarithmic point updates. Pieces repeat a lot and most are short, so each task keeps the ids of the
pieces it has met (a bounded number of them) and merges new short pieces many at a time: the same
trees, one per row of an array, updated together. Long pieces have a tree each.

The work is per document, without a shuffle: ``mapInArrow`` over the scan.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import column, slices

#: Pieces of up to so many bytes are merged many at a time.
SHORT = 64
#: So many pieces are kept per task; then the memory of them starts anew.
KEPT_PIECES = 400_000
#: Texts are worked on in slices of about this many bytes: a piece and its ids are some 20 times its text.
SLICE_BYTES = 1 << 19
_NONE = np.int32(2**31 - 1)

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Encoder:
    """Merges pieces by ranks. A token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bits = max(self.token).bit_length()
        #: All pairs of tokens that join to a token, in order, with the joined token's rank.
        pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    pairs[left << self.bits | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; _NONE where the pair joins to no token."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        key = left.astype(np.int64) << self.bits | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one piece, by one tree."""
        ids, n = self.single[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(1, (n - 1).bit_length())
        none, pairs, bits = int(_NONE), self.pairs, self.bits
        # leaf i holds the rank of the pair that starts at i, times the tree's width, plus i: the
        # minimum is the lowest rank and, among equals, the leftmost position
        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).astype(np.int64)
        leaves = np.full(size, none, np.int64)
        leaves[: n - 1] = first
        levels = [leaves * size + np.arange(size)]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = np.concatenate([[0], *levels[::-1]]).tolist()
        limit = none * size

        def put(i: int, rank: int) -> None:
            at = i + size
            tree[at] = rank * size + i
            at >>= 1
            while at:
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    break
                tree[at] = low
                at >>= 1

        while tree[1] < limit:
            rank, i = divmod(tree[1], size)
            gone = right[i]
            after = right[gone]
            ids[i], ids[gone], right[i] = rank, -1, after
            put(gone, none)
            if after < n:
                left[after] = i
                put(i, pairs.get(rank << bits | ids[after], none))
            else:
                put(i, none)
            before = left[i]
            if before >= 0:
                put(before, pairs.get(ids[before] << bits | rank, none))
        return [x for x in ids if x >= 0]

    def merge_short(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many short pieces, by a tree in each row of an array."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        rows, width = len(pieces), 1 << max(1, (int(lengths.max()) - 1).bit_length())
        ids = np.full((rows, width + 1), -1, np.int32)
        columns = np.arange(width + 1)
        ids[columns < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        right = np.broadcast_to(columns + 1, ids.shape).astype(np.int16)
        left = np.broadcast_to(columns - 1, ids.shape).astype(np.int16)
        tree = np.full((rows, 2 * width), int(_NONE) * width, np.int64)
        flat_tree = tree.reshape(-1)
        row, col = np.nonzero(columns[:width] < lengths[:, None] - 1)
        tree[row, width + col] = self.pair_ranks(ids[row, col], ids[row, col + 1]).astype(np.int64) * width + col
        for top in (width >> k for k in range(1, width.bit_length())):
            tree[:, top : 2 * top] = np.minimum(tree[:, 2 * top : 4 * top : 2], tree[:, 2 * top + 1 : 4 * top : 2])
        limit = int(_NONE) * width

        def put(row: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            base, node, now = row * (2 * width), at + width, rank.astype(np.int64) * width + at
            flat_tree[base + node] = now
            for _ in range(width.bit_length() - 1):
                now = np.minimum(now, flat_tree[base + (node ^ 1)])
                node = node >> 1
                flat_tree[base + node] = now

        row = np.flatnonzero(tree[:, 1] < limit)
        while len(row):
            rank, at = np.divmod(tree[row, 1], width)
            gone = right[row, at].astype(np.int64)
            after = right[row, gone].astype(np.int64)
            ids[row, at] = rank
            ids[row, gone] = -1
            right[row, at] = after
            put(row, gone, np.full(len(row), _NONE))
            inside = after < lengths[row]
            left[row[inside], after[inside]] = at[inside]
            follow = np.full(len(row), _NONE, np.int32)
            follow[inside] = self.pair_ranks(rank[inside].astype(np.int32), ids[row[inside], after[inside]])
            put(row, at, follow)
            before = left[row, at].astype(np.int64)
            some = before >= 0
            if some.any():
                put(row[some], before[some], self.pair_ranks(ids[row[some], before[some]], rank[some].astype(np.int32)))
            row = row[tree[row, 1] < limit]
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of pieces. A piece that is a token as a whole is that token."""
        found: list = [(r,) if (r := self.ranks.get(p)) is not None else None for p in pieces]
        short: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if found[i] is None:
                if len(p) > SHORT:
                    found[i] = tuple(self.merge_long(p))
                else:
                    short.setdefault((len(p) - 1).bit_length(), []).append(i)
        for group in short.values():
            for i, ids in zip(group, self.merge_short([pieces[i] for i in group])):
                found[i] = ids
        return found


class Splitter:
    """Splits texts into the matches of a pattern.

    The pattern of byte-level vocabularies depends only on whether a character is a letter, a number,
    white space or none of these, and on a few contractions; for it, all starts of matches in many
    texts are found at once. Any other pattern is run as it is.
    """

    #: The pattern that the published rank files were made with.
    KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.kinds = None
        if pattern == self.KNOWN:
            points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
            all_points = "".join(points)
            self.kinds = np.zeros(0x110000, np.uint8)  # 0: none of these
            for kind, what in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
                self.kinds[[ord(c) for c in regex.findall(what, all_points)]] = kind

    def starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where a match starts, in code points, for texts one after the other."""
        n = len(points)
        kind = self.kinds[points]
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 9, kind[:-1]
        before[fresh[:n]] = 9
        after = np.empty(n, np.uint8)
        after[-1], after[:-1] = 9, kind[1:]
        after[fresh[1:]] = 9
        white = kind == 3
        # the last of several white characters, or a single one, stands apart or leads the next match
        start = np.where(white, (before != 3) | ((after != 3) & (after != 9)), kind != before)
        led = np.zeros(n, bool)
        led[1:] = (points[:-1] == 0x20) & (before[1:] == 3) & ~white[1:]
        start &= ~led
        for i in np.flatnonzero(start & (points == 0x27) & (after == 1)):
            for tail in ("s", "t", "m", "d", "re", "ve", "ll"):
                to = i + 1 + len(tail)
                if to <= n and not fresh[i + 1 : to].any() and all(points[i + 1 + k] == ord(c) for k, c in enumerate(tail)):
                    start[i + 1 : to] = False
                    if to < n:
                        start[to] = True
                    break
        return np.flatnonzero(start)

    def split(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The matches in all texts, and where each text's matches start and end among them."""
        whole = "".join(texts)
        if self.kinds is None or not whole:
            each = [self.pattern.findall(t) for t in texts]
            return list(chain.from_iterable(each)), [0, *accumulate(map(len, each))]
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = self.starts(points, offsets)
        at = [*starts.tolist(), len(whole)]
        return [whole[a:b] for a, b in pairwise(at)], np.searchsorted(starts, offsets).tolist()


class Codec:
    """Texts to ids and back, with a bounded memory of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder, self.splitter, self.known = Encoder(ranks), Splitter(pattern), {}
        self.name = {i: str(i) for i in self.encoder.token}

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces, first = self.splitter.split(texts)
        ids = list(map(self.known.get, pieces))
        if missing := [i for i, x in enumerate(ids) if x is None]:
            new = list({pieces[i] for i in missing})
            # as bytes: a tuple of integers takes several times as much
            merged = {p: array("i", x).tobytes() for p, x in zip(new, self.encoder.merge([p.encode() for p in new]))}
            for i in missing:
                ids[i] = merged[pieces[i]]
            if len(self.known) + len(merged) > KEPT_PIECES:
                self.known = {}
            self.known.update(merged)
        return [np.frombuffer(b"".join(ids[a:b]), np.int32).tolist() for a, b in pairwise(first)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.encoder.token.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec_of(ranks_path: str, pattern: str) -> Codec:
    """The codec of a Python worker, which keeps it (and its pieces) from task to task."""
    return Codec(read_ranks(ranks_path), pattern)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of df: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, where asked for,
    ``ids``, the token ids of the whole text.

    ids_sha256 is of the decimal ids joined by one space; decoded_sha256 of the bytes that the ids
    decode to, which are the text's. Null counts as the empty text, which has no tokens. Special
    tokens are not known: their strings are ordinary text. Ids may be null or repeat; other columns
    of df are ignored, whatever their names. ranks_path must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks_path, pattern)
        name = codec.name.__getitem__
        for part, texts in slices(batches, size=SLICE_BYTES):
            strings = [texts.text(i).decode() for i in range(len(texts))]
            ids = codec.encode(strings)
            made = {
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(" ".join(map(name, x)).encode()).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]),
            }
            if with_ids:
                made["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(made)

    rows = df.select(column(df, id_col, "bigint").alias("doc_id"), F.coalesce(column(df, text_col, "string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
