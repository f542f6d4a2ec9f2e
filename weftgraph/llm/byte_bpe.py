"""Byte-level BPE: texts to token ids by a public rank file, and ids back to bytes.

A text is split by a pattern; each match (a pre-token) goes through two tiers. The first is a minimal perfect hash of
the vocabulary (as many slots as tokens, no empty one): a pre-token that is a token itself has its id by one look,
confirmed by its bytes. The rest are merged byte by byte: the bytes are linked, a heap holds the ranks of adjoining
pairs, and the lowest rank, the leftmost of equals, merges until no pair is a token.

The distinct pre-tokens of some CHUNK matches are looked up at once, in numpy; a Python worker holds no more than that
and the last MERGED merged pieces beside the texts and ids of a run of rows. The vocabulary is built on the driver and broadcast; MOST_TOKENS and MOST_BYTES bound it.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix

CHUNK = 200_000
TEXT_BYTES = 1 << 20
BUCKET = 2
MERGED = 1 << 18
MOST_TOKENS, MOST_BYTES = 1 << 20, 1 << 25

# What the `regex` library's tables count as a letter or a number and Unicode 16, which the tokenizer's
# own splitting follows, has not assigned.
UNASSIGNED = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)
#: Stands for them while a text is split: neither letter, number nor space.
_OTHER = "\uffff"

_BYTE = np.random.default_rng(20240613).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _hashes(values: pa.BinaryArray) -> np.ndarray:
    """A uint64 of the bytes of each value, by running sums of a polynomial."""
    if not len(values):
        return np.empty(0, np.uint64)
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    start, stop = at[:-1] - at[0], at[1:] - at[0]
    up, down = (np.full(len(raw) + 1, x, np.uint64) for x in (_BASE, _BACK))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def _slots(hashes: np.ndarray, move: np.ndarray | np.int64, size: int) -> np.ndarray:
    """Where hashes go that their bucket's move (from 0) sends on; a move under 0 names the slot itself."""
    sent = (mix(hashes ^ mix(np.maximum(move, 0).astype(np.uint64) + np.uint64(1))) % np.uint64(size)).astype(np.int64)
    return np.where(move < 0, -move - 1, sent)


def _displace(hashes: np.ndarray) -> np.ndarray:
    """The moves, by bucket, that send every hash to a slot of its own: large buckets first, single hashes fill what is left."""
    size = len(hashes)
    buckets = max(1, size // BUCKET)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order, many = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)
    first = np.cumsum(many) - many
    move, free = np.zeros(buckets, np.int64), np.ones(size, bool)
    for b in np.argsort(-many, kind="stable")[: int((many > 1).sum())]:
        own = hashes[order[first[b] : first[b] + many[b]]]
        for d in itertools.count(0, 64):
            tried = _slots(own, np.arange(d, d + 64)[:, None], size)
            fits = free[tried].all(1) & (np.diff(np.sort(tried, 1), axis=1) > 0).all(1)
            if fits.any():
                k = int(np.argmax(fits))
                move[b], free[tried[k]] = d + k, False
                break
            if d > 1 << 24:
                raise ValueError("two tokens have one hash")
    move[many == 1] = -np.flatnonzero(free) - 1
    return move


@dataclass(eq=False)
class Vocabulary:
    """Tokens by id, the moves of the minimal perfect hash, and the token of each of its slots."""

    tokens: pa.BinaryArray
    move: np.ndarray
    slot: np.ndarray
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with lines of a token in base 64 and its rank; ranks run from 0 without a gap, all 256 bytes are tokens."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must run from 0 without a gap and hold every single byte")
        if len(ranks) > MOST_TOKENS or sum(map(len, ranks)) > MOST_BYTES:
            raise ValueError(f"more than {MOST_TOKENS} tokens or {MOST_BYTES} bytes")
        tokens = pa.array(sorted(ranks, key=ranks.get), pa.binary())
        hashes = _hashes(tokens)
        move = _displace(hashes)
        slot = np.empty(len(tokens), np.int64)
        slot[_slots(hashes, move[(hashes % np.uint64(len(move))).astype(np.int64)], len(tokens))] = np.arange(len(tokens))
        return cls(tokens, move, slot, pattern)

    def find(self, values: pa.BinaryArray) -> np.ndarray:
        """The ids of the values that are tokens, -1 for the others."""
        hashes = _hashes(values)
        if not len(hashes):
            return np.empty(0, np.int64)
        ids = self.slot[_slots(hashes, self.move[(hashes % np.uint64(len(self.move))).astype(np.int64)], len(self.tokens))]
        same = pc.equal(self.tokens.take(pa.array(ids)), values).to_numpy(zero_copy_only=False)
        return np.where(same, ids, -1)


def merge_bytes(piece: bytes, ranks: dict[bytes, int], two: list[int | None]) -> list[int]:
    """The ids of a piece: of all adjoining parts whose union is a token, the lowest rank merges first, the leftmost of equals.

    two: the ranks of all pairs of bytes, by their number. The part that starts at i ends at end[i], or at n if it has
    merged into the one before it. A heap's entry is rank, start and stop in one number.
    """
    n = len(piece)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    end, before = list(range(1, n + 2)), list(range(-1, n))
    heap = []
    for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False)):
        if (r := two[a << 8 | b]) is not None:
            heap.append((r << bits | i) << bits | i + 2)
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        stop, i = entry & mask, entry >> bits & mask
        if end[end[i]] != stop:
            continue  # one of the two parts has merged with another since
        end[end[i]], end[i], before[stop] = n, stop, i
        if stop < n and (r := ranks.get(piece[i : end[stop]])) is not None:
            heapq.heappush(heap, (r << bits | i) << bits | end[stop])
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r << bits | left) << bits | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Coder:
    """What a task needs to encode and decode, made from a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.words = vocabulary
        self.ranks = {t: i for i, t in enumerate(vocabulary.tokens.to_pylist())}
        self.two = [self.ranks.get(bytes(divmod(i, 256))) for i in range(1 << 16)]
        self.split, self.newer = regex.compile(vocabulary.pattern), re.compile(f"[{UNASSIGNED}]")
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.ranks))]
        self.merged = functools.lru_cache(MERGED)(self._merge)

    def _merge(self, piece: bytes) -> bytes:
        return b"".join([self.packed[i] for i in merge_bytes(piece, self.ranks, self.two)])

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, in lists of CHUNK at most."""
        if not text.isascii() and self.newer.search(text):
            found = (text[m.start() : m.end()] for m in self.split.finditer(self.newer.sub(_OTHER, text)))
        elif len(text) <= CHUNK:
            yield self.split.findall(text)
            return
        else:
            found = (m.group() for m in self.split.finditer(text))
        while some := list(itertools.islice(found, CHUNK)):
            yield some

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece)."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary())
        found = self.words.find(distinct)
        each = [self.packed[i] for i in found.tolist()]  # what isn't found takes the last one for now
        missed = np.flatnonzero(found < 0)
        for k, piece in zip(missed.tolist(), distinct.take(pa.array(missed)).to_pylist(), strict=True):
            each[k] = self.merged(piece) if len(piece) <= 64 else self._merge(piece)
        many = np.fromiter(map(len, each), np.int32, len(each)) // 4
        starts = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(each), "<u4")))
        return lists.take(coded.indices).flatten().to_numpy(), many[coded.indices.to_numpy()]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Each text's ids, 4 bytes little-endian each; bytes that are no UTF-8 read as U+FFFD."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            ids, many = self.ids(held)
            ends = np.concatenate([[0], np.cumsum(many)])
            at = 0
            for i, n in owners:
                out[i].append(ids[ends[at] : ends[at + n]].astype("<u4").tobytes())
                at += n
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for some in self.pieces((text or b"").decode("utf-8", "replace")):
                held += some
                owners.append((i, len(some)))
                if len(held) >= CHUNK:
                    flush()
        if held:
            flush()
        return [b"".join(parts) for parts in out]

    def decode(self, packed: list[bytes | None]) -> list[bytes | None]:
        """The bytes of each row's ids; null for a null and for what holds no ids of the vocabulary."""
        size = len(self.words.tokens)
        ids = [None if p is None or len(p) % 4 else np.frombuffer(p, "<u4") for p in packed]
        ids = [None if i is None or (len(i) and i.max() >= size) else i for i in ids]
        some = [i for i in ids if i is not None]
        flat = self.words.tokens.take(pa.array(np.concatenate(some) if some else np.empty(0, np.uint32)))
        at = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        raw, out, k = memoryview(flat.buffers()[2] or b""), [], 0
        for i in ids:
            if i is None:
                out.append(None)
            else:
                out.append(bytes(raw[at[k] : at[k + len(i)]]))
                k += len(i)
        return out


@functools.lru_cache(1)
def _coder(vocabulary: Vocabulary) -> Coder:
    """A worker's coder: a broadcast value is one object in each, so tasks that follow each other share it."""
    return Coder(vocabulary)


def _runs(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows): runs of rows of about `most` bytes; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield first, i - first
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes) - first


def _mapped(rows: DataFrame, vocabulary: Vocabulary, from_col: str, to_col: str, work: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f for f in rows.schema if f.name not in (from_col, to_col)]
    # columns go by their places, so that names need no quoting
    sent = rows.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{from_col}`").cast("binary").alias("x"))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)), "y binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = _coder(shared.value)
        for batch in batches:
            values = batch.column("x")
            for first, n in _runs(values, TEXT_BYTES):
                done = getattr(coder, work)(values.slice(first, n).to_pylist())
                yield {f"c{i}": batch.column(i).slice(first, n) for i in range(len(kept))} | {"y": done}

    done = map_batches(sent, run, schema)
    return done.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], F.col("y").alias(to_col))


def encode_bpe(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col in place of text_col: the text's token ids, packed as 4 bytes little-endian each.

    A null text reads as an empty one and has no ids. All other columns and rows stay as they are, repeated rows and
    null ids of documents included; a column of ids_col's name is replaced. Texts of any length are encoded whole.
    """
    return _mapped(docs, vocabulary, text_col, ids_col, "encode")


def decode_bpe(coded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """coded with bytes_col beside ids_col: the bytes that the ids stand for; null where ids_col is null or holds no such ids."""
    return _mapped(coded.withColumn("_packed", F.col(f"`{ids_col}`")), vocabulary, "_packed", bytes_col, "decode")
