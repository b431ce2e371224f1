"""Byte-level BPE encoding and decoding (operator 5).

Texts are split by the tokenizer's pattern; each match is encoded on its own.
Bytes are mapped to Latin-1 characters, so one Aho-Corasick automaton over the
reversed vocabulary finds the tokens that start at every position in a single
pass.  The encoder then walks forward with the longest token and backtracks:
a token may follow another only if merging the bytes of the two alone gives
back exactly these two (decided on the two tokens' own last merges, remembered
per pair), and a position that led nowhere
is never tried again.  A token sequence whose neighbours all fit is the one
that the merges produce, so the result is exact and the work is linear in the
match's length.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import byte_batches, id_text, worker_cache

#: Encoded matches remembered per Python worker (two generations of this many).
CACHE_MATCHES = 250_000
#: Token pairs remembered per Python worker.
FITS = 500_000
NEVER = 1 << 60
#: Longer matches are not remembered.
CACHE_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        # A token whose own bytes merge to something else is never made.
        self.made = {t: r for t, r in ranks.items() if len(t) == 1 or self._split(r)}
        self.size = {r: len(t) for t, r in self.made.items()}
        self.prefix: dict[int, int] = {}
        self.auto = ahocorasick.Automaton()
        for t, r in self.made.items():
            self.auto.add_word(t[::-1].decode("latin-1"), r)
        self.auto.make_automaton()
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]] | None] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.table = pa.array([self.bytes_of.get(r, b"") for r in range(max(self.bytes_of) + 1)], pa.binary())

    def merged(self, data: bytes) -> list[int]:
        """The merges by definition: join the lowest-ranked neighbouring parts until none can be joined."""
        parts = [data[k:k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1)))
            if best[0] == NEVER:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or a token that is never made."""
        if token not in self.splits:
            data = self.bytes_of[token]
            parts = [data[k:k + 1] for k in range(len(data))]
            while len(parts) > 2:
                rank, k = min((self.ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
                if rank == NEVER:
                    break
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.splits[token]

    def _shorter(self, token: int) -> int:
        """The longest made token that is a proper prefix of this one; -1 if there is none."""
        if token not in self.prefix:
            data = self.bytes_of[token]
            self.prefix[token] = next((r for k in range(len(data) - 1, 0, -1) if (r := self.made.get(data[:k])) is not None), -1)
        return self.prefix[token]

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int]] | None:
        """The parts at one end of the token while it is being merged, from the outermost byte on:
        (bytes, rank of the merge that uses the part up).  None if a part's rank is above its merge's."""
        key = token, right
        if key not in self.edges:
            out, t, used = [], token, NEVER
            while True:
                out.append((self.bytes_of[t], used))
                parts = self._split(t)
                if parts is None:
                    break
                if max(parts) > t:
                    out = None
                    break
                used, t = t, parts[right]
            self.edges[key] = out and out[::-1]
        return self.edges[key]

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives [a, b].

        It does unless, at some time, the part at a's end and the part at b's
        start form a token that is merged before either is used up inside its
        own token; of equal ranks the left one is merged first."""
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > FITS:
                self.fits.clear()
            left, right = self._edge(a, True), self._edge(b, False)
            if left is None or right is None:
                ok = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            else:
                i = j = 0
                while True:
                    (x, x_used), (y, y_used) = left[i], right[j]
                    rank = self.ranks.get(x + y, NEVER)
                    ok = not (rank < x_used and rank <= y_used and rank < NEVER)
                    if not ok or x_used == y_used == NEVER:
                        break
                    if x_used <= y_used:
                        i += 1
                    else:
                        j += 1
            self.fits[a, b] = ok
        return ok

    def _match(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one match by longest match and backtracking."""
        whole = self.made.get(data)
        if whole is not None:
            return (whole,)
        n, size, fits, known = len(data), self.size, self._fit, self.fits
        # Of the tokens that start at a place, the automaton gives the longest first.
        longest, last = [0] * n, -1
        for end, token in self.auto.iter(data[::-1].decode("latin-1")):
            if end != last:
                longest[n - 1 - end], last = token, end
        dead, path, pos, before, token = bytearray(n + 1), [], 0, -1, longest[0]
        while pos < n:
            while token >= 0:
                if not dead[pos + size[token]] and (before < 0 or (known[before, token] if (before, token) in known else fits(before, token))):
                    break
                token = self._shorter(token)
            if token >= 0:
                path.append(token)
                pos += size[token]
                before, token = token, longest[pos] if pos < n else -1
            else:
                # Nothing fits here: the token before was too long.
                dead[pos] = 1
                too_long = path.pop()
                pos -= size[too_long]
                before, token = path[-1] if path else -1, self._shorter(too_long)
        return tuple(path)

    def _remember(self, match: str) -> bytes:
        """Ids of a match that is not in the newer cache, as packed 32-bit numbers."""
        ids = self.old.get(match)
        if ids is None:
            ids = array("i", self._match(match.encode("utf-8"))).tobytes()
        if len(match) <= CACHE_BYTES:
            self.new[match] = ids
        return ids

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of all texts one after the other, and where each text's begin and end.

        Each distinct match of the batch is looked up once."""
        if len(self.new) > CACHE_MATCHES:
            self.old, self.new = self.new, {}
        found = [self.find(t) for t in texts]
        coded = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        get = self.new.get
        known = [get(m) or self._remember(m) for m in coded.dictionary.to_pylist()]
        size = np.array([len(k) for k in known], np.int64) >> 2
        codes = coded.indices.to_numpy()
        n = size[codes]
        stop = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(stop[-1]) + np.repeat((np.cumsum(size) - size)[codes] - stop[:-1], n)
        ends = np.cumsum([0] + [len(f) for f in found])
        return stop[ends], np.frombuffer(b"".join(known), np.int32)[at]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[1].tolist()

    def decode_batch(self, offsets: np.ndarray, ids: pa.Array) -> pa.Array:
        """The bytes of each run of ids, as a binary column."""
        parts = pc.take(self.table, ids)
        starts = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset:parts.offset + len(parts) + 1]
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(starts[offsets].astype(np.int32)), parts.buffers()[2]])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _codec(path: str, pattern: str) -> ByteBPE:
    return worker_cache(("bytes", path, pattern), lambda: ByteBPE(read_ranks(path), pattern))


def encoder(path: str, pattern: str):
    """Column function: text -> ids array<int>.  Null and empty text give no ids."""
    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _codec(path, pattern)
        for col in texts:
            offsets, ids = bpe.encode_batch([t or "" for t in col.to_pylist()])
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
    return encode


def decoder(path: str, pattern: str):
    """Column function: ids array<int> -> the bytes they stand for (binary).  Null ids give no bytes."""
    @F.arrow_udf("binary")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _codec(path, pattern)
        for col in ids:
            if col.null_count:
                col = pa.array([x or [] for x in col.to_pylist()], pa.list_(pa.int32()))
            offsets = col.offsets.to_numpy()
            yield bpe.decode_batch(offsets - offsets[0], col.flatten())
    return decode


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row per input row, whole texts, no special tokens; only these two columns are read."""
    byte_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).select("doc_id", encoder(path, pattern)("text").alias("ids"))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds decoded (binary) to rows with ids."""
    byte_batches(encoded.sparkSession)
    return encoded.withColumn("decoded", decoder(path, pattern)("ids"))
