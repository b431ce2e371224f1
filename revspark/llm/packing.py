"""Best-fit packing by the sum-of-squares rule (operator 2).

Tokenisation runs as one Arrow map over whole texts and leaves one small row
per piece.  The pieces are dealt into shards of bounded size; each shard is
packed on its own, longest pieces first, by the sum-of-squares rule: a piece
goes where the sum over residual gaps of (open bins with that gap) squared
becomes smallest, opening a new bin being one of the choices.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import byte_batches, id_text, stored, worker_cache

CAPACITY = 4096
END_ID = 1
#: Pieces per shard on average: enough that the last, half-filled bins of a
#: shard hardly count, few enough for one task.
SHARD_PIECES = 32_768
#: Words remembered per Python worker (two generations of this many, and as many pieces).
CACHE_WORDS = 300_000
#: Characters whose normal form (NFC, lower case) is their lower case, each on its own: Latin up to U+017F without U+0130.
LATIN = re.compile("[\x21-\x7e\u00a1-\u012f\u0131-\u017f]+")

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokens:
    """Token ids of whole texts by the ``tokenizers`` library, piece by piece.

    The normaliser and the pre-tokeniser of the file never join characters
    across ASCII white space, so a text's ids are those of its words one after
    the other.  A word of LATIN characters (its normal form is its lower case)
    is cut by the file's own split pattern and its pieces go to the library's
    model; other words go through the library whole.  Each distinct word of a
    batch is looked up once, in bounded caches of two generations.  Texts that
    hold a special token's string are encoded whole, since the library cuts
    those out first."""

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tok, self.cache = Tokenizer.from_file(path), cache
        with open(path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 65536 else np.uint32
        self.code = self.dtype().dtype.char
        self.model = self.tok.model.tokenize
        self.letters = _byte_letters()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = array(self.code, [t.id for t in self.model(letters)]).tobytes()
        return ids

    def _word(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if text.isascii() and text.isalpha():
                ids = self._piece(text.lower())
            elif LATIN.fullmatch(text):
                ids = b"".join(map(self._piece, self.split(text.lower())))
            else:
                ids = array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        self.new[word] = ids
        return ids

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column without nulls."""
        if len(self.new) > self.cache:
            self.old, self.new = self.new, {}
        if len(self.pieces) > self.cache:
            self.pieces.clear()
        whole = {}
        for s in self.special:
            for i in np.flatnonzero(pc.match_substring(texts.cast(pa.binary()), s).to_numpy(zero_copy_only=False)).tolist():
                whole[i] = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
        words = pc.ascii_split_whitespace(texts)
        ends = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        get = self.new.get
        known = [get(w) or self._word(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()]
        size = np.array([len(k) for k in known], np.int64) // np.dtype(self.dtype).itemsize
        flat = np.frombuffer(b"".join(known), self.dtype)
        codes = coded.indices.to_numpy()
        n = size[codes]
        stop = np.cumsum(n)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat((np.cumsum(size) - size)[codes] - (stop - n), n)
        all_ids = flat[at]
        cuts = np.concatenate([[0], stop])[ends - ends[0]]
        return [whole[i] if i in whole else all_ids[cuts[i]:cuts[i + 1]] for i in range(len(texts))]


def token_encoder(path: str, cache: int = CACHE_WORDS) -> WordTokens:
    """This Python worker's encoder of the tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return worker_cache(("words", path, cache), lambda: WordTokens(path, cache))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 [, ids].

    A document's ids are those of its whole text, then ``end_id``; null or
    empty text gives the single ``end_id``.  Only documents longer than
    ``capacity`` are cut."""
    byte_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = token_encoder(tokenizer_path)
        for b in batches:
            out: list[list] = [[], [], [], [], []] + ([[]] if with_ids else [])
            for doc, own in zip(b.column(0).to_pylist(), enc.ids(b.column(1))):
                ids = np.empty(len(own) + 1, "<u4")
                ids[:-1] = own
                ids[-1] = end_id
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    row = [doc, k, start, len(part), zlib.crc32(part.tobytes())] + ([part.astype("i8")] if with_ids else [])
                    for col, v in zip(out, row):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names[:len(out)])

    return id_text(docs, id_col, text_col).mapInArrow(run, _PIECES + (", ids array<long>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the given order, by the sum-of-squares rule.

    ``count[g]`` open bins have gap g (full bins are closed and not counted).
    Putting a piece of length s into gap h changes the sum of squares by
    2 * (count[h - s] - count[h] + 1); closing h = s changes it by
    1 - 2 * count[s]; a new bin by 1 + 2 * count[capacity - s].  Ties go to
    the tightest gap."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n_bins = 0
    for k, s in enumerate(lengths.tolist()):
        h, best = capacity, (1 + 2 * count[capacity - s]) if s < capacity else 1
        gaps = np.flatnonzero(count[s:capacity])
        if len(gaps):
            change = 2 * (count[gaps] - count[gaps + s] + 1)
            if gaps[0] == 0:
                change[0] = 1 - 2 * count[s]
            i = int(change.argmin())
            if change[i] <= best:
                h = int(gaps[i]) + s
        if h == capacity:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = open_bins[h].pop()
            count[h] -= 1
        where[k], offset[k] = b, capacity - h
        if h > s:
            open_bins[h - s].append(b)
            count[h - s] += 1
    return where, offset


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, length, ...).

    Every piece gets exactly one place; places in a sequence are gapless from
    0.  Repeated rows and null ids are pieces like any other; an empty table
    gives an empty result."""
    # The row number, written with the pieces, tells equal rows apart: a shard's size does not depend on their values.
    df = stored(pieces_df.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-df.count() // shard_pieces))
    spread = F.pmod(F.xxhash64("row_no"), F.lit(shards)).cast("int")
    schema = pieces_df.schema.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ")

    def run(rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        order = np.lexsort((rows.column("row_no").to_numpy(), -lengths))
        where, offset = sum_of_squares(lengths[order], capacity)
        shard = rows.column("shard")[0].as_py()
        out = rows.take(pa.array(order)).drop_columns(["shard", "row_no"])
        return out.append_column("sequence_id", pa.array(shard * 2**32 + where)).append_column("offset", pa.array(offset))

    return df.withColumn("shard", spread).groupBy("shard").applyInArrow(run, schema + ", sequence_id long, offset long")
