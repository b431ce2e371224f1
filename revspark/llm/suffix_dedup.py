"""Removal of repeated substrings by difference-cover sampling (operator 7).

Wanted: every byte covered by a string of LENGTH bytes that starts anywhere
else too.  For that only the order of suffixes up to their first LENGTH bytes
matters, and of that order only which neighbours are equal.  The steps are
those of difference-cover suffix sorting, each a shuffle of sorted, packed
fingerprints instead of one row per suffix:

1. Sample: the positions whose remainder modulo PERIOD lies in a difference
   cover.  Any two starts have a shift below PERIOD that takes both into the
   sample, so two equal strings of LENGTH bytes hold equal sampled windows of
   LENGTH - PERIOD + 1 bytes at the same shift.
2. Sort the sampled windows by name (fingerprint) over all documents; equal
   neighbours share a name.  A start whose sampled names are all unique is
   settled: its string occurs nowhere else.
3. Merge the remaining starts: their full strings of LENGTH bytes are named
   and sorted over all documents; equal neighbours mark repeated starts.

Names are 64-bit fingerprints, and the range they are sorted in is chosen by
a second, independent hash, which lengthens them by the logarithm of the
number of ranges.  A false match among n remaining starts has a probability
of about n * n / 2 ** (65 + log2(ranges)): 1e-5 for 10 ** 8 of them.

Documents are packed into chunks of about CHUNK_BYTES, written once as a
table bucketed by chunk; each pass reads that table in place and only
fingerprints travel.  A chunk sends each distinct name once, sorted and
without its positions, and gets back one bit per name, so a passage with very
many copies costs one entry per chunk.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import byte_batches, id_text, shared_path, shuffle_partitions, stored, worker_cache

LENGTH = 200
PERIOD = 133
#: A perfect difference set: every remainder modulo 133 is a difference of two of these.  (Fixed values.)
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of names sorted in one range, on average.
RANGE_BYTES = 12 << 20
#: Bits by which a sampled window's name exceeds the logarithm of their number: wrong equals only cost work there.
SPARE_BITS = 13

_SAMPLED = np.zeros(PERIOD, bool)
_SAMPLED[list(COVER)] = True
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))



def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


class _Rolling:
    """Fingerprints of windows: a polynomial over random 64-bit letters modulo 2 ** 64, mixed."""

    def __init__(self, seed: int):
        self.letters = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.base = int(self.letters[7]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            def powers(b: int) -> np.ndarray:
                out = np.empty(n, np.uint64)
                out[0] = 1
                done = 1
                while done < n:
                    m = min(done, n - done)
                    out[done:done + m] = out[:m] * np.uint64(pow(b, done, 1 << 64))
                    done += m
                return out
            self.up, self.down = powers(self.base), powers(self.inverse)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        terms = self.letters[data]
        terms *= self.up[:len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def windows(self, sums: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        h = sums[starts + width]
        h -= sums[starts]
        h *= self.down[starts]
        return _mix(h)


def _rolling() -> tuple[_Rolling, _Rolling]:
    """The two fingerprints: of names, and of the ranges that names are sorted in."""
    return worker_cache("rolling", lambda: (_Rolling(0x5EED1), _Rolling(0x5EED2)))


class _Chunk:
    """Byte positions of a chunk's documents."""

    def __init__(self, blob: bytes, lens: list[int]):
        self.data = np.frombuffer(blob, np.uint8)
        self.lens = np.array(lens, np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.local = np.arange(len(self.data)) - np.repeat(self.starts, self.lens)
        self.left = np.repeat(self.ends, self.lens) - np.arange(len(self.data))
        self.sums = None

    def names(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        name, place = _rolling()
        if self.sums is None:
            self.sums = name.sums(self.data), place.sums(self.data)
        return name.windows(self.sums[0], at, width), place.windows(self.sums[1], at, width)

    def samples(self) -> np.ndarray:
        width = LENGTH - PERIOD + 1
        ok = _SAMPLED[self.local % PERIOD]
        ok &= self.left >= width
        ok &= np.repeat(self.lens >= LENGTH, self.lens)
        return np.flatnonzero(ok)

    def near(self, at: np.ndarray) -> np.ndarray:
        """Starts of full strings that hold one of the sampled positions at a shift below PERIOD."""
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, at - np.minimum(self.local[at], PERIOD - 1), 1)
        np.add.at(step, at + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.left >= LENGTH))


class _Names:
    """Distinct names of a chunk, sorted by range and name, and where each position's name is among them."""

    def __init__(self, name: np.ndarray, place: np.ndarray, ranges: int, width: int):
        if width < 8:
            name = name >> np.uint64(64 - 8 * width)
        part = (((place >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint16 if ranges <= 65536 else np.uint32)
        order = np.argsort(name)
        order = order[np.argsort(part[order], kind="stable")]
        names, parts = name[order], part[order]
        new = np.ones(len(names), bool)
        if len(names):
            new[1:] = (names[1:] != names[:-1]) | (parts[1:] != parts[:-1])
        group = np.cumsum(new) - 1
        self.of = np.empty(len(names), np.int64)
        self.of[order] = group
        self.names, self.parts = names[new], parts[new]
        self.many = np.bincount(group, minlength=len(self.names)) > 1
        self.width = width

    def rows(self, chunk: int, out: list[tuple]) -> None:
        if not len(self.names):
            return
        first = np.flatnonzero(np.r_[True, self.parts[1:] != self.parts[:-1]])
        packed = self.names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.width]
        for lo, hi in zip(first.tolist(), np.r_[first[1:], len(self.names)].tolist()):
            out.append((int(self.parts[lo]), chunk, packed[lo:hi].tobytes(), np.packbits(self.many[lo:hi]).tobytes()))

    def repeated(self, replies: list[dict] | None) -> np.ndarray:
        """For each position, whether its name occurs more than once anywhere."""
        if not len(self.names):
            return np.zeros(0, bool)
        sizes = dict(zip(*(x.tolist() for x in np.unique(self.parts, return_counts=True))))
        by = {r["part"]: r["bits"] for r in replies or []}
        flags = [np.unpackbits(np.frombuffer(by[p], np.uint8), count=n) for p, n in sorted(sizes.items())]
        return np.concatenate(flags).astype(bool)[self.of]


_SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary()), ("many", pa.binary())])
_SENT_DDL = "part int, chunk long, names binary, many binary"


def _send(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENT)], schema=_SENT)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ctx = TaskContext.get()
    chunk = (ctx.partitionId() if ctx else 0) << 32
    ids, texts, size = [], [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([b"".join(texts)], pa.binary())],
            names=["chunk", "ids", "lens", "blob"])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if ids and size + len(t) > CHUNK_BYTES:
                yield row()
                chunk, ids, texts, size = chunk + 1, [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield row()


def _answers(sent: DataFrame, width: int) -> DataFrame:
    """(chunk, replies): one bit per sent name, set if the name is elsewhere too."""
    def run(rows: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in rows.column("names").to_pylist()]
        sizes = np.array([len(x) for x in raw])
        full = np.zeros((int(sizes.sum()), 8), np.uint8)
        full[:, :width] = np.concatenate(raw)
        del raw
        names = full.view("<u8").ravel()
        order = np.argsort(names)
        names = names[order]
        same = names[1:] == names[:-1]
        twice = np.zeros(len(names), bool)
        twice[1:] |= same
        twice[:-1] |= same
        flags = np.empty(len(names), bool)
        flags[order] = twice
        ends = np.cumsum(sizes)
        bits = [np.packbits(flags[e - n:e] | np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool)).tobytes()
                for e, n, m in zip(ends.tolist(), sizes.tolist(), rows.column("many").to_pylist())]
        return pa.table([rows.column("chunk"), rows.column("part"), pa.array(bits, pa.binary())], names=["chunk", "part", "bits"])

    bits = sent.groupBy("part").applyInArrow(run, "chunk long, part int, bits binary")
    return bits.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("replies"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans array<struct<start,end>>, kept binary.

    spans are the maximal removed runs of the text's UTF-8 bytes: all bytes
    covered by a string of LENGTH bytes that also starts elsewhere, in the same
    or another document, judged on the input.  kept is the rest, concatenated.
    Null and empty texts, and those below LENGTH bytes, lose nothing.  Repeated
    rows and null ids are documents like any other (so of equal long rows all
    lose everything).  An empty table gives an empty result.  Other columns
    are never read."""
    spark = docs.sparkSession
    byte_batches(spark)
    table = f"revspark_chunks_{uuid.uuid4().hex}"
    (id_text(docs, id_col, text_col).mapInArrow(_chunks, "chunk long, ids array<long>, lens array<int>, blob binary")
     .write.bucketBy(shuffle_partitions(spark), "chunk").option("path", shared_path(spark, "chunks"))
     .option("compression", "zstd").saveAsTable(table))
    chunks = spark.table(table)
    add = lambda a, x: a + x.cast("long")
    total = chunks.agg(F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), add)), F.lit(0))).first()[0]

    samples = max(1, total * len(COVER) // PERIOD)
    width = min(8, math.ceil((math.log2(samples) + SPARE_BITS) / 8))
    ranges = max(shuffle_partitions(spark), samples * width // RANGE_BYTES)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, lens, blob in zip(*(b.column(k).to_pylist() for k in range(3))):
                c, out = _Chunk(blob, lens), []
                _Names(*c.names(c.samples(), LENGTH - PERIOD + 1), ranges, width).rows(chunk, out)
                yield _send(out)

    replies = stored(_answers(chunks.select("chunk", "lens", "blob").mapInArrow(first, _SENT_DDL), width), "repeats-1")

    def remaining(c: _Chunk, answer) -> np.ndarray:
        at = c.samples()
        seen = _Names(*c.names(at, LENGTH - PERIOD + 1), ranges, width).repeated(answer)
        return c.near(at[seen])

    open_chunks = chunks.join(replies.hint("shuffle_hash"), "chunk")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, lens, blob, answer in zip(*(b.column(k).to_pylist() for k in range(4))):
                c, out = _Chunk(blob, lens), []
                _Names(*c.names(remaining(c, answer), LENGTH), ranges, 8).rows(chunk, out)
                yield _send(out)

    sent = open_chunks.select("chunk", "lens", "blob", "replies").mapInArrow(second, _SENT_DDL)
    full = stored(_answers(sent, 8).withColumnRenamed("replies", "full"), "repeats-2")
    ready = chunks.join(replies.hint("shuffle_hash"), "chunk", "left").join(full.hint("shuffle_hash"), "chunk", "left")

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, lens, blob, answer, whole in zip(*(b.column(k).to_pylist() for k in range(5))):
                c = _Chunk(blob, lens)
                step = np.zeros(len(c.data) + 1, np.int32)
                if whole:
                    at = remaining(c, answer)
                    at = at[_Names(*c.names(at, LENGTH), ranges, 8).repeated(whole)]
                    step[at] += 1
                    step[at + LENGTH] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edge = np.diff(np.r_[False, gone, False].astype(np.int8))
                # A run that goes on over a document's end is cut there.
                inner = c.starts[(c.starts > 0) & (c.starts < len(gone))]
                inner = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(inner) else inner
                begins = np.union1d(np.flatnonzero(edge == 1), inner)
                stops = np.union1d(np.flatnonzero(edge == -1), inner)
                lo, hi = np.searchsorted(begins, c.starts), np.searchsorted(begins, c.ends)
                kept_all = c.data[~gone].tobytes()
                kept_at = np.r_[0, np.cumsum(~gone)]
                spans, kept = [], []
                for s, e, i, j in zip(c.starts.tolist(), c.ends.tolist(), lo.tolist(), hi.tolist()):
                    spans.append([{"start": x - s, "end": y - s} for x, y in zip(begins[i:j].tolist(), stops[i:j].tolist())])
                    kept.append(kept_all[kept_at[s]:kept_at[e]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(lens, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"])

    return ready.select("ids", "lens", "blob", "replies", "full").mapInArrow(
        last, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
