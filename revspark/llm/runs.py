"""Periodic runs of words by string synchronising sets (operator 11).

A run is a maximal stretch of words with smallest period q and a length of at
least max(MIN_WORDS, 3 q).  Texts are one row each and runs never cross them,
so this is one Arrow map without a shuffle; a task handles the texts of about
GROUP_WORDS words at once, laid end to end with a mark of its own after each.

Scale t = 8, 16, 32, ... (tau = t / 2) looks for periods 3 t / 4 <= q <= 3 t / 2:

* Every position gets a name, a hash of its next tau words.  Position i is
  selected if the smallest name of positions i .. i + tau is that of i or of
  i + tau.  That depends on t words only, and of any tau positions in a row one
  is selected.
* Selected positions with equal contexts (t words for q <= t, else 3 t / 2) are
  linked in order; the distance of two neighbours proposes a period.  A context
  as long as the period cannot repeat at a shorter distance within a run, and
  a run of length 3 q holds tau or more positions whose context and its repeat
  lie within it, so every run of the scale's periods is proposed.
* Inside stretches of period <= tau / 3 all positions look alike.  There (from
  t = 32 on) those whose t words lie within the stretch are left out; the two
  positions whose t words just stick out of its ends are added, which keeps
  the above true for longer periods that contain such stretches.  The left-out
  small periods are known by then: up to MIN_WORDS / 3 they come from comparing
  the words with those q places on, beyond from the smaller scales.

A proposal is only a place and a distance: words are compared to find how far
its period reaches, so hashes decide what is looked at and never the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revspark.llm.common import byte_batches, id_text

MIN_WORDS = 24
MIN_POWER = 3
#: Words laid end to end, unless a single text has more.
GROUP_WORDS = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names in a row."""
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _reach(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The longest stretch [start, end) around i .. i + p with period p."""
    n = len(w)
    lo, step = i, 64
    while lo:
        a = max(0, lo - step)
        off = np.flatnonzero(w[a:lo] != w[a + p:lo + p])
        if len(off):
            lo = a + int(off[-1]) + 1
            break
        lo, step = a, 2 * step
    hi, step = i, 64
    while hi + p < n:
        b = min(n - p, hi + step)
        off = np.flatnonzero(w[hi:b] != w[hi + p:b + p])
        if len(off):
            hi += int(off[0])
            break
        hi, step = b, 2 * step
    return lo, hi + p


def _small_periods(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, q) of the runs with q <= MIN_WORDS / MIN_POWER, which are all of at least MIN_WORDS words."""
    out = []
    for q in range(1, MIN_WORDS // MIN_POWER + 1):
        same = np.zeros(max(0, len(w) - q) + 2, np.int8)
        same[1:-1] = w[:-q] == w[q:] if len(w) > q else False
        edge = np.diff(same)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        long = ends - starts >= MIN_WORDS
        out += [(s, e, q) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` (a power of two) values in a row."""
    k = 1
    while k < width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return x


def _selected(names: np.ndarray, tau: int) -> np.ndarray:
    """The synchronising positions of the scale with windows of ``tau``."""
    if len(names) <= tau:
        return np.empty(0, np.int64)
    first, last = names[:-tau], names[tau:]
    low = np.minimum(_window_min(names, tau)[:len(first)], last)
    return np.flatnonzero((low == first) | (low == last))


def _with_edges(at: np.ndarray, t: int, n: int, known: dict) -> np.ndarray:
    """Positions without those inside stretches of period <= t / 6, and with the two just outside each stretch.

    Stretches of t > MIN_WORDS words and such a period are all known as runs."""
    inside = t > MIN_WORDS and sorted((s, e) for (s, e), q in known.items() if 6 * q <= t and e - s >= t)
    if not inside:
        return at
    step = np.zeros(n + 1, np.int32)
    for s, e in inside:
        step[s] += 1
        step[e - t + 1] -= 1
    at = at[np.cumsum(step)[at] == 0]
    edges = np.array([x for s, e in inside for x in (s - 1, e - t + 1) if 0 <= x <= n - t], np.int64)
    return np.union1d(at, edges)


def _proposals(at: np.ndarray, context: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """(period, place) of neighbouring equal contexts at a distance of ``least`` to ``most``."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    gap = at[1:] - at[:-1]
    hit = np.flatnonzero((context[1:] == context[:-1]) & (gap >= least) & (gap <= most))
    return sorted(zip(gap[hit].tolist(), at[hit].tolist()))


def find_runs(w: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``w`` by start, then period.  ``longest``: length of the longest text in it."""
    longest = len(w) if longest is None else longest
    known: dict[tuple[int, int], int] = {}

    def add(s: int, e: int, q: int) -> None:
        if e - s >= max(MIN_WORDS, MIN_POWER * q):
            # The same stretch has its smallest period only once.
            known[s, e] = min(q, known.get((s, e), q))

    for s, e, q in _small_periods(w):
        add(s, e, q)
    names, tau = _mix(w.astype(np.uint64) + np.uint64(1)), 1
    while tau < 4:
        names, tau = _pair(names[:-tau], names[tau:]), 2 * tau
    while MIN_POWER * 3 * tau // 2 <= longest and len(names) > tau:
        t = 2 * tau
        twice = _pair(names[:-tau], names[tau:])
        at = _with_edges(_selected(names, tau), t, len(w), known)
        far = at[at <= len(w) - 3 * tau]
        found = _proposals(at, twice[at], 3 * t // 4, t) + _proposals(far, _pair(twice[far], names[far + t]), t + 1, 3 * t // 2)
        done = (0, 0)
        for p, i in found:
            if done[0] == p and i + p <= done[1]:
                continue
            s, e = _reach(w, i, p)
            done = (p, e)
            add(s, e, p)
        names, tau = twice, t
    return sorted((s, e - s, q) for (s, e), q in known.items())


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray | None:
    """Which of n words lie in a run after its first period; None if none."""
    if not runs:
        return None
    step = np.zeros(n + 1, np.int32)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:-1]) > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """For every tenth document by crc32 of its id: the original word that stands at each place (a period from some place on)."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                  ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("collapsed_sha256", pa.string())])
_OUT_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, collapsed_sha256 string"


def _group(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
    """The result rows of a few texts, laid end to end."""
    flat = pa.array([x for ws in words for x in ws], pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    sizes = np.array([len(ws) for ws in words], np.int64)
    # A mark after each text, unlike any word and any other mark.
    line = np.empty(len(codes) + len(words), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    marks = starts + sizes
    is_word = np.ones(len(line), bool)
    is_word[marks] = False
    line[is_word] = codes
    line[marks] = len(flat.dictionary) + np.arange(len(words))
    found: list[list] = [[] for _ in words]
    for s, length, q in find_runs(line, int(sizes.max(initial=0))):
        k = int(np.searchsorted(starts, s, "right")) - 1
        found[k].append((s - int(starts[k]), length, q))
    rows = []
    for i, ws, runs in zip(ids, words, found):
        gone = dropped(runs, len(ws))
        kept = ws if gone is None else [ws[k] for k in np.flatnonzero(~gone).tolist()]
        best = strongest(runs) or (None, None, None)
        rows.append((i, len(ws), [{"start": s, "length": n, "period": q} for s, n, q in runs], *best, hashlib.sha256(b" ".join(kept)).hexdigest()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def periodic_runs(docs: DataFrame, reorder: Callable[[int | None, int], np.ndarray | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs, the strongest run (start, length, period; null without one), collapsed_sha256.

    Words are runs of bytes that are no ASCII white space, numbered from 0.
    collapsed_sha256 digests the words that no run holds after its first
    period, joined by one space.  ``reorder(doc_id, n)`` may name the word that
    is to stand at each of the n places.  Null and empty texts have no words;
    repeated rows and null ids are documents like any other; an empty table
    gives an empty result; other columns are never read.  A very long text is a
    group of its own: about 100 bytes of memory a word."""
    byte_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ws = text.split()
                if size and size + len(ws) > GROUP_WORDS:
                    yield _group(ids, words)
                    ids, words, size = [], [], 0
                at = reorder(i, len(ws)) if reorder else None
                ids.append(i)
                words.append(ws if at is None else [ws[k] for k in at.tolist()])
                size += len(ws)
        if ids:
            yield _group(ids, words)

    return id_text(docs, id_col, text_col).mapInArrow(run, _OUT_DDL)
