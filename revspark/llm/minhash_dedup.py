"""Near-duplicate detection by one-permutation MinHash (operator 9).

A document's set holds its distinct word shingles.  One hash of each shingle
fills BINS bins (the smallest hash per bin); empty bins copy the first filled
bin of a fixed random order of their own (optimal densification).  ROWS bins
make a band; documents that share a band's key meet in a bucket.  Documents
with the same set are one class from the start, spoken for by one of them.

Candidate edges are star-shaped: each bucket member is compared with one
centre only, so a bucket of n gives n - 1 pairs.  A star can miss a link
between two members that are both unlike the centre.  Therefore buckets whose
members end in different components are looked at once more: the members
outside the bucket's largest component meet all members in blocks of bounded
size, where pairs of different components are compared in memory (each pair in
the first band it shares only) and just the links found come out.  Buckets
with a single component, nearly all, need no second look, so no link that
could join two components is lost.  All links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import byte_batches, id_text, stored, worker_cache
from revspark.llm.components import components

BINS = 128
ROWS = 4
#: Band keys from BINS bins: 32 bands of 4 rows meet at similarity 0.8 with
#: probability 1 - (1 - 0.8 ** 4) ** 32 > 0.9999999.
BANDS = BINS // ROWS
#: Each of this many priorities picks the centre of a quarter of the bands.
PRIORITIES = 4
#: Members of one centre that are compared in one group.
STAR_MEMBERS = 512
#: Bucket members in one block of the second look, on average.
BLOCK = 256

#: Word hashes remembered per Python worker.
MAX_WORDS = 300_000


class _Hashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a bijection of 64-bit values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``words`` words.

    A-Z are lower-cased; words are runs of bytes that are no ASCII white
    space.  Fewer words than that make one shingle; no words, none."""
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    known = worker_cache("minhash", _Hashes)
    if len(known) > MAX_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    size = min(words, len(ws))
    n = len(ws) - size + 1
    s = np.full(n, size, np.uint64)
    for k in range(size):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(s)


def _orders() -> np.ndarray:
    """For each bin a fixed random rank of all bins: the order in which an empty bin looks for a filled one."""
    rng = np.random.default_rng(20_240_601)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


_ORDERS = _orders()
_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def band_keys(s: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of a non-empty sorted shingle set."""
    at = np.searchsorted(s, _STARTS)
    end = np.append(at[1:], len(s))
    filled = np.flatnonzero(at < end)
    take = filled[_ORDERS[:, filled].argmin(axis=1)]
    own = np.arange(BINS)
    take = np.where(at < end, own, take)
    sig = s[at[take]].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
    return key


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, keys = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(t, words)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "digest", "keys"])
    return run


def _confirm(words: int, percent: int):
    """Rows sorted so that a centre's text comes before its members' texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for b in batches:
            groups, salts, members, texts = (b.column(i).to_pylist() for i in range(4))
            a_out, b_out, ok = [], [], []
            for g, salt, m, t in zip(groups, salts, members, texts):
                s = shingle_set(t, words)
                if m is None:
                    centre, own = (g, salt), s
                    continue
                if centre != (g, salt):
                    raise ValueError("a centre's text is missing")
                both = len(np.intersect1d(own, s, assume_unique=True))
                a_out.append(g)
                b_out.append(m)
                ok.append(100 * both >= percent * (len(own) + len(s) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])
    return run


def _compare(edges: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, ok) of the candidate edges (centre a, member b), on full sets.

    A centre's members are cut into groups of STAR_MEMBERS, each with a copy
    of the centre's text, so a centre with very many members is many tasks'
    work.  Texts move once per edge end."""
    large = stored(edges.groupBy("a").agg(F.ceil(F.count("*") / STAR_MEMBERS).alias("salts")).filter("salts > 1"), "large-stars")
    salted = stored(edges.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt")), "star-edges")
    roles = salted.select("a", "salt", F.col("b").alias("rep"), F.col("b").alias("member")).unionByName(
        salted.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("rep"), F.lit(None).cast("long").alias("member")))
    withtext = roles.join(texts.hint("merge"), "rep").select("a", "salt", "member", "text")
    return (withtext.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("member").asc_nulls_first())
            .mapInArrow(_confirm(words, percent), "a long, b long, ok boolean"))


def _block_links(words: int, percent: int):
    """Links between different components of a block of one or more buckets: odd members against all members."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(odd: pa.Table, members: pa.Table) -> pa.Table:
        m_text, o_text = members.column("text"), odd.column("text")
        m_rep, m_size = members.column("rep").to_numpy(), members.column("size").to_numpy()
        m_key, m_keys = members.column("key").to_numpy(), _key_matrix(members)
        # Components as small numbers; a link found here makes two of them one.
        names, parts = np.unique(np.concatenate([members.column("comp").to_numpy(), odd.column("comp").to_numpy()]), return_inverse=True)
        m_part, o_part = parts[:len(m_rep)], parts[len(m_rep):]
        now = np.arange(len(names))
        order = np.argsort(m_key, kind="stable")
        sorted_keys = m_key[order]
        sets: dict[int, np.ndarray] = {}

        def of(rep: int, text: pa.Scalar) -> np.ndarray:
            if rep not in sets:
                sets[rep] = shingle_set(text.as_py(), words)
            return sets[rep]

        links = []
        rows = zip(odd.column("key").to_pylist(), odd.column("rep").to_pylist(), odd.column("size").to_pylist(), o_part.tolist(), _key_matrix(odd))
        for k, (key, rep, size, part, keys) in enumerate(rows):
            at = order[np.searchsorted(sorted_keys, key):np.searchsorted(sorted_keys, key, "right")]
            at = at[now[m_part[at]] != now[part]]
            at = at[100 * np.minimum(m_size[at], size) >= percent * np.maximum(m_size[at], size)]
            # Each pair counts in the first band it shares only.
            band = int(np.flatnonzero(keys == key)[0])
            at = at[(m_keys[at] == keys).argmax(axis=1) == band]
            for j in at.tolist():
                if now[m_part[j]] == now[part]:
                    continue
                mine, other = of(rep, o_text[k]), of(int(m_rep[j]), m_text[j])
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    links.append((rep, int(m_rep[j])))
                    now[now == now[part]] = now[m_part[j]]
        cols = list(zip(*links)) if links else [[], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)
    return run


def _key_matrix(rows: pa.Table) -> np.ndarray:
    col = rows.column("keys").combine_chunks()
    flat = (pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col).flatten()
    return flat.to_numpy().reshape(rows.num_rows, BANDS)


def _rest(buckets: DataFrame, comp: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between members of one bucket that are still in different components.

    Large buckets are cut into blocks of about BLOCK members, small ones
    gathered; a cell is one block of odd members with one block of all."""
    named = buckets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    parts = named.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    tops = (parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n"))
            .filter("parts > 1").select("key", F.col("top.comp").alias("top"), "n", (F.col("n") - F.col("top.n")).alias("odd")))
    mixed = stored(named.join(tops, "key"), "mixed-buckets")
    groups = max(1, mixed.count() // BLOCK)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    cell = F.when(F.col("n") > BLOCK, F.col("key")).otherwise(F.pmod("key", F.lit(groups)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.greatest(blocks(n), F.lit(1)) - 1)).alias(name)
    own = lambda n, name: F.pmod(F.xxhash64("rep"), F.greatest(blocks(n), F.lit(1))).cast("int").alias(name)
    full = mixed.withColumn("cell", cell).join(texts.hint("merge"), "rep")
    cols = [F.col(c).alias(c) for c in ("cell", "key", "rep", "size", "comp", "keys", "text")]
    odd = full.filter("comp <> top").select(*cols, own("odd", "i"), every("n", "j"))
    members = full.select(*cols, every("odd", "i"), own("n", "j"))
    by = ["cell", "i", "j"]
    return odd.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(_block_links(words, percent), "a long, b long")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their
    shingle sets; component_id is the smallest id reachable over links, kept
    is doc_id = component_id.  Null, empty and white texts have an empty set
    and are linked with nothing.  A null id takes no part in links and keeps
    itself (component_id null, kept true).  Every row's own text takes part; rows
    that repeat an id are linked through it.  Other columns are never read.  An
    empty table gives an empty result."""
    spark = docs.sparkSession
    byte_batches(spark)
    base = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    feats = stored(base.select("doc_id", "text", "text_key").mapInArrow(_features(words), "doc_id long, text_key long, n_shingles long, digest binary, keys array<long>"), "minhash")

    # Equal sets: one class with a number of its own, spoken for by one of its rows.
    usable = feats.filter("doc_id is not null and digest is not null")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    classes = usable.groupBy("digest").agg(first, F.first("keys").alias("keys"), F.first("n_shingles").alias("size"))
    reps = stored(classes.select("digest", "first.*", "keys", "size", F.monotonically_increasing_id().alias("rep")), "classes")

    # Classes of rows that share an id, rarely any: linked through the smallest of them.
    ids = stored(usable.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.count("*").alias("n"))
                 .filter("n > 1").select("doc_id", "least", (F.col("least") != F.col("most")).alias("differ")), "repeated-ids")
    named = reps.select("digest", "rep")
    split = usable.select("doc_id", "digest").join(ids.filter("differ").select("doc_id", "least"), "doc_id").filter("digest <> least").select("digest", "least").distinct()
    same = (split.join(named.withColumnRenamed("rep", "b"), "digest")
            .join(named.select(F.col("digest").alias("least"), F.col("rep").alias("a")), "least").select("a", "b"))

    # One row per (bucket, class); buckets with a single class are gone.
    slots = reps.select("rep", "size", F.posexplode("keys").alias("band", "key"))
    rank = F.when(F.col("band") % PRIORITIES == 0, F.col("rep")).otherwise(F.xxhash64("rep", F.col("band") % PRIORITIES))
    slots = slots.select("key", "rep", "size", rank.alias("rank"))
    # written, so that the join deals both sides out itself and a bucket with very many members can be split
    centre = stored(slots.groupBy("key").agg(F.min(F.struct("rank", "rep", "size")).alias("c"), F.count("*").alias("n")).filter("n > 1"), "centres")
    buckets = stored(slots.join(centre.select("key", "c"), "key").select("key", "rep", "size", F.col("c.rep").alias("centre"), F.col("c.size").alias("csize")), "buckets")

    # The texts that can be compared move once, each class's by one row of its own.
    one = base.groupBy("doc_id", "text_key").agg(F.first("text").alias("text")) if not ids.isEmpty() else base
    near = buckets.select("rep").distinct().join(reps.select("rep", "doc_id", "text_key", "keys"), "rep")
    texts = stored(one.hint("merge").join(near, ["doc_id", "text_key"]).select("rep", "keys", F.col("text").cast("binary").alias("text")), "near-texts")

    fits = (F.least("size", "csize") * 100 >= F.greatest("size", "csize") * percent) & (F.col("rep") != F.col("centre"))
    edges = stored(buckets.filter(fits).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "edges")
    links = stored(_compare(edges, texts, words, percent).filter("ok").select("a", "b"), "links").unionByName(same)
    comp = stored(components(links), "components")
    rest = stored(_rest(buckets.select("key", "rep", "size"), comp, texts, words, percent), "links")
    if not rest.isEmpty():
        comp = stored(components(links.unionByName(rest)), "components")
    # The smallest id of each component, back to its classes and their rows.
    placed = reps.select("digest", "doc_id", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = stored(placed.select("digest", "component").join(smallest, "component").select("digest", "component_id"), "classes-placed")
    mine = F.when(F.col("doc_id").isNotNull(), F.col("digest"))
    out = feats.select("doc_id", "n_shingles", mine.alias("digest")).join(found, "digest", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
