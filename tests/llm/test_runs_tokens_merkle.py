"""Operators 11, 12 and 13 against brute force."""
import glob
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from revspark.llm import merkle, runs, token_store
from revspark.llm.common import shared_path

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = "doc_id long, text string, pid long, n int, pos long, node string, runs string, part int, ids string, start long"


def brute_runs(w):
    known = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                known[i, j + p] = min(p, known.get((i, j + p), p))
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in known.items())


def repetitive(rng):
    """A word list with planted periods, periods inside periods, and almost equal units."""
    n, k = rng.randint(1, 500), rng.choice([1, 2, 2, 3, 10, 1000])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 5)):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
        unit = [rng.randrange(k) for _ in range(p)]
        if rng.random() < 0.5:
            z, cut = rng.randint(1, max(1, p // 6)), rng.randint(0, p)
            unit = [unit[i % z] if i < cut else unit[i] for i in range(p)]
        if rng.random() < 0.3 and p > 2:
            unit = [0] * (p - 1) + [1]
        for i in range(min(rng.randint(p, 6 * p), n - a)):
            w[a + i] = unit[i % p]
    return w


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        w = repetitive(rng)
        assert runs.find_runs(np.array(w, np.int64)) == brute_runs(w), w


def test_runs_of_structured_words():
    for w in (fibonacci(700), [bin(i).count("1") % 2 for i in range(600)], [0] * 300, ([0] * 40 + [1]) * 8, ([0, 1] * 30 + [1]) * 5, [0] * 23, [0] * 24, list(range(9)) * 3, list(range(9)) * 2):
        assert runs.find_runs(np.array(w, np.int64)) == brute_runs(w)


def planted(doc_id, ws):
    """The contract's reordering, word by word."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(ws)
    if h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def test_periodic_runs_over_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(map(str, repetitive(rng)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (None, "a b " * 20), (104, "a b " * 20), (104, "a b " * 20), (105, "A a " * 12), (106, "x y " * 24), (107, "word " * 3000)]
    df = spark.createDataFrame([(*r, *[None] * 8) for r in rows], AWKWARD).repartition(5)
    got = runs.periodic_runs(df, runs.planted_order).collect()
    want = []
    for i, t in rows:
        ws = (t or "").encode().split()
        ws = planted(i, ws) if i is not None else ws
        rs = brute_runs(ws)
        best = max(rs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        out = {k for s, n, q in rs for k in range(s + q, s + n)}
        digest = hashlib.sha256(b" ".join(x for k, x in enumerate(ws) if k not in out)).hexdigest()
        want.append((i, len(ws), rs, *best, digest))
    key = repr
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], *r[3:]) for r in got), key=key) == sorted(want, key=key)
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_do_not_change_runs(spark, monkeypatch):
    rows = [(k, ("p%d q r " % (k % 3)) * (k + 1)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(map(repr, runs.periodic_runs(df).collect()))
    monkeypatch.setattr(runs, "GROUP_WORDS", 50)
    texts = [t.encode().split() for _, t in rows]
    one_by_one = [runs._group([i], [ws]).to_pylist()[0] for (i, _), ws in zip(rows, texts)]
    assert len(whole) == len(one_by_one)
    assert sorted(r["collapsed_sha256"] for r in one_by_one) == sorted(r.collapsed_sha256 for r in runs.periodic_runs(df).collect())


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_FILE)
    return {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [token_store.END_ID], "<u4") for i, t in rows}


def test_token_store_equals_library(spark):
    rng = random.Random(3)
    rows = [(k * 7 - 50, " ".join(rng.choice(["alpha", "Beta", "gamma3", "déjà", "日本"]) for _ in range(rng.randint(0, 90)))) for k in range(300)]
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "<|endoftext|> x"), (9005, "long " * 30_000), (2**53 + 1, "big id")]
    df = spark.createDataFrame([(*r, *[None] * 8) for r in rows], AWKWARD).repartition(6)
    path = shared_path(spark, "store-test")
    token_store.write_tokens(df, path, WORD_FILE)
    ids, start, want = brute_tokens(rows), 0, []
    for i in sorted(ids):
        want.append((i, start, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        start += len(ids[i])
    assert sorted(map(tuple, token_store.checksums(spark, path).collect())) == want
    assert sorted(map(tuple, token_store.read_metadata(spark, path).collect())) == [w[:3] for w in want]
    some = {r.doc_id: list(r.ids) for r in token_store.read_documents(spark, path, -20, 60).collect()}
    assert some == {i: ids[i].tolist() for i in ids if -20 <= i <= 60}
    # The files, one after the other, hold the ids in ascending order of documents.
    files = sorted(glob.glob(path.replace("file://", "").replace("file:", "") + "/tokens/*.parquet"))
    found = [pq.read_table(f, partitioning=None) for f in files]
    assert [i for t in found for i in t["doc_id"].to_pylist()] == sorted(ids)


def test_token_store_layout(spark, tmp_path):
    """Dictionary ids, delta columns, page indexes, small row groups; a metadata read leaves the ids alone."""
    docs = spark.range(0, 60_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 977).cast("string")) for k in range(1, 40)]).alias("text"))
    path = shared_path(spark, "store-layout")
    token_store.write_tokens(docs.coalesce(1), path, WORD_FILE)
    files = sorted(glob.glob(path.replace("file://", "").replace("file:", "") + "/tokens/*.parquet"))
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            assert "RLE_DICTIONARY" in cols["ids.list.element"].encodings
            assert all("DELTA_BINARY_PACKED" in cols[c].encodings for c in ("doc_id", "local_start", "n_tokens"))
            assert all(c.has_offset_index for c in cols.values()) and cols["doc_id"].has_column_index
            assert cols["ids.list.element"].total_uncompressed_size <= 2 * token_store.ROW_GROUP_BYTES
    plan = token_store.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    few = token_store.read_documents(spark, path, 100, 110)
    assert "GreaterThanOrEqual(doc_id,100)" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 11


def test_token_store_repeated_ids_and_empty(spark):
    rows = [(1, "b c"), (1, "a"), (1, "a"), (None, "first"), (None, None), (0, "zero")]
    path = shared_path(spark, "store-ties")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, WORD_FILE)
    got = sorted(token_store.read_metadata(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 0, 1, 1, 1]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(6)]
    empty = shared_path(spark, "store-empty")
    token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, WORD_FILE)
    assert token_store.checksums(spark, empty).collect() == [] and token_store.read_index(spark, empty).collect() == []


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def plain_leaf(*values):
    return sha(b"".join(b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in values))


def plain_tree(nodes):
    """(root, siblings of each leaf) node by node."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a - a % 8
            sides[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1:run + 8])))
            at[i] = a // 8
        nodes = [sha("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], sides


def plain_manifest(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r[0], r[1], r[2], r[3], r[4]))):
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([plain_leaf(*r) for r in groups[g]]) for g in langs}
    root, tops = plain_tree([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for r, own in zip(groups[g], trees[g][1]):
            sides = own + tops[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered and r[4] is not None else r[4]
            h = plain_leaf(*r[:4], text)
            for a, b in sides:
                h = sha(a + h + b)
            out.append((r[0], plain_leaf(*r), trees[g][0], root, sha("".join(a + b for a, b in sides)), h, h == root))
    return sorted(out, key=repr)


def registered(df):
    bad = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    out = merkle.verify(merkle.manifest(df, bad)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, out.collect()), key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def test_merkle_equals_plain_tree(spark):
    """Groups of one leaf, of one block, of several blocks with a last block of one leaf; null, empty and repeated values."""
    rows = [(k, "s", "big", k, f"Text {k}") for k in range(merkle.BLOCK * 2 + 1)]
    rows += [(5000 + k, None, None, None, "Null Lang" if k % 2 else None) for k in range(9)]
    rows += [(7000 + k, "", "", 0, "") for k in range(8)]
    rows += [(8000, "s", "one", 1, "Alone"), (8001, "s", "é", 1, "ÉTÉ A"), (8002, "s", "\U0001f600", 1, "x" * 40_000)]
    rows += [(9000, "s", "rep", 1, "Same")] * 20 + [(9001, "s", "rep", 1, "a"), (9001, "s", "rep", 1, "B"), (None, "s", "rep", 1, "No Id"), (None, "s", "rep", 2, "No Id")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, *[1] * 4) for r in rows], DOCS + ", grp long, pos long, node long, root long").repartition(7)
    assert registered(df) == plain_manifest(rows)


def test_merkle_of_one_row_and_none(spark):
    rows = [(3, None, None, None, None)]
    assert registered(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)
    assert registered(spark.createDataFrame([], DOCS)) == []
