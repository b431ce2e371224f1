"""Operators 7, 8 and 9 against brute force on texts with every awkward case."""
import hashlib
import random
import re
from collections import Counter, defaultdict

from revspark.llm import exact_dedup, minhash_dedup, suffix_dedup
from revspark.llm.components import components


def test_exact_dedup_equals_grouping(messy):
    groups = defaultdict(list)
    rows = [(r.doc_id, r.text or "") for r in messy.select("doc_id", "text").collect()]
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    want = Counter()
    for n, g in groups.items():
        best = min(g)
        for c, i in g:
            want[i, best[1], len(g), hashlib.sha256(n.encode()).hexdigest()] += 1
    got = exact_dedup.exact_dedup(messy).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(n.encode()).hexdigest() for n in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_one_hot_text_and_null_ids(spark):
    rows = [(i, "same  text" if i % 7 else "same text") for i in range(3000)] + [(None, "same text  "), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = exact_dedup.exact_dedup(df).collect()
    hot = [r for r in got if r.group_size == 3001]
    assert len(got) == 3002 and len(hot) == 3001
    # "same text  " is the longest, but a row without an id.
    assert [r.doc_id for r in hot if r.kept] == [None] and {r.keep_id for r in hot} == {None}


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


def brute_near(rows, words, percent):
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        n = min(words, len(ws))
        sets[i] = {tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)} if ws else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_near(df, words):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute_near(rows, words, 80)
    got = minhash_dedup.near_dedup(df, words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_equals_all_pairs(unique_messy):
    check_near(unique_messy, 4)


def test_near_dedup_finds_links_that_stars_miss(spark):
    # A chain: neighbours are similar, but few are similar to any one centre.
    rng = random.Random(3)
    ws = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(60):
        rows.append((1000 - k, " ".join(ws)))
        for _ in range(2):
            ws[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
    check_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4)


def test_near_dedup_repeated_rows_null_ids_and_empty(spark, messy, empty):
    got = minhash_dedup.near_dedup(messy.select("doc_id", "text").union(spark.createDataFrame([(None, "one"), (None, None)], "doc_id long, text string"))).collect()
    assert len(got) == messy.count() + 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert len({r.component_id for r in got if r.doc_id == 3}) == 1
    assert minhash_dedup.near_dedup(empty).collect() == []


def test_near_dedup_of_an_id_with_several_texts(spark):
    """Each row's own text takes part, and the id links them: 7 joins the near copies of both of its texts."""
    rng = random.Random(9)
    one, two = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    near = lambda ws: " ".join([*ws[:-1], "other"])
    rows = [(7, " ".join(one)), (7, " ".join(two)), (7, " ".join(two)), (9, near(one)), (5, near(two)), (11, "something else"), (12, None), (12, "x")]
    got = minhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (5, 5, True), (7, 5, False), (7, 5, False), (7, 5, False), (9, 5, False), (11, 11, True), (12, 12, True), (12, 12, True)]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 200)] + [(500, k) for k in range(501, 600)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 201)} | {k: 500 for k in range(500, 600)}


def test_remove_repeats_equals_brute_force(messy, empty):
    rows = messy.select("doc_id", "text").collect()
    count = Counter(b[k:k + 200] for b in ((r.text or "").encode() for r in rows) for k in range(len(b) - 199))
    want = Counter()
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        spans = tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))
        want[r.doc_id, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    got = suffix_dedup.remove_repeats(messy).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == want
    assert any(r.spans for r in got)
    assert suffix_dedup.remove_repeats(empty).collect() == []
