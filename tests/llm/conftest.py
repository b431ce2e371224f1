import random

import pytest

#: Column names that operators use inside; an input may have them too.
CLASH = "sha string, norm string, rep long, keys string, key string, score string, rank int, kept string, n int, text_sha256 string, pii string, label int, pos int"


def prose(rng: random.Random, n: int, stems: str = "abcdefgh") -> str:
    """n invented words, some with a full stop."""
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "", "."]) for _ in range(n))


def messy_texts() -> list[tuple]:
    """(doc_id, text): prose, copies, near copies, shared passages, nulls, empties, long and odd texts, repeated rows."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(12)]
    passage = prose(rng, 60)
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0] + " "), (22, " " + base[0].replace(" ", "\n")), (23, base[1])]
    for k in range(8):
        ws = base[2].split()
        ws[rng.randrange(len(ws))] = "changed"
        rows.append((30 + k, " ".join(ws)))
    rows += [(40, prose(rng, 30) + passage + prose(rng, 30)), (41, passage + prose(rng, 5)), (42, prose(rng, 9) + passage)]
    rows += [(50, None), (51, ""), (52, " \n\t"), (53, None), (54, "one"), (55, "One"), (56, "two words"), (57, "é ß 日本 \U0001f600 İ Σ"), (58, "a" * 700), (59, "ab" * 300)]
    rows += [(60, prose(rng, 9000)), (61, prose(rng, 4096)), (62, "x" * 5000)]
    rows += [(3, base[3]), (54, "one")]
    rows += [(70, "<|endoftext|> it's </s> [INST]"), (71, "word\x1cword\x85word\xa0word"), (72, "!!!" * 40)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    """messy_texts() over several partitions, with extra columns of clashing names."""
    names = [c.split()[0] for c in CLASH.split(", ")]
    rows = [(*r, *[None] * len(names)) for r in messy_texts()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(5).cache()


@pytest.fixture(scope="session")
def unique_messy(spark):
    """messy_texts() with one row per id."""
    rows = list({r[0]: r for r in messy_texts()}.values())
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
