"""Operators 1, 3 and 6 against plain Python; their plans hold no Python."""
import datetime as dt
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revspark.llm import chat, licenses, pii


def plan(df):
    return df._jdf.queryExecution().toString()


def test_chat_round_trip_and_mask(spark):
    rng = random.Random(4)
    bits = [*chat.CONTROL, chat.ESC, chat.ESC + "1", chat.ESC + "0", "<", "|", "\n", "[", "a", " ", "é", "\U0001f600"]
    rows = []
    for c in [1, 2, None, 4]:
        for t in range(rng.randint(1, 12)):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", "x\ny", None]), rng.choice([text, None, ""]), 1))
    rows += [(5, None, "user", "tie", 2), (5, 1, "user", "b", 3), (5, 1, "user", "a", 4), (5, 1, "user", "a", 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf int").repartition(3)
    got = chat.read_back(chat.format_trees(chat.linear(df))).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        one = [r for r in got if r.conv_id == c]
        assert len(one) == 1 and [(t.role, t.text) for t in one[0].turns] == want
        assert one[0].loss_text == "".join(t for r, t in want if r == "assistant")
        body = one[0].formatted.replace(chat.START, "").replace(chat.END, "")
        assert not any(x in body for x in chat.CONTROL)
        assert one[0].formatted.count(chat.START) == len(want)


def test_chat_ranks_branches_of_a_tree(spark):
    #      1 -> 2 -> 4 (score 5) ; 1 -> 3 -> 5 -> 6 ; 3 -> 7 ; 8 is a root of its own with a missing parent
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "c", 5.0),
            (1, 5, 3, "user", "d", 1.0), (1, 6, 5, "assistant", "e", 1.0), (1, 7, 3, "user", "f", None), (1, 8, 99, "user", "g", 0.5)]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = chat.read_back(chat.format_trees(df, branches=3)).collect()
    assert {r.branch: (r.leaf, r.score, [t.text for t in r.turns]) for r in got} == {
        1: (4, 7.0, ["q", "a", "c"]), 2: (6, 5.0, ["q", "b", "d", "e"]), 3: (7, 3.0, ["q", "b", "f"])}
    loop = spark.createDataFrame([(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0)], df.schema)
    with pytest.raises(ValueError):
        chat.format_trees(loop)
    assert chat.format_trees(df.limit(0)).collect() == []


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert not re.search("Python|Pandas|Arrow", plan(chat.read_back(chat.format_trees(chat.linear(df)))))


def brute_words(t):
    return [w for w in re.split(r"[\W_]+", t.lower()) if w]


def brute_shingles(ws):
    return {tuple(ws[k:k + 3]) for k in range(len(ws) - 2)} if len(ws) >= 3 else {tuple(ws)} if ws else set()


def test_licenses_are_found_where_they_are(spark, messy, empty):
    rng = random.Random(8)
    rows, want = [(0, None), (1, ""), (2, "license"), (3, "Licensed under")], {}
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        for n in (0, 1, 50, 700):
            filler = [" ".join(rng.choice(["lorem", "ipsum", "under", "the", "dolor"]) for _ in range(n)) for _ in range(2)]
            rows.append((1000 * (k + 1) + n, f"{filler[0]} {text.upper() if n == 1 else text}\n{filler[1]}"))
            want[1000 * (k + 1) + n] = name
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "t").union(messy.select("doc_id", "text").filter("doc_id in (50, 51, 60)"))
    out = licenses.scan(df, licenses.templates(spark))
    assert not re.search("Python|Pandas|Arrow", plan(out))
    got = {(r.doc_id, r.license_id): r for r in out.collect()}
    assert all((i, name) in got and got[i, name].containment == 1.0 for i, name in want.items())
    for (i, name), r in got.items():
        have = brute_shingles(brute_words(dict(rows)[i]))
        best = max(len(have & t) / len(t) for t in (brute_shingles(brute_words(x)) for n, x in licenses.TEMPLATES if n == name))
        assert 0.8 <= r.containment <= best
    assert licenses.scan(empty, licenses.templates(spark)).collect() == []


#: What a license line in a text looks like, apart from the templates.
LICENSE_LINE = r"(?i)licen[cs]|rights reserved|copyright|permission is|free software|public domain"


def test_each_license_line_of_the_documents_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = licenses.scan(docs, licenses.templates(spark)).select("doc_id").distinct()
    lines = docs.selectExpr("doc_id", "explode(split(text, '\\n')) line").filter(F.col("line").rlike(LICENSE_LINE) & (F.length("line") < 200))
    assert {r.line for r in lines.select("line").distinct().collect()} >= {"All rights reserved."}
    assert [r.line for r in lines.join(found, "doc_id", "left_anti").select("line").distinct().collect()] == []


def test_common_license_headers_are_found_and_told_apart(spark):
    gnu = ("This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n"
           " * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.")
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    cases = [
        ("Copyright (c) 2020 Someone. All rights reserved.", {"All-Rights-Reserved"}),
        ("Licensed under the MIT License", {"MIT"}),
        (gnu.format("", 3), {"GPL", "GPL-family"}), (gnu.format("Lesser ", 3), {"LGPL", "GPL-family"}), (gnu.format("Affero ", 3), {"AGPL", "GPL-family"}),
        ("released as GNU General Public License version 2", {"GPL-2.0"}), ("released as GNU General Public License, version 3", {"GPL-3.0"}),
        (f"{isc}, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"", {"ISC"}),
        (f"{isc}.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"", {"0BSD"}),
        ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at", {"EPL"}),
        ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
        ("# SPDX-License-Identifier: BSD-3-Clause", {"BSD-3-Clause"}), ("# SPDX-License-Identifier: MIT", {"MIT"}),
        ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", set()),
        ("all rights are reserved for the license of the mind", set()),
    ]
    df = spark.createDataFrame([(k, f"x y z {t} a b c") for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {}
    for r in licenses.scan(df, licenses.templates(spark)).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
    assert [got.get(k, set()) for k in range(len(cases))] == [want for _, want in cases]


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pii_keeps_formats_and_links(spark):
    cards = ["4111111111111111", "4111-1111-1111-1111", "378282246310005", "3782 822463 10005", "6011000990139424"]
    fixed = ["4111111111111112", "2001-02-30", "000-12-1234", "256.1.1.1", "version 2.0.", "password=e3b3ed3cc8548923d6", "2.0.1"]
    private = ["und.34@mail7.example.com", "élan.5@mail.example.org", "+1 (017) 555-7713", "212-555-1234", "97.51.17.173", "123-45-6789", "1999-12-31", "31.12.1999", "31/12/1999", "1999/12/31", *cards]
    rows = [(1, " ; ".join(private)), (2, " ; ".join(reversed(private))), (3, " ; ".join(fixed)), (4, None), (5, ""), (6, "x" * 50_000 + "@"), (7, "1 " * 20_000), (1, " ; ".join(private))]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, kind string")
    out = pii.pseudonymise(df, "k")
    assert not re.search("Python|Pandas|Arrow", plan(out))
    got = {r.doc_id: r for r in out.collect()}
    new = got[1].text.split(" ; ")
    assert dict(zip(private, new)) == dict(zip(reversed(private), got[2].text.split(" ; ")))
    for old, x in zip(private, new):
        assert x != old and len(x) == len(old)
        assert [c.isdigit() for c in x] == [c.isdigit() for c in old]
    digits = [re.sub(r"\D", "", x) for x in new[-len(cards):]]
    assert all(map(luhn, digits)) and digits[0] == digits[1] and digits[2] == digits[3]
    assert new[6].split("-") == new[7].split(".")[::-1] == new[8].split("/")[::-1] == new[9].split("/")
    assert all(0 <= int(o) <= 255 for o in new[4].split("."))
    assert [got[k].text for k in range(3, 8)] == [r[1] for r in rows[2:7]] and got[3].kind == "kept"
    assert [x.kind for x in got[1].pii] == ["email"] * 2 + ["phone"] * 2 + ["ip", "ssn"] + ["date"] * 4 + ["card"] * 5
    assert pii.pseudonymise(df, "other key").filter("doc_id = 1").first().text != got[1].text
    assert pii.pseudonymise(df.limit(0), "k").collect() == []


def test_pii_permutations_are_one_to_one(spark):
    ssn = [f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 665, 667, 899) for b in (1, 99) for c in range(1, 40)]
    dates = [f"{y}-{m:02d}-28" for y in range(1950, 1970) for m in range(1, 13)]
    phones = [f"200-300-{k:04d}" for k in range(300)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ssn + dates + phones)], "doc_id long, text string")
    got = [r.text for r in pii.pseudonymise(df, "k").collect()]
    assert len(set(got)) == len(got)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in got[:len(ssn)])
    assert spark.createDataFrame([(x,) for x in got[len(ssn):len(ssn) + len(dates)]], "d string").selectExpr("count(try_cast(d AS DATE)) n").first().n == len(dates)


def test_pii_month_day_dates(spark):
    days = [dt.date(1800, 1, 1) + dt.timedelta(days=k) for k in [*range(0, 1500), *range(72_900, 73_600), *range(145_000, 146_097)]]
    late = [f"{d:%m/%d}/{d.year:04d}" for d in days if d.day > 12]
    stay = ["13/32/1999", "02/30/2001", "02/29/1999", "12/31/1799", "00/13/1999"]
    df = spark.createDataFrame([(k, f"on {x}, so") for k, x in enumerate(["12/31/1999", *late, *stay])], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    new = [got[k].text[3:-4] for k in range(len(got))]
    changed, left = new[:1 + len(late)], new[1 + len(late):]
    assert left == stay and changed[0] != "12/31/1999"
    assert len(set(changed[1:])) == len(late)
    for x in changed:
        month, day, year = map(int, x.split("/"))
        assert re.fullmatch(r"\d\d/\d\d/\d{4}", x) and day > 12 and dt.date(year, month, day) and 1800 <= year < 2200
    assert sum(x != y for x, y in zip(late, changed[1:])) > 0.99 * len(late) and got[0].pii[0].kind == "date"


def test_pii_month_day_numbering_is_whole(spark):
    # Every number of a day after the 12th finds its month among the five that are looked at.
    first = [(dt.date(1800 + k // 12, k % 12 + 1, 1) - dt.date(1800, 1, 1)).days - 12 * k for k in range(4800)] + [9 * 9833]
    assert first[4800] == 146_097 - 4800 * 12
    for k in range(4800):
        assert all(k - 2 <= int(j / 18.436875) <= k + 2 for j in (first[k], first[k + 1] - 1))


def test_pii_international_phones(spark):
    private = ["+44 20 7946 0958", "+33 1 42 68 53 00", "+15551234567", "+49 (0)30 1234567", "+353 1 234 5678", "+33.1.42.68.53.00",
               "+1 555 123 4567", "+1 (555) 123-4567", "+34 912\u00a0345\u202f678", "+7-495-123-45-67", "+4930/1234567", "+298 12345"]
    cards = ["4111-1111-1111-1111"]
    fixed = ["+1234567", "+1234567890123456", "a+12345678", "1+12345678", "++12345678", "+0123456789"]
    rows = [(1, "; ".join(private)), (2, "; ".join(fixed)), (3, f"+{cards[0]}"), (4, "tel:" + private[0] + ". 90 people")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    new = got[1].text.split("; ")
    code = ["44", "33", "1", "49", "353", "33", "1", "1", "34", "7", "49", "298"]
    for old, x, c in zip(private, new, code):
        assert x != old and re.sub(r"\d", "#", x) == re.sub(r"\d", "#", old) and x.startswith(f"+{c}")
    assert [x.kind for x in got[1].pii] == ["phone"] * len(private)
    digits = [re.sub(r"\D", "", x) for x in new]
    assert digits[2] == digits[6] == digits[7] and digits[1] == digits[5]
    assert got[2].text == rows[1][1]
    assert [x.kind for x in got[3].pii] == ["card"]
    assert got[4].text == f"tel:{new[0]}. 90 people"


def test_registered_chat_digests(spark):
    from revspark.llm import queries

    out = {r.conv_id: r for r in queries.op1_chat(spark, "/root/testdata/sf0.001").collect()}
    text = queries.CONTROL_TEXT
    assert out[-1].n_turns == 2 and out[-1].loss_chars == len(text)
    assert out[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert out[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert Counter(out.keys()).most_common(1)[0][1] == 1
