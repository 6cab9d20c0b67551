"""Licences, revisits, quality rules, URL filter and decontamination against brute force."""

import hashlib
import math
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bloom, decontaminate, licenses, quality_rules, url_filter, warc
from lodestone.llm.queries import QUERIES, crawl_records

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words_of(text):
    return WORD.findall(lower(text))


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


# licences

PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
LICENSED = [
    None, "", "MIT License, MIT LICENSE. mit-license? mit licensed", "CC BY cc by-nc 4.0 under CC  BY\nCC BY",
    "Licensed under the Apache License, Version 2.0 and the GNU General Public License, version 3 or later",
    "éMIT License", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU Affero General Public License v3", "mit license " * 3000,
]


def base_places(text):
    words = words_of(text)
    found = []
    for label, phrase in PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), found


def test_license_base(spark, sf, tmp_path):
    rows = [(d["doc_id"], d["text"]) for d in table(sf, "documents")] + [(10_000 + i, t) for i, t in enumerate(LICENSED)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(rows)
    for r in QUERIES["op1_license_scan"](spark, str(tmp_path)).collect():
        n, found = base_places(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(found))
        assert r["first_word"] == min((i for i, _ in found), default=None)
        assert r["last_word"] == max((i for i, _ in found), default=None)
        base = sorted({label for _, label in found})
        assert r["base_labels"] == ",".join(base)
        labels = r["labels"].split(",") if r["labels"] else []
        assert set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= r["score"] <= 1
        if r["doc_id"] == 10_004:
            assert {"apache-2.0", "gpl-3.0"} <= set(labels)
        if r["doc_id"] == 10_006:
            assert labels == ["gpl-3.0-or-later"]


def minimal_text(pattern, branch, most):
    """A text that a rule's pattern matches: one branch of each choice, with all that is optional or nothing of it."""

    def text(parsed):
        out = ""
        for kind, arg in parsed:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "NOT_LITERAL":
                out += "x"
            elif kind == "IN":
                first, value = arg[0]
                out += "x" if str(first) == "NEGATE" else chr(value if str(first) == "LITERAL" else value[0])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, body = arg
                out += text(body) * (low if not most or low else 1)
            elif kind == "SUBPATTERN":
                out += text(arg[-1])
            elif kind != "ASSERT_NOT":
                assert kind == "BRANCH", kind
                out += text(arg[1][min(branch, len(arg[1]) - 1)])
        return out

    return text(re._parser.parse(pattern))


def test_every_license_rule_fires(spark):
    rows = [(r.label, minimal_text(r.pattern, b, m)) for r in licenses.RULES for b in range(3) for m in (False, True)]
    rows += [("0bsd", "Distributed under 0BSD"), ("0bsd", "zero-clause BSD"), ("mit-0", "MIT No Attribution"), ("openrail-m", "Open RAIL-M")]
    rows = [(a, b) for a, b in dict.fromkeys(rows)]
    missed = []
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "label string, text string"), "found").collect():
        if r["label"] not in {s["label"] for s in r["found"]}:
            missed.append((r["label"], r["text"]))
    assert not missed


NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including": {"mit"},
    "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided that the following conditions are met:\n 3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software": {"bsd", "bsd-3-clause"},
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": {"isc"},
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": {"0bsd"},
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": {"gpl-3.0-or-later"},
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': {"apache-2.0"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2.0"},
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.": {"zlib"},
    "Released as GPLv3+": {"gpl-3.0"}, "see the GNU GPL": {"gpl"}, "LGPL v2.1 or so": {"lgpl-2.1"}, "Apache-2.0": {"apache-2.0"},
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "No part of this publication may be reproduced": {"proprietary"},
    "free software lovers published a document on permission": set(),
}


def test_license_texts(spark):
    df = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    for r in licenses.scan_licenses(df, "found").collect():
        kept = {s["label"] for s in r["found"] if s["kept"] or s["base"]}
        assert (NOTICES[r["text"]] <= kept) and (kept or not NOTICES[r["text"]]), (r["text"], kept)
        assert NOTICES[r["text"]] or not kept
    assert len(licenses.RULES) > 400 and len(licenses.TEXTS) > 80


def test_license_suppression(spark):
    df = spark.createDataFrame([("x licensed under the mit license y", "a")], "text string, licenses string")
    spans = licenses.scan_licenses(df).first()["_licenses"]
    kept = {(s["label"], s["start"], s["end"]) for s in spans if s["kept"]}
    assert kept == {("mit", 1, 6)}
    assert any(s["base"] and not s["kept"] for s in spans)
    assert len(licenses.RULES) > 250
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_every_rule_passes_the_gate():
    for r in licenses.RULES:
        assert any(g.strip() in f" {r.pattern} " or g.strip() in r.keyword for g in licenses.GATE), r


# quality rules


def base_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit |= {j for i in places for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_base(spark, sf):
    odd = [None, "", "a b c d e f g h " * 40, "x\n\nx\n \nx y\nx", "é\u00a0# <b> | $\t\x0b%&*", "w " * 5000, "\r\n".join(["one two three four five six seven eight nine"] * 4)]
    rows = [(d["doc_id"], d["text"]) for d in table(sf, "documents")] + [(10_000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "kept long, text string")
    texts = dict(rows)
    for r in quality_rules.quality_measures(df).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == base_measures(texts[r["_doc"]["kept"]])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.keep_good(df).columns == ["kept", "text"]


def test_quality_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(sf, "labels")}
    for r in QUERIES["op6_quality_rules"](spark, sf).collect():
        if labels.get(r["doc_id"]) == 1:
            assert r["kept"] == (not r["base_failed"])


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    got = spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()["d"]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


# URLs


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = lower(re.match("[^/?#]*", rest)[0])
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules(spark, sf):
    odd = [None, "", "no scheme", "http://", "HTTP://A.ORG", "x://y.Example.ORG/es/?q", "http://example.org/en/1", "http://example.org/en/2", "http://fr.com/fr/#x", "a://b://c.com/de/", "http://notexample.org/es/", "https://www.spam-farm.example.net:443/x"]
    rows = [(p["page_id"], p["url"]) for p in table(sf, "pages")] + [(10_000 + i, u) for i, u in enumerate(odd)]
    df = spark.createDataFrame([(i, u, "z", 1) for i, u in rows + rows[:5]], "page_id long, url string, Host string, _best int")
    listed_rules, listed = url_filter.default_list(spark)
    out = url_filter.judge_urls(df, listed_rules, listed).collect()
    assert len(out) == len(rows) + 5
    urls = dict(rows)
    for r in out:
        host, path, rule, verdict = judge(urls[r["page_id"]])
        assert (r["_host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict in (None, r["verdict"]) and r["verdict"] in ("allow", "block")
    assert {r["page_id"]: r["verdict"] for r in out}[10_011] == "block"
    assert url_filter.judge_urls(df, listed_rules.limit(0), listed.limit(0)).where("verdict = 'block'").count() == 0


def test_bloom_loses_no_key(spark):
    keys = spark.range(3000).select((F.col("id") * 2).cast("string").alias("k"))
    every = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    for most in (1 << 16, 256, 16):
        some = every.where(bloom.build(keys, "k", most).may_contain(F.col("k")))
        assert some.where("cast(k as long) % 2 = 0").count() == 3000
        assert some.count() < 3100 if most > 256 else some.count() <= 6000
    assert bloom.build(keys, "k", 16).words is None
    few = bloom.build(keys.limit(20), "k")
    assert every.where(few.may_contain(F.col("k"))).count() < 200


# decontamination


def contaminated(docs, items, width=13):
    windows = {}
    for item_id, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    ids |= found
        ids = sorted(str(i) for i in ids if i is not None)
        yield doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def dropped(docs, items, width=13):
    """Of documents that a filter drops: contaminated, or a window of full width anywhere."""
    full = {tuple(w[i : i + width]) for w in (words_of(t) for _, t in items) for i in range(len(w) - width + 1)}
    for (_, text), row in zip(docs, contaminated(docs, items, width), strict=True):
        w = words_of(text)
        yield row[-1] or any(tuple(w[i : i + width]) in full for i in range(len(w) - width + 1))


@pytest.mark.parametrize("extra", [[], [(900, "the"), (901, "of the"), (902, "a b c"), (903, "one two three four five"), (904, None), (905, "..."), (906, "x " * 40), (906, "the"), (None, "of the")]])
def test_decontamination(spark, sf, tmp_path, extra):
    docs = [(d["doc_id"], d["text"]) for d in table(sf, "documents")]
    docs += [(10_000, None), (10_001, ""), (10_002, "x " * 100), (10_003, "One, two; THREE four five"), (10_003, "a b c a b c"), (10_004, "x " * 39)]
    docs += [(20_000 + i, f"start {b['text']} end") for i, b in enumerate(table(sf, "benchmark"))]
    docs += [(30_000, "long " * 3000 + table(sf, "benchmark")[3]["text"] + " text" * 70_000), (30_001, "plain words " * 50_000)]
    items = [(b["item_id"], b["text"]) for b in table(sf, "benchmark")] + extra
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in QUERIES["op10_decontamination"](spark, str(tmp_path)).collect())
    assert got == sorted(contaminated(docs, items))
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("N_Hit", F.lit("x")).withColumn("_hit", F.lit(0)).withColumn("_row", F.lit("r"))
    clean = decontaminate.keep_clean(df, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert clean.columns == df.columns and clean.count() == sum(not gone for gone in dropped(docs, items))


def test_decontamination_without_items(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    empty = spark.read.parquet(f"{sf}/benchmark.parquet").limit(0)
    assert decontaminate.keep_clean(docs, empty).count() == docs.count()


# revisits


def resolve(records):
    for r in records:
        if r["kind"] != "revisit":
            continue
        earlier = [x for x in records if x["kind"] == "response" and x["url"] == r["url"] and r["url"] is not None and None not in (x["at"], r["at"]) and (x["at"], x["record_id"]) < (r["at"], r["record_id"])]
        best = max(earlier, key=lambda x: (x["at"], x["record_id"]), default=None)
        if best is None:
            yield r["record_id"], "no_response", None
            continue
        agrees = False
        for c in ("etag", "last_modified", "digest"):
            if r[c] is not None and best[c] is not None:
                clean = [x[c].removeprefix("W/") if c == "etag" else x[c] for x in (r, best)]
                agrees = clean[0] == clean[1]
                break
        yield r["record_id"], "resolved" if agrees else "mismatch", best["record_id"] if agrees else None


def test_revisits(spark, sf):
    schema = "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>, Status string"
    import random

    rng = random.Random(5)
    rows = []
    for i in range(600):
        url = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        rows.append((i, url, rng.choice([rng.randrange(50), rng.randrange(50), None]), rng.choice(["response", "revisit"]), rng.choice(["x", "W/x", "y", None]), rng.choice(["m", "n", None]), rng.choice(["d", None]), rng.choice([{"ETag": "n", "Content-Type": "t", "etag": "o"}, None]), "s"))
    df = spark.createDataFrame(rows, schema).repartition(4)
    records = [r.asDict() for r in df.collect()]
    for slices in (1, 7, 256):
        out = warc.resolve_revisits(df, slices).collect()
        assert sorted((r["record_id"], r["_status"], r["response_id"]) for r in out) == sorted(resolve(records))
    merged = spark.range(1).select(warc.merge_headers(F.create_map(F.lit("A"), F.lit("1"), F.lit("Date"), F.lit("2")), F.create_map(F.lit("date"), F.lit("3"), F.lit("a"), F.lit("4"))).alias("m")).first()["m"]
    assert merged == {"a": "1", "date": "3"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    log = crawl_records(spark.read.parquet(f"{sf}/pages.parquet"))
    records = [r.asDict() for r in log.collect()]
    out = QUERIES["op3_warc_revisits"](spark, sf).collect()
    assert sorted((r["record_id"], r["status"], r["response_id"]) for r in out) == sorted(resolve(records))
