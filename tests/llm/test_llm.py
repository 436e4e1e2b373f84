"""The training-data operators against plain versions, on the smallest table and on odd rows."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import bytetools, decontamination, exact_dedup, license_scan, mixing, ngram_join, prefix_tree, registry
from palisade.llm import substring_dedup, suffix_array, suffix_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, at binary, score double"


def made(spark, rows):
    """Rows with further columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(d, t, "en", None, None, "x", b"y", 1.0) for d, t in rows], SCHEMA)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def odd_rows():
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    base = [r.choice(words) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "One  two"), (7, "é" * 300), (8, "é" * 300 + "x")]
    rows += [(9, "-" * 500), (10, " ".join(base)), (11, "  ".join(base))]
    for k in range(12, 40):  # near copies and shared passages
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(len(w))] = f"n{k}{r.randrange(9)}"
        rows.append((k, " ".join(w[k % 7 :] + base[: k % 3 * 20])))
    rows += [(k, "a common line that stands in each of these many documents for sure. " * 2 + " ".join(r.choice(words) for _ in range(30))) for k in range(40, 70)]
    rows.append((70, " ".join(r.choice(words) for _ in range(60_000))))  # very long
    return rows


def test_exact_dedup_odd_rows_and_collisions(spark):
    rows, cols = odd_rows(), ("keep_id", "group_size", "kept", "text_sha256")
    assert by_id(exact_dedup.exact_dedup(made(spark, rows)), *cols) == brute.exact(rows)
    weak = lambda c: F.md5(F.substring(c, 1, 1))  # noqa: E731  many collisions
    assert by_id(exact_dedup.exact_dedup(made(spark, rows), content_hash=weak), *cols) == brute.exact(rows)
    assert exact_dedup.exact_dedup(made(spark, [])).count() == 0
    twice = exact_dedup.exact_dedup(made(spark, [(1, "a"), (1, "a"), (2, "a"), (None, "a")])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in twice) == [(0, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False)]


def test_suffix_dedup(spark, data):
    rows = odd_rows()[:-1] + [(70, odd_rows()[-1][1][:4000])]
    got = by_id(suffix_dedup.suffix_dedup(made(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.bytes_removed(rows)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = by_id(registry.op4_suffix_dedup(spark, data), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.bytes_removed([tuple(r) for r in docs.collect()])
    assert suffix_dedup.suffix_dedup(made(spark, [])).count() == 0
    nameless = suffix_dedup.suffix_dedup(made(spark, [(None, "x" * 300), (1, "x" * 300), (1, "x" * 300)])).collect()
    # the run of one letter repeats within its own text, but not in the row that repeats it
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in nameless) == [(0, 0), (1, 299), (1, 299)]


def test_suffix_dedup_of_repeated_rows_in_one_slice(spark):
    r = random.Random(8)
    own = ["".join(r.choice("abcdefghijklmnop ") for _ in range(600)) for _ in range(3)]
    rows = [(1, own[0]), (1, own[0]), (2, own[1] + own[0]), (3, own[2]), (3, own[2])]
    for parts in (1, 5):
        got = suffix_dedup.suffix_dedup(made(spark, rows).repartition(parts).coalesce(parts)).collect()
        assert sorted((x["doc_id"], x["n_removed"]) for x in got) == [(1, 0), (1, 0), (2, 600), (3, 0), (3, 0)]


def test_substring_dedup(spark, data):
    rows, cols = odd_rows(), ("n_words", "n_removed", "kept_sha256")
    assert by_id(substring_dedup.substring_dedup(made(spark, rows)), *cols) == brute.words_removed(rows)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert by_id(registry.op9_substring_dedup(spark, data), *cols) == brute.words_removed([tuple(r) for r in docs.collect()])
    assert substring_dedup.substring_dedup(made(spark, [])).count() == 0
    same = " ".join(f"w{k}" for k in range(20))
    nameless = substring_dedup.substring_dedup(made(spark, [(None, same), (2, same), (2, same), (3, same)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in nameless) == [(0, 0), (2, 0), (2, 0), (3, 20)]


def test_ngram_join(spark, data):
    rows, cols = odd_rows(), ("n_shingles", "component_id")
    assert by_id(ngram_join.ngram_join(made(spark, rows)), *cols) == brute.similar(rows)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert by_id(registry.op5_ngram_join(spark, data), *cols) == brute.similar([tuple(r) for r in docs.collect()])
    assert ngram_join.ngram_join(made(spark, [])).count() == 0
    odd = ngram_join.ngram_join(made(spark, [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "A B c d  e")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in odd) == [(0, 1, None), (2, 1, 2), (2, 1, 2), (3, 1, 2)]


def test_ngram_join_of_a_large_group_in_blocks(spark):
    r = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        w[r.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(w)))
    # another group with the same words at its start, of texts that are similar to few others
    for k in range(60, 110):
        rows.append((k, " ".join(base[:12] + [f"y{(k + j) // 3}" for j in range(20)])))
    for block in (2, 6, 16):
        assert by_id(ngram_join.ngram_join(made(spark, rows), block=block), "n_shingles", "component_id") == brute.similar(rows)


def test_meetings_bring_all_pairs_together():
    for main, rest in ((1, 30), (20, 11), (31, 0), (5, 2), (17, 17)):
        for block in (2, 4, 8):
            own = [(doc, int(doc >= main)) for doc in range(main + rest)]
            at = {doc: set(ngram_join.meetings_of(doc, main, rest, side, block, 0)) for doc, side in own}
            for doc, side in own:
                for other, its in own:
                    assert at[doc] & at[other] or side == its == 0  # those of one label needn't meet
            assert all(len(list(ngram_join.meetings_of(doc, main, rest, side, block, 1))) == 1 for doc, side in own)


def test_prefix_tree_finds_all_similar_sets(monkeypatch):
    r = random.Random(1)
    for turn in range(60):
        monkeypatch.setattr(prefix_tree, "RUN", (1 << 20, 1, 25)[turn % 3])
        sets = [set(r.sample(range(30), r.randint(1, 20))) for _ in range(r.randint(2, 12))]
        sets += [set(s) ^ {r.randrange(30)} for s in sets[:3]]
        sets = [s or {1} for s in sets]
        alone = [r.randrange(3) for _ in sets]
        sizes = np.array([len(s) + a for s, a in zip(sets, alone, strict=True)])
        tree = prefix_tree.PrefixTree(
            np.concatenate([np.array(sorted(s)) for s in sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), sizes, 80
        )
        for x, s in enumerate(sets):
            want = {y for y, t in enumerate(sets) if 100 * len(s & t) >= 80 * (sizes[x] + sizes[y] - len(s & t))}
            assert set(tree.similar(x).tolist()) == want


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(0)
    for t in range(300):
        s = np.append(r.integers(1, r.integers(2, 6), r.integers(0, 80)), 0)
        suffix_array.BUCKET_ENTRIES = (400, 0, 10**9)[t % 3]
        sa = suffix_array.suffix_array(s, int(s.max()) + 1)
        flat = s.tolist()
        assert sa.tolist() == sorted(range(len(flat)), key=lambda i: flat[i:])
        text = (s[:-1]).astype(np.uint8)
        at = np.flatnonzero(r.random(len(text)) < 0.7)
        got = suffix_array.permuted_prefixes(text, sa, at, 9)
        rank = {int(p): k for k, p in enumerate(sa)}
        for p, n in zip(at.tolist(), got.tolist(), strict=True):
            q, k = int(sa[rank[p] - 1]), 0
            while k < 9 and p + k < len(text) and q + k < len(text) and text[p + k] == text[q + k]:
                k += 1
            assert n == k or (p + n > len(text) or q + n > len(text))
    suffix_array.BUCKET_ENTRIES = 400


def test_least_distances_are_exact():
    r = random.Random(1)
    some = lambda n: bytes(r.choice(b"abc") for _ in range(n))
    for _ in range(25):
        items, texts = [some(r.choice((1, 5, 12, 63, 64, 65, 130))) for _ in range(6)], [some(r.randint(0, 90)) for _ in range(20)]
        high = np.cumsum([len(t) for t in texts])
        which = np.array([r.randrange(6) for _ in texts])
        size = np.array([len(items[k]) for k in which])
        got, end = decontamination.least_distances(items, which, np.frombuffer(b"".join(texts) + b"x", np.uint8), high - [len(t) for t in texts], high, size)
        for k, t in enumerate(texts):
            want = brute.edit_distance_within(items[which[k]], t)
            assert min(got[k], size[k]) == want
            ends = [e for e in range(len(t) + 1) if brute.edit_distance_within(items[which[k]], t[:e]) == want]
            assert end[k] == (ends[0] if want < size[k] else end[k])


def edited(text, rate, r):
    out = []
    for word in text.split():
        out.append("".join(r.sample("abcdefghij", min(len(word), 9))) if r.random() < rate else word)
    return " ".join(out)


def test_decontamination_recall_and_precision(spark, data):
    items = [tuple(x) for x in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    r = random.Random(2)
    pad = "Some other words stand here, which no item has. " * 3
    rows = [(k, pad + edited(t, 0.12, r).upper() + " " + pad) for k, t in items] + [(1000 + k, pad) for k in range(5)] + [(2000, None), (2001, ""), (2002, items[0][1])]
    got = {(x["doc_id"], x["item_id"]): x["edit_distance"] for x in decontamination.find_leaks(made(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    low = {k: " ".join(t.split()).translate(brute.LOW).encode() for k, t in items}
    should = {}
    for d, t in rows:
        if t and d < 1000:
            distance = brute.edit_distance_within(low[d], " ".join(t.split()).translate(brute.LOW).encode())
            if distance <= 0.2 * len(low[d]):
                should[d, d] = distance
    assert len(should) >= 20 and len(should.keys() & got.keys()) >= 0.95 * len(should)
    assert all(got[k] == v for k, v in should.items() if k in got)
    assert (2002, items[0][0]) in got and not any(d >= 1000 and d != 2002 for d, _ in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(made(spark, rows[:3]), none).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "twenty four bytes of it"), (5, " ? "), (6, "shirt")], "item_id long, text string")
    found = decontamination.find_leaks(made(spark, [(1, "here Twenty four\nbytes of it are"), (2, "x" * 3000 + "(shore)" + "y" * 2000), (3, "why? " * 3)]), odd).collect()
    assert sorted((x["doc_id"], x["item_id"], x["edit_distance"]) for x in found) == [(1, 4, 0), (2, 3, 1), (3, 5, 0)]


def test_decontamination_in_unspaced_and_bracketed_text(spark):
    r = random.Random(9)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    run = lambda n: "".join(r.choice(signs) for _ in range(n))
    items = [(k, run(40)) for k in range(20)] + [(20, "Donaudampfschifffahrt"), (21, "supercalifragilistic words follow it here")]
    rows = [(k, run(300) + t + run(200)) for k, t in items[:20]] + [(20, 'so "(Donaudampfschifffahrt)" it is'), (21, "[supercalifragilistic words follow it here]"), (30, run(2000))]
    got = {(x["doc_id"], x["item_id"], x["edit_distance"]) for x in decontamination.find_leaks(made(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k, 0) for k, _ in items}


def test_decontaminated_judges_each_row_by_its_text(spark):
    items = spark.createDataFrame([(1, "one long sentence that must not stand in the corpus")], "item_id long, text string")
    leak = "See: one long sentence that must not stand in the corpus."
    rows = [(None, leak), (None, "clean"), (1, leak), (1, "clean too"), (2, None), (3, "")]
    kept = decontamination.decontaminated(made(spark, rows), items)
    assert kept.columns == made(spark, []).columns
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in kept.collect()) == [(0, "clean"), (1, "clean too"), (2, ""), (3, "")]


def test_decontamination_recall_at_edited_characters(spark, data):
    items = [tuple(x) for x in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    edit = lambda c, rate: c if r.random() >= rate else r.choice(("", r.choice(letters), c + r.choice(letters)))
    low = {k: " ".join(t.split()).translate(brute.LOW) for k, t in items}
    index = decontamination.ItemIndex(items, decontamination.SIMILARITY, decontamination.REPETITIONS)
    bands = {b: [0, 0] for b in range(4)}  # of the true distance, a twentieth of the length each
    for rate in (0.03, 0.08, 0.12, 0.15, 0.18, 0.2, 0.22, 0.24):
        for k, t in items:
            text = ("words before it " + "".join(edit(c, rate) for c in t) + " words after it").encode()
            item = low[k].encode()
            d = brute.edit_distance_within(item, " ".join(text.decode().split()).translate(brute.LOW).encode())
            if d <= 0.2 * len(item):
                tally = bands[min(int(d / len(item) * 20), 3)]
                found = {i: x for _, i, x, _ in index.find(np.frombuffer(text, np.uint8), np.array([0, len(text)]))}
                own = [n for n, (i, _) in enumerate(items) if i == k][0]
                tally[0] += own in found
                tally[1] += 1
                assert found.get(own, d) == d
    assert all(many >= 15 and got >= 0.9 * many for got, many in bands.values())


def test_urls(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme/en/"), (4, "http://A.Example.COM/en/71?x"), (5, "https://example.com/en/9"), (6, "https://x.example.net/de/8"),
        (7, "https://x.example.net/de/7#a/de/8"), (8, "http://q.org/es/"), (9, "http://notexample.com.au/en/"), (10, "ftp://big-casino.example.org/x"), (11, "http://library.example.org?u=://y/z"),
    ]
    df = spark.createDataFrame([(k, u, "clash", 1.0) for k, u in urls], "page_id long, url string, host string, score double")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    assert [(got[k]["host"], got[k]["path"]) for k in (1, 2, 3)] == [("", "")] * 3
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert (got[5]["rule"], got[5]["verdict"]) == ("com/en/", "block")
    assert (got[6]["rule"], got[7]["rule"], got[7]["path"]) == ("example.net/de/8", "net/de/", "/de/7")
    assert got[8]["rule"] == "org/es/" and got[9]["rule"] is None
    assert got[10]["verdict"] == "block" and (got[11]["host"], got[11]["path"], got[11]["verdict"]) == ("library.example.org", "", "allow")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_model_on_names_it_has_not_seen(spark):
    model = url_filter.fit_url_model(url_filter.labelled_urls(spark))
    new = [
        ("https://www.casino-palace.net/fr/5", 1), ("http://pillsdirect.org/", 1), ("https://big-poker-room.example.com/x", 1), ("https://a.spamhub.io", 1),
        ("https://site.example.org/online-casino/buy-pills", 1), ("https://page.net/en/free-porn-videos", 1), ("https://home.de/a/warez-and-keygens.html", 1),
        ("https://gardens.org/", 0), ("https://www.townhall.fr/fr/5", 0), ("https://oldbooks.net/de/48.html", 0), ("https://universities.com/en/1", 0),
        ("https://site.example.org/museums/opening-hours", 0), ("https://page.net/en/newspaper-archives", 0), ("https://home.de/cooking/bread.html", 0),
        ("https://example.net/linguistics/essay-2", 0), ("https://cyclists.info/", 0),
    ]
    df = spark.createDataFrame([(k, u, y) for k, (u, y) in enumerate(new)], "page_id long, url string, y int")
    got = {r["page_id"]: r["verdict"] == "block" for r in url_filter.filter_urls(df, rules=(), model=model).collect()}
    assert sum(got[k] == bool(y) for k, (_, y) in enumerate(new)) >= len(new) - 2


def test_urls_against_plain_rules(spark, data):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()]
    got = {r["page_id"]: r for r in registry.op1_url_filter(spark, data).collect()}
    assert len(got) == len(pages)
    for page, url in pages:
        host, path = brute.host_and_path(url)
        fit = [(r[1] + r[2], r[0]) for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, None)
        row = got[page]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or ("block" if row["score"] >= 0.5 else "allow"))


def test_licences(spark):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, "His driving license was suspended."),
        (4, None), (5, ""), (6, "All rights reserved.\nLicensed under CC BY-NC 4.0."), (7, "This work is licensed under the GNU General Public License, version 3."),
        (8, "The licensed premises are open and the copyright office is near."), (9, "x " * 30_000 + "\nReleased under the MIT License."),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licences(made(spark, rows)).collect()}
    assert [got[k]["license"] for k in (1, 2, 3, 4, 5, 7, 8, 9)] == ["Apache-2.0", "MIT", None, None, None, "GPL-3.0", None, "MIT"]
    assert got[6]["families"] == "CC-BY-NC-4.0,Proprietary" and got[6]["n_paragraphs"] == 2
    assert got[3]["n_unknown"] == 1 and license_scan.scan_licences(made(spark, [])).count() == 0


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
"""


def test_wrapped_licences(spark):
    prose = "The weather was fine and nobody at the lake wanted to go home before the evening.\n"
    texts = {"MIT": MIT_TEXT, "GPL-3.0": GPL_TEXT, "BSD": BSD_TEXT, "Apache-2.0": APACHE_TEXT}
    rows, want = [], {}
    for family, t in texts.items():
        for form in (t, prose + "\n" + t + "\n" + prose, t.replace("\n", "\r\n"), "# " + t.replace("\n", "\n# "), prose * 9 + t + prose * 9, (prose * 9 + t + prose * 9).replace("\n", " ")):
            want[len(rows)] = family
            rows.append((len(rows), form))
    got = {r["doc_id"]: r for r in license_scan.scan_licences(made(spark, rows)).collect()}
    assert {k: got[k]["license"] for k in want} == want
    plain = [(1, "The licence\nof the driver\nwas lost.\n" + prose * 20), (2, "He asked\npermission to go.\n\n" + prose)]
    assert [(r["license"], r["n_paragraphs"], r["n_unknown"]) for r in license_scan.scan_licences(made(spark, plain)).orderBy("doc_id").collect()] == [(None, 0, 1)] * 2


def test_token_counts_equal_the_public_library(spark, data):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    pieces = token_counts.read_vocabulary()
    unknown = [p for p, _ in pieces].index("<unk>")
    theirs = Tokenizer(Unigram(pieces, unk_id=unknown, byte_fallback=True))
    theirs.pre_tokenizer = Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += ["", "日本語 ☃ x", "a" * 3000, "naïve Ünïcode\t\ttabs\nlines", "<s> </s> ▁", "🙂🙂 🙂a"]
    rows = list(enumerate(texts)) + [(10**6, None)]
    got = by_id(token_counts.token_counts(made(spark, rows)), "n_words", "n_tokens")
    for k, t in enumerate(texts):
        want = len(theirs.encode(" ".join(brute.WORD.findall(t)), add_special_tokens=False).tokens) if t.strip() else 0
        assert got[k] == (len(brute.WORD.findall(t)), want), t[:60]
    assert got[10**6] == (0, 0) and token_counts.token_counts(made(spark, [])).count() == 0


def test_token_ties_without_byte_fallback():
    count = token_counts.ViterbiCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -3.0)], byte_fallback=False)
    assert count.of_word("ab") == 1  # equal scores: the longest last piece was tried first
    assert count.of_word("axxb") == 4  # adjacent unknown characters fuse


def test_mixing(spark):
    rows = [(k, f"t{k}", "en", f"s{k % 3}" if k % 5 else None, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_sources(df, target_ratio=1.5)
    again = mixing.mix_sources(df.repartition(7), target_ratio=1.5)
    key = lambda r: (r["doc_id"], r["copy"], r["n_copies"], r["shuffle_key"], r["text"])
    a, b = sorted(map(key, got.collect())), sorted(map(key, again.collect()))
    assert a == b and abs(len(a) - 4500) < 300
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), ("s9", 5.0)], "source string, weight double")
    by_source = {r[0]: r[1] for r in mixing.mix_sources(df, weights=weights).groupBy("source").count().collect()}
    assert set(by_source) == {"s0", "s1"} and 2.2 < by_source["s0"] / by_source["s1"] < 4
    large = mixing.mix_sources(df.limit(3), target_ratio=900.0).count()  # several draws a document
    assert abs(large - 2700) < 300
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(k, "t", f"s{k % 2}", "a", 1, "b", 2.0, 3) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, parts string, cdf int, rate string, _source double, copy int")
    got = mixing.mix_sources(df)
    assert got.columns == ["doc_id", "text", "source", "parts", "cdf", "rate", "_source", "n_copies", "copy", "shuffle_key"]
    assert {(r["parts"], r["cdf"], r["rate"], r["_source"]) for r in got.collect()} == {("a", 1, "b", 2.0)}


def test_poisson_is_inverted(spark):
    from math import exp, factorial

    got = spark.range(1).select(mixing.poisson_cdf(F.lit(2.5)).alias("c")).first()["c"]
    assert got[3] == pytest.approx(sum(exp(-2.5) * 2.5**k / factorial(k) for k in range(4))) and got[-1] == pytest.approx(1.0)


def test_toxicity_gradients():
    net = toxicity.Network(1)
    r = np.random.default_rng(0)
    for k in ("word", "gram"):
        net.p[k] = r.standard_normal(net.p[k].shape).astype(np.float64) * 0.3
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    word, grams = r.integers(1, 50, 9), r.integers(1, 50, (9, 4))
    codes, y = r.integers(0, 10, (5, toxicity.WINDOW)), np.array([1, 0, 1, 0, 1.0])

    def loss():
        x, _ = net.inputs(word, grams)
        z = net.logits(x.astype(np.float64), codes).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = net.gradients(word, grams, codes, y)
    for name, at in (("uf", (2, 5)), ("ub", (1, 20)), ("wf", (3, 7)), ("att", (4, 0)), ("out", (9, 0)), ("c", (0,)), ("word", (int(word[0]), 1))):
        was, e = net.p[name][at], 0.02
        net.p[name][at] = was + e
        up = loss()
        net.p[name][at] = was - e
        down = loss()
        net.p[name][at] = was
        assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_toxicity_held_out_accuracy(spark):
    r = random.Random(4)
    bad, good = ["grobbet", "vilstain", "mockworm", "scumlet"], [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(700):
        w = [r.choice(good) for _ in range(r.randint(5, 150))]
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "s", "!", "ed"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "!!! 123"), (1003, " ".join(r.choice(good) for _ in range(30_000)))]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.judge_toxicity(made(spark, rows), table).collect()}
    assert len(got) == len(rows)
    out = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (k in set(out)) for k, _ in labels)
    right = sum(got[k]["predicted"] == labels[k][1] for k in out)
    assert right >= 0.95 * len(out)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())
    assert [got[k]["predicted"] for k in (1000, 1001, 1002)] == [0, 0, 0]
    clean = toxicity.clean_documents(made(spark, rows), table)
    assert clean.columns == made(spark, []).columns and {x["doc_id"] for x in clean.select("doc_id").collect()} == {k for k, x in got.items() if not x["predicted"]}
    assert toxicity.judge_toxicity(made(spark, []), table).count() == 0


def test_bytes_and_words():
    import pyarrow as pa

    col = pa.array(["a  b", None, "", " é\tc ", "x"])
    seen = [(row, end, bytes(b), off.tolist()) for row, end, b, off in bytetools.text_slices(col, most=5)]
    assert sum(end - row for row, end, _, _ in seen) == 5 and b"".join(b for *_, b, _ in seen) == "a  b é\tc x".encode()
    b = np.frombuffer(b"ab cdab", np.uint8)
    start, end, text = bytetools.spans(bytetools.not_space(b), np.array([0, 5, 7]))
    assert (start.tolist(), end.tolist(), text.tolist()) == ([0, 3, 5], [2, 5, 7], [0, 0, 1])
    h = bytetools.span_hashes(b, start, end)
    assert h[0] == h[2] != h[1]
