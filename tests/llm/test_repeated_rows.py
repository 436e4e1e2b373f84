"""Ids that repeat or are null, hot groups and chains of links."""

import random

import brute
import numpy as np
import pytest
from test_llm import SCHEMA, by_id, made, odd_rows

from palisade.llm import exact_dedup, license_scan, ngram_join, packed, substring_dedup, suffix_dedup, toxicity
from palisade.llm.components import components, forest


def shared_ids():
    r = random.Random(12)
    words = [f"w{k}" for k in range(200)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    p, q = text(50), text(60)
    return [(1, p), (2, text(9) + " " + p), (2, "short"), (2, p + " " + q), (2, p + " " + q), (3, q + " " + q), (3, "x" + q), (4, None), (None, p), (None, q)]


@pytest.mark.parametrize("parts", [1, 6])
def test_rows_with_one_id_and_different_texts(spark, parts):
    rows = shared_ids()
    df = made(spark, rows).repartition(parts)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffix_dedup.suffix_dedup(df).collect()]
    assert sorted(got, key=key) == sorted(((d, *x) for (d, _), x in zip(rows, brute.bytes_removed_by_row(rows), strict=True)), key=key)
    got = [(x["doc_id"], x["n_words"], x["n_removed"]) for x in substring_dedup.substring_dedup(df).collect()]
    assert sorted(got, key=key) == sorted(((d, *x) for (d, _), x in zip(rows, brute.words_removed_by_row(rows), strict=True)), key=key)
    known = [(k, t) for k, (d, t) in enumerate(rows) if d is not None]
    number = {k: rows[k][0] for k, _ in known}
    plain = brute.similar(known)
    least = {}
    for k, (_, c) in plain.items():
        least[c] = min(least.get(c, number[k]), number[k])
    want = [(number[k], n, least[c]) for k, (n, c) in plain.items()] + [(None, brute.similar([(0, t)])[0][0], None) for d, t in rows if d is None]
    got = [(x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_join(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_layout_tells_ids_of_several_texts_and_sizes(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a" * 400), (1, "a" * 400), (2, "b")], "doc_id long, text string")
    assert packed.layout(df) == packed.Layout(8, True)
    assert not packed.layout(df.unionByName(spark.createDataFrame([(2, "c")], df.schema))).unique
    monkeypatch.setattr(packed, "BUCKET_BYTES", 50)
    assert packed.layout(df).buckets == 17


def test_split_anchors(spark):
    r = random.Random(2)
    line = "a line of some sixty bytes that stands in nearly every document."
    some = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    rows = [(k, some(r.randint(0, 90)) + line + some(r.randint(20, 90))) for k in range(80)]
    rows += [(80 + k, rows[k][1][10:] + some(30)) for k in range(0, 60, 3)] + [(200, line * 3), (201, "x" + line * 2)]
    for bytes_of_shard in (1, 2000):
        got = suffix_dedup.suffix_dedup(made(spark, rows).repartition(3), shard_bytes=bytes_of_shard)
        assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.bytes_removed(rows)
    rows = odd_rows()[:-1]
    assert by_id(suffix_dedup.suffix_dedup(made(spark, rows), shard_bytes=500), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.bytes_removed(rows)


@pytest.mark.parametrize("order", ["shuffled", "sorted", "zigzag"])
def test_components_of_long_chains(spark, order):
    ids = list(range(7, 2007))
    if order == "shuffled":
        random.Random(3).shuffle(ids)
    if order == "zigzag":
        ids = [x for pair in zip(ids[:1000], ids[:999:-1], strict=True) for x in pair]
    links = list(zip(ids, ids[1:], strict=False)) + [(5000, 5001), (5001, 5000), (5002, None), (6, 6)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 7 for k in ids}, 5000: 5000, 5001: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join_of_a_chain_of_revisions(spark):
    r = random.Random(4)
    words = [f"v{k}" for k in range(60 + 6 * 250)]
    ids = list(range(250))
    r.shuffle(ids)
    rows = [(d, " ".join(words[6 * k : 6 * k + 60])) for k, d in enumerate(ids)]
    assert by_id(ngram_join.ngram_join(made(spark, rows)), "n_shingles", "component_id") == brute.similar(rows)


def test_exact_dedup_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 5)
    rows = [(k, "the same text") for k in range(300)] + odd_rows()[:40][::-1]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert by_id(exact_dedup.exact_dedup(made(spark, rows)), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)


def odd_stage_rows(spark):
    rows = [
        (5, "one text", "en"), (3, "one  text", "en"), (None, "one text", "en"), (None, "alone without an id", "en"), (7, "twice the same row", "de"),
        (7, "twice the same row", "de"), (8, "an id for two texts", "en"), (8, "the other text of that id", "en"), (9, "an id for two texts", "en"), (10, None, "en"), (11, "", "fr"),
    ]
    return spark.createDataFrame([(d, t, x, None, None, "h", b"y", 1.0) for d, t, x in rows], SCHEMA)


def test_survivors_of_exact_dedup_keep_one_row_of_each_text(spark):
    kept = exact_dedup.survivors(odd_stage_rows(spark))
    assert kept.columns == odd_stage_rows(spark).columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == [(0, "alone without an id"), (3, "one  text"), (7, "twice the same row"), (8, "an id for two texts"), (8, "the other text of that id"), (10, "")]
    assert exact_dedup.survivors(made(spark, [])).count() == 0


def test_survivors_of_the_join_keep_one_row_of_each_component(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long), (4, long + " x"), (2, long + " y"), (2, "other words of the same id stand here"), (None, "no id and no partner at all"), (6, None), (6, "")]
    kept = ngram_join.survivors(made(spark, rows))
    assert kept.columns == made(spark, []).columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == [(0, "no id and no partner at all"), (2, "other words of the same id stand here"), (2, long + " y"), (6, ""), (6, "")]
    unique = ngram_join.survivors(made(spark, [(1, long), (2, long + " z"), (3, "q")]))
    assert sorted(r["doc_id"] for r in unique.collect()) == [1, 3]
    assert ngram_join.survivors(made(spark, [])).count() == 0


def test_words_of_unspaced_scripts_and_long_words():
    import numpy as np

    def words(text):
        raw = text.encode()
        low, start, end, _ = toxicity.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [bytes(low[s:e]).decode(errors="replace") for s, e in zip(start, end, strict=True)]

    assert words("One\u2014two \u201cthree\u201d \u3001four\uff01 \xa1five") == ["one", "two", "three", "four", "five"]
    assert words("abcdefghijklmnopqrstu") == ["abcdefghijklm", "ghijklmnopqrs", "mnopqrstu"]
    run = "\u6f22\u5b57" * 40
    seen = words(run)
    assert sum(len(w.encode(errors="replace")) for w in seen) >= len(run.encode()) and len(seen) > 30


def test_needles_are_in_all_that_can_be_confirmed():
    r = random.Random(6)
    needles = license_scan.needles()
    for texts in license_scan.TEMPLATES.values():
        for text in texts.split("\n"):
            words = license_scan._words(text)
            pairs = sorted(set(zip(words, words[1:], strict=False)))
            for _ in range(200):
                held = r.sample(pairs, -(-3 * len(pairs) // 4))
                assert any(n in " ".join(" ".join(p) for p in held) for n in needles)


def test_licences_against_a_plain_comparison(spark):
    """Parts of notices, wrapped and not: what is found shares the bigrams of a template, and whole templates are found."""
    rows, want = [], {}
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts.split("\n"):
            words = text.split()
            wrapped = "\n".join(" ".join(words[k : k + 7]) for k in range(0, len(words), 7))
            for form in (text, "Note.\n\n" + wrapped + "\n\nEnd."):
                want[len(rows)] = family
                rows.append((len(rows), form))
            for start in range(0, max(len(words) - 4, 1), 4):
                rows.append((len(rows), " ".join(words[start : start + 5])))
    family_of = lambda name: name and max((f for f in license_scan.TEMPLATES if name.startswith(f)), key=len)  # noqa: E731  without its version
    got = {x["doc_id"]: family_of(x["license"]) for x in license_scan.scan_licences(made(spark, rows)).collect()}
    right = sum(got[k] == family for k, family in want.items())
    assert right >= 0.97 * len(want), {rows[k][1]: (got[k], f) for k, f in want.items() if got[k] != f}
    for k, family in got.items():
        if family is not None:
            own = license_scan._words(rows[k][1])
            pairs = set(zip(own, own[1:], strict=False))
            shares = []
            for text in license_scan.TEMPLATES[family].split("\n"):
                words = license_scan._words(text)
                template = set(zip(words, words[1:], strict=False))
                shares.append(len(template & pairs) / len(template))
            assert max(shares) >= license_scan.CONFIRM
    sentences = license_scan.held_out_rows()
    model = license_scan.fit_licences(spark)
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(sentences)], "k int, line string")
    best = {r["k"]: r["b"] for r in df.select("k", model.best(license_scan.words_of(df["line"])).alias("b")).collect()}
    judged = [best[k]["family"] if best[k]["p"] >= model.threshold else license_scan.UNKNOWN for k in range(len(sentences))]
    assert sum(a == b for a, (b, _) in zip(judged, sentences, strict=True)) >= 0.85 * len(sentences)


def test_forest_connects_what_its_links_connect():
    r = np.random.default_rng(5)
    for n in [0, *range(1, 60)]:
        ends = r.integers(0, 50, (2, n))
        a, b = np.maximum(*ends), np.minimum(*ends)
        least = {int(v): int(v) for v in np.append(a, b)}
        for _ in range(n):  # labels fall along the links until they stay
            for u, v in zip(a.tolist(), b.tolist(), strict=True):
                least[u] = least[v] = min(least[u], least[v])
        apart = a != b
        assert dict(zip(*map(np.ndarray.tolist, forest(a[apart], b[apart])), strict=True)) == {u: v for u, v in least.items() if u != v}
