"""Operators 11 to 13 against plain versions, with odd rows, ties and hot groups."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import bytetools as bt
from palisade.llm import hard_negatives as hn
from palisade.llm import minhash_join as mj
from palisade.llm import prefix_tree
from palisade.llm.collocations import collocations
from palisade.llm.components import components
from palisade.llm.ngram_join import Keying, joined, lone, ngram_join, prefix_keyed


def _told(frame):
    return sorted(tuple(r) for r in frame.collect())


def _prose(r, n, vocabulary):
    return "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! "]) for _ in range(n))


def test_phrases_equal_the_plain_version(spark):
    r = random.Random(1)
    vocabulary = ["Alpha", "beta", "GAMMA", "de", "la", "\u00e9t\u00e9", "x" * 200, "a", "a", "b", "\u6771\u4eac"]
    rows = [(r.choice(["en", "de", None, "und", "x y"]), _prose(r, r.randint(0, 60), vocabulary)) for _ in range(300)]
    rows += [("en", "new york city is big")] * 40 + [("en", "a a a a a a a")] * 20 + [("de", None), (None, ""), ("en", "... !!"), ("en", "one " * 5000)]
    docs = spark.createDataFrame([(t, k, n, "x") for n, (k, t) in enumerate(rows)], "text string, lang string, name int, item string").repartition(5)
    for least, top in ((6, 2000), (6, 7), (40, 5)):
        want = brute.phrases(rows, least, top=top)
        assert want and _told(collocations(docs, least=least, top=top)) == want


def test_phrases_of_parts_of_the_candidates(spark, monkeypatch):
    r = random.Random(2)
    rows = [("en", _prose(r, 60, [f"w{k}" for k in range(12)])) for _ in range(100)]
    monkeypatch.setattr("palisade.llm.collocations.RANKED", 20)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert _told(collocations(docs, least=5, top=30)) == brute.phrases(rows, 5, top=30)


def test_phrases_without_any(spark):
    for rows in ([], [("en", "hardly a word")], [("en", "same " * 200)]):
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert _told(collocations(docs)) == brute.phrases(rows, 100)


def test_slices_of_phrases_take_a_few_bytes_a_word(spark):
    from palisade.llm.collocations import _ITEMS_SCHEMA, _SLICES, _asked_words, _sliced

    r = random.Random(4)
    rows = [("en", " ".join(f"w{r.randrange(200)}" for _ in range(500))) for _ in range(40)]
    slices = spark.createDataFrame(rows, "lang string, text string").coalesce(1).mapInArrow(_sliced(1 << 20), _SLICES)
    places, items = slices.select(F.sum(F.octet_length("at")), F.sum(F.octet_length("item"))).first()
    assert places + items < 3 * 40 * 500
    asked = slices.select("slice", "item", "keys", "lengths").mapInArrow(_asked_words(1), _ITEMS_SCHEMA)
    number, n, length = asked.select(F.octet_length("item"), F.octet_length("n"), F.octet_length("right")).first()
    assert number + n + length < 6 * 200


def test_narrow_numbers_come_back():
    from palisade.llm import packed

    for top in (0, 1, 255, 256, 65535, 65536, 2**31 - 1, 2**40, 2**63 - 1):
        for kind in (np.int32, np.int64):
            for numbers in ([], [0], [0, top, 1, top, 7]):
                if top <= np.iinfo(kind).max:
                    own = np.array(numbers, kind)
                    got = packed.from_narrow(packed.narrow(own), kind)
                    assert got.dtype == own.dtype and got.tolist() == numbers
    assert len(packed.narrow(np.array([1, 300], np.int64))) == 5
    assert packed.from_narrow(b"", np.int64).tolist() == []


def test_scores_are_exact(spark):
    from palisade.llm.collocations import _ranked

    a, left, right, n = 3_000_000_019, 5_000_000_029, 7_000_000_001, 9_000_000_000_000_001
    phrases = spark.createDataFrame([("en", "p q", a, [left, a], [right, a])], "lang string, phrase string, a long, begins array<long>, ends array<long>")
    got = _ranked(phrases, spark.createDataFrame([("en", n)], "lang string, n long"), 5).first()
    assert got["score"] == 1000 * a * n // (left * right) and got["l"] == left and got["r"] == right


def _near(r, groups, size):
    rows, n = [], 0
    for _ in range(groups):
        base = [r.choice("abcdefghijkl") * r.randint(1, 4) + str(r.randint(0, 9)) for _ in range(r.randint(3, 60))]
        for _ in range(r.randint(1, size)):
            words = [w if r.random() > 0.02 else "new" for w in base]
            rows.append((n, " ".join(words).upper() if r.random() < 0.3 else "\n".join(words)))
            n += 1
    return rows


def test_minhash_join_equals_the_plain_version(spark):
    r = random.Random(3)
    rows = _near(r, 40, 8) + [(9000, None), (9001, ""), (9002, " \t"), (9003, "One two"), (9004, "one TWO"), (9005, "w " * 3000), (9006, "w " * 2000)]
    docs = spark.createDataFrame([(t, d, "z") for d, t in rows], "text string, doc_id long, size string").repartition(4)
    got = {d: (n, c, k) for d, n, c, k in _told(mj.minhash_join(docs))}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute.similar(rows, 4).items()}


def test_minhash_join_of_a_large_group_in_blocks(spark):
    r = random.Random(4)
    rows = _near(r, 3, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {d: (n, c) for d, n, c, _ in _told(mj.minhash_join(docs, block=16))}
    assert got == brute.similar(rows, 4)


def test_minhash_join_of_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (None, text), (2, text + " nine"), (5, "other words"), (5, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, mj.minhash_join(docs).collect()), key=str)
    assert got == sorted([(1, 5, 1, True)] * 2 + [(None, 5, None, True), (2, 6, 1, False), (5, 1, 5, True), (5, 5, 1, False)], key=str)
    assert mj.minhash_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_within_the_distance_share_a_key():
    r = np.random.default_rng(5)
    for errors in (0, 5, mj.DISTANCE):
        for _ in range(50):
            a = r.integers(0, 1 << 16, mj.FIELDS).astype(np.uint16)
            b = a.copy()
            b[r.choice(mj.FIELDS, errors, replace=False)] += 1
            assert np.intersect1d(mj.keys_of(a), mj.keys_of(b)).size
    a, b = (mj.keys_of(r.integers(0, 1 << 16, mj.FIELDS).astype(np.uint16)) for _ in range(2))
    assert not np.intersect1d(a, b).size and len(np.unique(a)) == 48


def test_pairs_are_looked_at_once():
    r = np.random.default_rng(10)
    base = r.integers(0, 1 << 16, mj.FIELDS).astype(np.uint16)
    fields = np.array([np.where(r.random(mj.FIELDS) < 0.2, r.integers(0, 1 << 16, mj.FIELDS), base).astype(np.uint16) for _ in range(12)])
    keys, labels = [mj.keys_of(f) for f in fields], np.arange(12) // 2
    seen = {}
    for key in np.unique(np.concatenate(keys)):
        at = [k for k in range(12) if key in keys[k]]
        for x, y in ((x, y) for x in range(len(at)) for y in range(x)):
            if labels[at[x]] != labels[at[y]]:
                both = mj.near(int(key), fields[[at[x], at[y]]].view(np.uint8).reshape(2, -1), labels[[at[x], at[y]]])
                assert both[0] == both[1]
                seen[at[y], at[x]] = seen.get((at[y], at[x]), 0) + int(both[0])
    assert seen and set(seen.values()) == {1}


def test_lone_tokens_are_counted_and_classes_without_a_partner_left_out(spark):
    r = random.Random(7)
    sets = {k: {r.randrange(1 << 62) for _ in range(r.randint(1, 9))} for k in range(40)}
    for k in range(40, 300):
        kept = [t for t in sets[k % 40] if r.random() > 0.1]
        sets[k] = {*kept, *(r.randrange(1 << 62) for _ in range(r.choice([0, 0, 1, 5])))} or {k}
    rows = [(k, len(s), bytearray(np.array(sorted(s), np.uint64).tobytes())) for k, s in sets.items()]
    heads = spark.createDataFrame([*rows, (999, 0, bytearray())], "doc_id long, size int, tokens binary").repartition(3)
    held = Counter(t for s in sets.values() for t in s)
    alone = {k: sum(held[t] == 1 for t in s) for k, s in sets.items()}
    want = {k: n for k, n in alone.items() if n <= len(sets[k]) * 20 // 100}
    assert 0 < len(want) < len(sets)
    assert {x["doc_id"]: x["lone"] for x in lone(heads, 5).collect()} == want


def test_near_leaves_out_what_sizes_and_lone_tokens_exclude():
    fields = np.zeros((3, mj.FIELDS), np.uint16)
    key, signs = int(mj.keys_of(fields[0])[0]), fields.view(np.uint8).reshape(3, -1)
    size, labels = np.array([100, 100, 79]), np.arange(3)
    for alone, want in (([0, 0, 0], [1, 1, 0]), ([11, 0, 0], [1, 1, 0]), ([12, 0, 0], [0, 0, 0]), ([20, 12, 0], [0, 0, 0])):
        assert mj.near(key, signs, labels, size, np.array(alone)).tolist() == [bool(w) for w in want]


def _copies(r, many, lone_most):
    """Sets of 300 tokens, of which some are common to all and up to so many are each set's own."""
    alone = [r.randint(0, lone_most) for _ in range(many)]
    sets = [np.array(sorted([*r.sample(range(300), 300 - n), *range(1000 * (k + 1), 1000 * (k + 1) + n)]), np.uint64) for k, n in enumerate(alone)]
    return np.concatenate(sets), np.repeat(np.arange(many), 300), np.full(many, 300)


@pytest.mark.parametrize("kind", [prefix_tree.PrefixTree, prefix_tree.SetRows])
def test_sets_that_can_not_link_are_not_probed(monkeypatch, kind):
    def never(*args):
        raise AssertionError("probed")

    monkeypatch.setattr(kind, "similar_to" if kind is prefix_tree.PrefixTree else "among", never)
    n, own = 60, np.arange(60) * 1000
    tokens = np.concatenate([[*range(260), *range(1000 + k, 1040 + k)] for k in own]).astype(np.uint64)  # 260 of 340 are common
    assert prefix_tree.spanning_links(tokens, np.repeat(np.arange(n), 300), np.full(n, 300), 80, np.arange(n), kind) == []


def test_probes_of_a_large_group_grow_with_its_size(monkeypatch):
    seen, among = [], prefix_tree.SetRows.among
    monkeypatch.setattr(prefix_tree.SetRows, "among", lambda self, x, others: seen.append(len(others)) or among(self, x, others))
    r = random.Random(8)
    for many in (100, 400):
        seen.clear()
        tokens, owner, sizes = _copies(r, many, 60)
        links = prefix_tree.spanning_links(tokens, owner, sizes, 80, np.arange(many), prefix_tree.SetRows)
        plain = prefix_tree.spanning_links(tokens, owner, sizes, 80, np.arange(many))
        assert len(links) == len(plain) > many // 4
        assert sum(seen) <= 20 * many  # of many * (many - 1) / 2 pairs


def test_spanning_links_connect_what_all_similar_pairs_connect(monkeypatch):
    r = random.Random(9)
    for turn in range(200):
        monkeypatch.setattr(prefix_tree, "RUN", (1 << 20, 1, 25)[turn % 3])
        monkeypatch.setattr(prefix_tree.SetRows, "FEW", (1, 16)[turn % 2])
        monkeypatch.setattr(prefix_tree, "PROBED", (1 << 20, 1, 60)[turn % 3])
        base, many = set(r.sample(range(40), 20)), r.randint(2, 14)
        sets = [base ^ set(r.sample(range(60), r.randint(0, 5))) for _ in range(many)]
        sizes = np.array([len(s) + r.randrange(3) for s in sets])
        labels = [r.randrange(many) for _ in sets]
        pairs = [(x, y) for x in range(many) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 80 * (sizes[x] + sizes[y] - len(sets[x] & sets[y]))]
        given = (np.concatenate([sorted(s) for s in sets]).astype(np.uint64), np.repeat(np.arange(many), [len(s) for s in sets]), sizes, 80, np.array(labels))
        for kind in (prefix_tree.PrefixTree, prefix_tree.SetRows):
            links = prefix_tree.spanning_links(*given, kind)
            assert _parts(links, labels) == _parts(pairs, labels) and all((max(p), min(p)) in pairs for p in links)


def _parts(links, labels):
    """The least label that each one's is connected with."""
    least = list(labels)
    for _ in labels:
        for x, y in links:
            low, high = sorted((least[x], least[y]))
            least = [low if n == high else n for n in least]
    return least


def test_similar_sets_share_keys_with_high_recall():
    r = np.random.default_rng(6)
    for size in (5, 20, 300):
        for _ in range(200):
            common = r.integers(0, 1 << 63, size * 8 // 10, dtype=np.uint64)
            rest = r.integers(0, 1 << 63, size - len(common), dtype=np.uint64)
            a, b = np.append(common, rest), common
            assert np.intersect1d(mj.keys_of(mj.signature(a)), mj.keys_of(mj.signature(b))).size


def test_both_joins_agree_on_the_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert _told(joined(docs, "doc_id", "text", 4, Keying(prefix_keyed), 512)) == [r[:3] for r in _told(mj.minhash_join(docs))]


def test_long_words_of_few_letters_differ(spark):
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    h = bt.word_hashes(np.frombuffer((one + other).encode(), np.uint8), np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1]
    rows = [(1, f"{one} x y z u v"), (2, f"{other} x y z u v"), (3, one), (4, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for join, n in ((ngram_join, 5), (mj.minhash_join, 4)):
        assert {r[0]: (r[1], r[2]) for r in _told(join(docs))} == brute.similar(rows, n)


@pytest.mark.parametrize("length", [1, 7, 8, 9, 16, 63, 64, 65, 200])
def test_word_hashes_hang_on_each_byte_only_of_the_word(length):
    r = np.random.default_rng(length)
    b = r.integers(0, 256, length + 20).astype(np.uint8)
    h = bt.word_hashes(b, np.array([3]), np.array([3 + length]))[0]
    other = b.copy()
    other[:3] ^= 1
    other[3 + length :] ^= 1
    assert bt.word_hashes(other, np.array([3]), np.array([3 + length]))[0] == h
    for k in range(3, 3 + length):
        other = b.copy()
        other[k] ^= 1
        assert bt.word_hashes(other, np.array([3]), np.array([3 + length]))[0] != h


def test_components_in_one_task_and_by_rounds(spark):
    r = random.Random(7)
    links = [(a, r.randint(0, a)) for a in r.sample(range(5000), 1500)] + [(k, k + 1) for k in range(6000, 6400)] + [(None, 3), (4, 4)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = sorted((x, root(x)) for x in parent)
    frame = spark.createDataFrame(links, "a long, b long").repartition(6)
    assert _told(components(frame)) == want
    assert _told(components(frame, run=100)) == want


def _vectors(r, n, dim=6, labels=4):
    return [(i, [r.gauss(0, 0.4) for _ in range(dim)], r.randrange(labels)) for i in range(n)]


def test_hard_negatives_equal_the_plain_version(spark):
    r = random.Random(8)
    rows = _vectors(r, 400)
    rows += [(1000 + k, rows[50][1], k % 3) for k in range(300)]  # ties
    rows += [(2000, None, 1), (2001, [0.5] * 6, None), (2002, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1), (2003, [math.nan] * 6, 1), (2004, [math.inf] * 6, 2), (2050, [0.0] * 6, 1)]
    rows += [(None, [0.4] * 6, 1), (2100, [0.3], 2), (2150, [], 3), (2200, [0.2] * 9, 3), (2250, [0.3] * 6, 77)]
    frame = spark.createDataFrame([(c, i, v, 0, "n") for i, v, c in rows], "label int, vec_id long, embedding array<double>, w int, id string").repartition(7)
    want = brute.mined(rows)
    assert len(want) > 100
    for most in (2048, 3):
        assert _told(hn.hard_negatives(frame, F.col("vec_id") % 50 == 0, most=most)) == want


def test_hard_negatives_of_small_batches_and_other_types(spark, monkeypatch):
    monkeypatch.setattr(hn, "CELLS", 200)
    r = random.Random(9)
    rows = [(i, [x * 30 for x in v], c) for i, v, c in _vectors(r, 150)] + [(200 + i, [x * 4e5 for x in v], c) for i, v, c in _vectors(r, 60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    assert _told(hn.hard_negatives(frame, F.col("vec_id") % 50 == 0)) == brute.mined(rows)


def test_hard_negatives_without_rows_and_beyond_64_bits(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [0.5], 1), (2, [0.5], 2)], [(50, [0.5], 1)]):
        assert hn.hard_negatives(spark.createDataFrame(rows, kinds), F.col("vec_id") % 50 == 0).collect() == []
    large = spark.createDataFrame([(50, [1e8, 1e8], 1), (51, [1e8, 0.0], 1), (52, [1.0, 1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="61 bits"):
        hn.hard_negatives(large, F.col("vec_id") % 50 == 0).collect()


def test_repeated_anchors_have_their_own_results(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (1, [1.0, 0.2], 1), (2, [0.9, 0.8], 2), (3, [0.7, 0.9], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = _told(hn.hard_negatives(frame, F.col("vec_id") % 50 == 0))
    assert got == sorted(brute.mined([rows[0], *rows[2:]]) + brute.mined([rows[1], *rows[2:]]))
