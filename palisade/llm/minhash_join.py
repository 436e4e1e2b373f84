"""MinHash near-dedup by a multi-index Hamming join.

1. Documents that can't have a partner are left out by an exact filter, and those with one set form a class
   (both as in ngram_join.py, with shingles of WORDS words). Then so are classes: each is told how many of its shingles no
   other class has, and the others bound its overlap with any, here and in all that follows.
2. A class's signature has FIELDS fields of FIELD_BITS bits: the low bits of the least value of its shingles
   under as many hash functions. The distance of two signatures is the number of fields that differ.
3. Signatures are split into chunks of CHUNK fields. If two are at most DISTANCE apart, the pigeonhole
   principle leaves some chunk with at most ERRORS differing fields. All ways to leave ERRORS fields out of a
   chunk are enumerated, on both sides, so such a pair shares a key: (chunk, fields left out, the others).
4. Classes meet at keys with their signatures. Those go on that have a partner there, of another component so far,
   with a signature at most NEAR away, an overlap that may suffice and no earlier key in common; so a pair is looked at once.
5. These meet with their full sets, on which links are confirmed, pair by pair, until a class is connected with all that it
   may link with. Large groups meet in blocks, by turns, and components are those of ngram_join.py.

With 12 chunks of 4 fields and one error the join is complete up to a distance of 23 of 48. Two sets of similarity 0.8
differ in 9.6 fields on average; all chunks fail at once with probability 1e-9, and the distance passes NEAR with 1e-8.
A signature of one bit a hash would take thousands of keys a document for the same recall: unrelated sets
differ in half of its bits and similar ones in a tenth, while with fields of 16 bits they differ in all and in a fifth.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytetools as bt
from .ngram_join import BLOCK, KEYED_SCHEMA, PERCENT, Keying, joined, lone
from .prefix_tree import SetRows

WORDS = 4
FIELDS, FIELD_BITS, CHUNK, ERRORS = 48, 16, 4, 1
#: Two signatures this far apart or less share a key: fewer errors than fill all chunks beyond ERRORS.
DISTANCE = FIELDS // CHUNK * (ERRORS + 1) - 1
#: Signatures further apart aren't of similar sets.
NEAR = 26
#: Pairs of signatures that are compared at a key; where there are more, all classes go on.
PAIRS, PAIRS_AT_ONCE = 1 << 26, 1 << 16
#: Odd multipliers, one for each field.
_FACTORS = bt.mix(np.arange(1, FIELDS + 1, dtype=np.uint64)) | np.uint64(1)
_KEPT = np.array([[k for k in range(CHUNK) if k not in out] for out in combinations(range(CHUNK), ERRORS)])


def signature(tokens: np.ndarray) -> np.ndarray:
    """The fields of a set of 64-bit hashes, which isn't empty."""
    out = np.empty(FIELDS, np.uint64)
    for k, factor in enumerate(_FACTORS):
        out[k] = (tokens * factor).min()
    return (bt.mix(out) & np.uint64((1 << FIELD_BITS) - 1)).astype(np.uint16)


def keys_of(fields: np.ndarray) -> np.ndarray:
    """A key for each chunk and choice of fields that are left out."""
    chunks = fields.reshape(-1, CHUNK).astype(np.uint64)
    kept = chunks[:, _KEPT]  # chunk, choice, field
    key = np.zeros(kept.shape[:2], np.uint64)
    for k in range(kept.shape[2]):
        key = (key << np.uint64(FIELD_BITS)) | kept[:, :, k]
    place = np.arange(key.size, dtype=np.uint64).reshape(key.shape)
    return bt.mix(key ^ (place << np.uint64(64 - 10))).reshape(-1)


def near(key: int, signs: np.ndarray, labels: np.ndarray, size: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Which classes of a key have a partner there: of another label, near, and with no earlier key in common; if sizes and
    numbers of lone tokens are given, one that these allow."""
    fields = np.ascontiguousarray(signs).view(np.uint16)
    _, label, many = np.unique(labels, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(label != many.argmax())  # a pair has an end outside the most frequent label
    if len(rest) * len(fields) > PAIRS:
        return np.ones(len(fields), bool)
    place = int(np.flatnonzero(keys_of(fields[0]) == np.uint64(key))[0])
    chunk, choice = divmod(place, len(_KEPT))
    out, step = np.zeros(len(fields), bool), max(1, PAIRS_AT_ONCE // len(fields))
    for s in range(0, len(rest), step):
        own = rest[s : s + step]
        same = fields[own, None, :] == fields[None, :, :]
        common = same.reshape(len(own), len(fields), -1, CHUNK).sum(3) >= CHUNK - ERRORS
        whole = same[:, :, chunk * CHUNK : (chunk + 1) * CHUNK].all(2)  # all choices of the chunk are in common
        pair = (label[own, None] != label) & (FIELDS - same.sum(2) <= NEAR) & ~common[:, :, :chunk].any(2) & (~whole | (choice == 0))
        if size is not None and at is not None:
            overlap = np.minimum((size - at)[own, None], size - at)  # at most
            pair &= (100 + PERCENT) * overlap >= PERCENT * (size[own, None] + size)
        out[own] |= pair.any(1)
        out |= pair.any(0)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, size, tokens, lone) with their keys and signature; before what any two share come the lone tokens."""
    for batch in batches:
        signs = [signature(np.frombuffer(cell, np.uint64)) for cell in batch.column(2).to_pylist()]
        keys = [np.unique(keys_of(sign)) for sign in signs]
        alone = batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in range(3)),
                pa.array([k.tobytes() for k in keys], pa.binary()),
                pa.array([np.full(len(k), n, np.int32).tobytes() for k, n in zip(keys, alone, strict=True)], pa.binary()),
                pa.array([sign.tobytes() for sign in signs], pa.binary()),
            ],
            ["doc_id", "size", "tokens", "keys", "at", "sign"],
        )


def signature_keyed(heads: DataFrame, buckets: int) -> DataFrame:
    told = heads.join(lone(heads, buckets).hint("shuffle_hash"), "doc_id")
    return told.select("doc_id", "size", "tokens", "lone").mapInArrow(_keyed, KEYED_SCHEMA)


def minhash_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id reachable by links), kept.

    Two documents link where the Jaccard similarity of their sets of WORDS-word shingles (lower-cased A-Z; a
    text with fewer words is one shingle) reaches 80 per cent, ties included. ids are integers.

    * null and empty texts have no shingle, link with nothing and are kept; very long texts count whole.
    * repeated rows (one id, one text) get equal results; rows with one id and different texts are
      documents of their own. A row with a null id links with nothing, has a null component and is kept.
      An empty table gives an empty result; other columns are ignored.
    """
    out = joined(docs, id_col, text_col, WORDS, Keying(signature_keyed, near, (1, 2), SetRows), block)
    return out.selectExpr("doc_id", "n_shingles", "component_id", "doc_id <=> component_id AS kept")
