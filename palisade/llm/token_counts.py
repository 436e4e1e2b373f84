"""Token counts of a unigram tokenizer, without building the tokens.

Aho-Corasick enumerates the vocabulary's pieces in a word; dynamic programming over end
positions carries the best score and its number of pieces. Rules, as in the public
``tokenizers`` library's Unigram model: a path replaces another only if its score is higher,
and of the paths to a position the one whose last piece starts first is tried first; a
character that no piece covers alone costs the lowest score less 10, and stands for as many
byte pieces as it has UTF-8 bytes (with byte fallback), or else adjacent ones fuse into one.

The public vocabulary taken here by default is that of a byte-pair model, whose scores are ranks: its pieces and
scores serve as a unigram vocabulary, so counts are exact for that, and equal no published tokenizer's.

White space runs are collapsed and pieces never cross words, so a text's count is the sum over
its words, and each worker remembers the counts of words it has met (a cache of a fixed
number of words, cleared when full: speed only, never results).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizers' vocabulary files lie; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, read on the driver; a vocabulary's size is fixed."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class ViterbiCounter:
    """Counts the pieces of words under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        known = {piece for piece, _ in pieces}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """Pieces of the marked word; a mark inside it starts anew, as in the library."""
        if MARK in word:
            return sum(map(self.of_word, word.split(MARK)))
        s = MARK + word
        n = len(s)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        loose = [False] * (n + 1)  # the best path ends with an unknown character
        found = self.automaton.iter(s)
        nxt = next(found, None)
        for end in range(1, n + 1):
            best, pieces, single, is_loose = None, 0, False, False
            # matches with one end come longest first, that is by start
            while nxt is not None and nxt[0] == end - 1:
                length, own = nxt[1]
                start = end - length
                candidate = score[start] + own
                if best is None or candidate > best:
                    best, pieces, is_loose = candidate, count[start] + 1, False
                single = single or length == 1
                nxt = next(found, None)
            if not single:
                candidate = score[end - 1] + self.unknown
                if best is None or candidate > best:
                    more = len(s[end - 1].encode()) if self.bytes else int(not loose[end - 1])
                    best, pieces, is_loose = candidate, count[end - 1] + more, True
            score[end], count[end], loose[end] = best, pieces, is_loose
        return count[n]

    def of_text(self, text: str) -> tuple[int, int]:
        """(words, tokens)"""
        words = _SPLIT.findall(text)
        cache, get = self.cache, self.cache.get
        total = 0
        for word in words:
            k = get(word)
            if k is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                k = self.of_word(word)
                if len(word) <= 64:
                    cache[word] = k
            total += k
        return len(words), total


_counters: dict[int, ViterbiCounter] = {}


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | list[tuple[str, float]] = VOCABULARY,
    byte_fallback: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens (both long).

    Null and empty texts have 0 of both; whole texts count, however long; repeated rows are
    counted each; null ids stay null; an empty table gives an empty result; other columns
    are ignored. The vocabulary (its size is fixed) is sent to the executors once.
    """
    spark: SparkSession = docs.sparkSession
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    sent = spark.sparkContext.broadcast(pieces)
    key = sent._jbroadcast.id() if hasattr(sent, "_jbroadcast") else id(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(key)
        if counter is None:  # a worker process that is used again keeps its counter
            _counters.clear()
            counter = _counters[key] = ViterbiCounter(sent.value, byte_fallback)
        for batch in batches:
            got = [counter.of_text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w for w, _ in got], pa.int64()), pa.array([k for _, k in got], pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
