"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (runs of letters, lower-cased; longer ones in pieces of LETTERS bytes that overlap) are
read in overlapping windows of WINDOW words, a new one each STRIDE words, so that every byte of every
word of a whole text is scored, in unspaced scripts too. A word's input is a
hashed word embedding beside the mean of its hashed character n-gram embeddings; embeddings
exist only for buckets that several training texts share. Both start from log odds counted
on the training texts and are trained with the network. The text's score is a logistic
function of its highest window scores, calibrated on the training texts.

Training uses a bounded sample of labelled rows (TRAIN_TOXIC and TRAIN_CLEAN texts, by a hash of
the id) on the driver; scoring is an Arrow task over all rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetools as bt

WINDOW, STRIDE = 24, 12
HIDDEN = 8
WORD_BUCKETS, WORD_DIM = 1 << 15, 4
GRAM_BUCKETS, GRAM_DIM = 1 << 16, 6
GRAM_SIZES, LETTERS = (5, 8), 13
#: From one piece of a long word to the next: each n-gram stands whole in a piece.
PIECE = LETTERS - GRAM_SIZES[-1] + 1
#: Training texts that must share a bucket for it to have an embedding.
SUPPORT = 3
#: Bounds of the labelled sample.
TRAIN_TOXIC, TRAIN_CLEAN = 800, 1600
STEPS, BATCH, RATE = 360, 192, 0.02
THRESHOLD = 0.3
_TOPS = (1, 3, 8)


# ---- words and windows ----------------------------------------------------------------------


def words_of(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the (start, end, text) of their words, or of the pieces of long ones."""
    low = bt.lower_ascii(b)
    start, end, text = bt.spans((((low >= 97) & (low <= 122)) | (low >= 128)) & ~_punctuation(low), offsets)
    many = np.maximum(-(-(end - start - LETTERS) // PIECE), 0) + 1
    if (many > 1).any():
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start, end, text = np.repeat(start, many) + nth * PIECE, np.repeat(end, many), np.repeat(text, many)
        end = np.minimum(end, start + LETTERS)
    return low, start, end, text


def _punctuation(b: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 punctuation beyond ASCII: of Latin-1, general, of East Asian scripts, and full-width."""
    out = np.zeros(len(b) + 2, bool)
    lead = np.flatnonzero(b >= 0xC2)
    padded = np.append(b, np.zeros(2, np.uint8))
    one, two, three = padded[lead], padded[lead + 1], padded[lead + 2]
    between = lambda x, low, high: (x >= low) & (x <= high)
    wide = (two == 0xBC) & (between(three, 0x81, 0x8F) | between(three, 0x9A, 0xA0) | (three >= 0xBB))
    wide |= (two == 0xBD) & ((three == 0x80) | between(three, 0x9B, 0xA5))
    short = (one == 0xC2) & (two >= 0xA0)
    long = ((one == 0xE2) & between(two, 0x80, 0x81)) | ((one == 0xE3) & (two == 0x80)) | ((one == 0xEF) & wide)
    for k in range(3):
        out[lead[long | short if k < 2 else long] + k] = True
    return out[: len(b)]


def gram_codes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[words, n-grams] buckets from 1; 0 where a word has no such n-gram."""
    size = np.minimum(end - start, LETTERS)
    at = start[:, None] + np.arange(LETTERS)
    padded = np.append(low, np.zeros(LETTERS, np.uint8))
    letters = np.where(np.arange(LETTERS) < size[:, None], padded[at], 0).astype(np.uint32)
    letters = np.concatenate([np.full((len(start), 1), 60, np.uint32), letters], 1)
    out = []
    for n in GRAM_SIZES:
        for j in range(LETTERS + 2 - n):
            h = np.full(len(start), n, np.uint32)
            for i in range(n):
                h = (h ^ letters[:, j + i]) * np.uint32(16777619)
            h = (h ^ (h >> np.uint32(15))) % np.uint32(GRAM_BUCKETS - 1) + np.uint32(1)
            out.append(np.where(j + n <= size + 1, h, 0))
    return np.stack(out, 1).astype(np.int32)


@dataclass
class Vocabulary:
    """The distinct words of some texts, and each occurrence's number among them (from 1)."""

    word: np.ndarray  # buckets from 1
    grams: np.ndarray
    code: np.ndarray
    text: np.ndarray


def read_words(b: np.ndarray, offsets: np.ndarray) -> Vocabulary:
    low, start, end, text = words_of(b, offsets)
    h = bt.span_hashes(low, start, end)
    own, first, code = np.unique(h, return_index=True, return_inverse=True)
    word = (own % bt.U64(WORD_BUCKETS - 1)).astype(np.int32) + 1
    return Vocabulary(word, gram_codes(low, start[first], end[first]), code.astype(np.int64) + 1, text)


def read_texts(raw: list[bytes], most: int = 1 << 20) -> Vocabulary:
    """read_words() of many texts, some at a time, which takes little memory."""
    parts, s = [], 0
    while s < len(raw):
        e, size = s + 1, len(raw[s])
        while e < len(raw) and size + len(raw[e]) <= most:
            size += len(raw[e])
            e += 1
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw[s:e]])]).astype(np.int64)
        low, start, end, text = words_of(np.frombuffer(b"".join(raw[s:e]), np.uint8), offsets)
        own, first, code = np.unique(bt.span_hashes(low, start, end), return_index=True, return_inverse=True)
        parts.append((own, gram_codes(low, start[first], end[first]), code, text + s))
        s = e
    hashes, grams, codes, texts = zip(*parts, strict=True)
    shift = np.cumsum([0, *(len(h) for h in hashes)])
    own, first, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    code = np.concatenate([number[c + k] for c, k in zip(codes, shift, strict=False)]).astype(np.int64) + 1
    return Vocabulary((own % bt.U64(WORD_BUCKETS - 1)).astype(np.int32) + 1, np.concatenate(grams)[first], code, np.concatenate(texts))


def windows_of(v: Vocabulary, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """[windows, WINDOW] word codes (0 beyond the text's end) and each window's text."""
    per = np.bincount(v.text, minlength=texts)
    many = np.where(per > WINDOW, -(-(per - WINDOW) // STRIDE) + 1, (per > 0).astype(np.int64))
    text = np.repeat(np.arange(texts), many)
    begin = np.concatenate([[0], np.cumsum(per)])
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = (begin[text] + nth * STRIDE)[:, None] + np.arange(WINDOW)
    inside = at < begin[text + 1][:, None]
    return np.where(inside, v.code[np.minimum(at, max(len(v.code) - 1, 0))] if len(v.code) else 0, 0), text


# ---- network --------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name; the forward and backward passes of the window classifier."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        e, h = WORD_DIM + GRAM_DIM, HIDDEN
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "word": np.zeros((WORD_BUCKETS, WORD_DIM), np.float32),
            "gram": np.zeros((GRAM_BUCKETS, GRAM_DIM), np.float32),
            "wf": make(e, 3 * h), "bf": np.zeros(3 * h, np.float32), "uf": make(h, 3 * h),
            "wb": make(e, 3 * h), "bb": np.zeros(3 * h, np.float32), "ub": make(h, 3 * h),
            "att": make(2 * h, 1), "out": make(2 * h, 1), "c": np.zeros(1, np.float32),
        }

    def inputs(self, word: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of distinct words after a blank one, and the share of an n-gram in a word."""
        share = 1 / np.maximum((grams > 0).sum(1), 1).astype(np.float32)
        mean = np.zeros((len(word), GRAM_DIM), np.float32)
        for j in range(grams.shape[1]):
            mean += self.p["gram"][grams[:, j]]
        x = np.concatenate([self.p["word"][word], mean * share[:, None]], 1)
        return np.concatenate([np.zeros((1, x.shape[1]), np.float32), x]), share

    @staticmethod
    def run(xp: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
        """xp [steps, windows, 3h]: the hidden states of one direction."""
        h = np.zeros((xp.shape[1], HIDDEN), np.float32)
        out = np.empty((xp.shape[0], xp.shape[1], HIDDEN), np.float32)
        for t in range(xp.shape[0]):
            a = h @ u
            rz = 1 / (1 + np.exp(-(xp[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])))
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(xp[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, r, z, n, a[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, codes: np.ndarray, most: int = 8192) -> np.ndarray:
        """Scores of windows given their words' vectors."""
        p, out = self.p, np.empty(len(codes), np.float32)
        xf, xb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
        for s in range(0, len(codes), most):
            c = codes[s : s + most].T
            hf = self.run(xf[c], p["uf"])
            hb = self.run(xb[c[::-1]], p["ub"])[::-1]
            att = np.exp(np.clip((hf @ p["att"][:HIDDEN] + hb @ p["att"][HIDDEN:])[..., 0], -30, 30))
            val = (hf @ p["out"][:HIDDEN] + hb @ p["out"][HIDDEN:])[..., 0]
            out[s : s + most] = (att * val).sum(0) / att.sum(0) + p["c"]
        return out

    @staticmethod
    def _back(d_out: np.ndarray, keep: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d_xp = np.empty((*d_out.shape[:2], 3 * HIDDEN), np.float32)
        d_u, d_h = np.zeros_like(u), np.zeros(d_out.shape[1:], np.float32)
        for t in range(len(keep) - 1, -1, -1):
            h, r, z, n, an = keep[t]
            d_h = d_h + d_out[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (h - n) * z * (1 - z)
            d_r = d_n * an * r * (1 - r)
            d_xp[t] = np.concatenate([d_r, d_z, d_n], 1)
            d_a = np.concatenate([d_r, d_z, d_n * r], 1)
            d_u += h.T @ d_a
            d_h = d_h * z + d_a @ u.T
        return d_xp, d_u

    def gradients(self, word: np.ndarray, grams: np.ndarray, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over windows; codes index the given words from 1."""
        p = self.p
        x, share = self.inputs(word, grams)
        c = codes.T
        kf, kb = [], []
        hf = self.run((x @ p["wf"] + p["bf"])[c], p["uf"], kf)
        hb = self.run((x @ p["wb"] + p["bb"])[c[::-1]], p["ub"], kb)[::-1]
        hs = np.concatenate([hf, hb], 2)
        att = np.exp(np.clip((hs @ p["att"])[..., 0], -30, 30))
        att /= att.sum(0)
        val = (hs @ p["out"])[..., 0]
        score = (att * val).sum(0)
        d = (sigmoid(score + p["c"]) - target).astype(np.float32) / len(target)
        d_val, d_att = att * d, att * (val - score) * d
        g = {"c": np.array([d.sum()], np.float32), "out": np.einsum("twk,tw->k", hs, d_val)[:, None], "att": np.einsum("twk,tw->k", hs, d_att)[:, None]}
        d_hs = d_val[..., None] * p["out"][:, 0] + d_att[..., None] * p["att"][:, 0]
        d_x = np.zeros_like(x)
        for side, k, order, own in (("f", kf, 1, d_hs[..., :HIDDEN]), ("b", kb, -1, d_hs[::-1, :, HIDDEN:])):
            d_xp, g[f"u{side}"] = self._back(own, k, p[f"u{side}"])
            sums = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(sums, c[::order], d_xp)
            g[f"w{side}"], g[f"b{side}"] = x.T @ sums, sums.sum(0)
            d_x += sums @ p[f"w{side}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], word, d_x[1:, :WORD_DIM])
        for j in range(grams.shape[1]):
            np.add.at(g["gram"], grams[:, j], d_x[1:, WORD_DIM:] * share[:, None])
        return g


# ---- training -------------------------------------------------------------------------------


@dataclass
class ToxicityModel:
    network: Network
    weights: np.ndarray  # of a text's features, the last one constant

    def text_features(self, logits: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """[texts, features]: means of the highest window scores, of as many as there are."""
        out = np.full((texts, len(_TOPS) + 1), -8, np.float32)
        out[:, -1] = 1
        order = np.lexsort((-logits, text))
        first = np.searchsorted(text[order], np.arange(texts + 1))
        total = np.concatenate([[0.0], np.cumsum(logits[order], dtype=np.float64)])
        some = first[1:] > first[:-1]
        for k, top in enumerate(_TOPS):
            end = np.minimum(first[:-1] + top, first[1:])
            out[some, k] = ((total[end] - total[first[:-1]])[some] / (end - first[:-1])[some]).astype(np.float32)
        return out

    def scores(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each of some texts, in [0, 1]."""
        texts = len(offsets) - 1
        v = read_words(b, offsets)
        x, _ = self.network.inputs(v.word, v.grams)
        codes, text = windows_of(v, texts)
        f = self.text_features(self.network.logits(x, codes), text, texts)
        return sigmoid(f.astype(np.float64) @ self.weights)


def _log_odds(v: Vocabulary, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log odds and supporting texts of word and n-gram buckets, each text counting once."""
    counts = [np.zeros((2, WORD_BUCKETS)), np.zeros((2, GRAM_BUCKETS))]
    first = np.searchsorted(v.text, np.arange(len(target) + 1))
    for k, y in enumerate(target.astype(int)):
        own = np.unique(v.code[first[k] : first[k + 1]]) - 1
        counts[0][y, np.unique(v.word[own])] += 1
        counts[1][y, np.unique(v.grams[own])] += 1
    n = np.array([max((target == 0).sum(), 1), max((target == 1).sum(), 1)])
    out = []
    for c in counts:
        odds = np.log((c[1] + 0.3) / (n[1] + 1)) - np.log((c[0] + 0.3) / (n[0] + 1))
        out += [np.clip(odds, -1, 4) / 2, c.sum(0)]
        out[-1][0] = 0
    return tuple(out)


#: The log odds of all texts where labels of both kinds are missing: nothing is rejected.
NOTHING_LEARNED = -30.0


def train(texts: list[str], target: list[int], seed: int = 7) -> ToxicityModel:
    """Fits on labelled texts; without both labels among them, all texts score 0 to 12 digits. A text's windows with the highest scores stand for it; they are chosen
    by the log odds at first and twice more by the network itself."""
    net, r = Network(seed), np.random.default_rng(seed)
    y = np.array(target, np.float32)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        return ToxicityModel(net, np.array([*[0.0] * len(_TOPS), NOTHING_LEARNED]))
    v = read_texts([t.encode() for t in texts])
    word_odds, word_n, gram_odds, gram_n = _log_odds(v, y)
    mask = {"word": (word_n >= SUPPORT)[:, None].astype(np.float32), "gram": (gram_n >= SUPPORT)[:, None].astype(np.float32)}
    for k, odds in (("word", word_odds), ("gram", gram_odds)):
        net.p[k][:] = r.standard_normal(net.p[k].shape) * 0.1
        net.p[k][:, 0] = odds
        net.p[k] *= mask[k]
    codes, text = windows_of(v, len(y))
    x, _ = net.inputs(v.word, v.grams)
    seen = np.concatenate([[0], x[1:, 0] + 2 * x[1:, WORD_DIM]])
    score = np.sort(seen[codes], 1)[:, -4:].sum(1)
    first, second = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    step = 0
    for part in range(3):
        order = np.lexsort((-score, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        chosen = order[rank < np.where(y[text[order]] > 0, 2, 4)]
        more = r.choice(len(codes), min(len(codes), len(chosen) // 2), replace=False)
        pools = [chosen[y[text[chosen]] > 0], np.concatenate([chosen[y[text[chosen]] == 0], more[y[text[more]] == 0]])]
        for _ in range(STEPS // 3):
            step += 1
            take = np.concatenate([r.choice(q, BATCH // 2) for q in pools])
            c = codes[take]
            c = np.where(r.random(c.shape) < 0.1, 0, c)  # words dropped at random
            own, inverse = np.unique(c, return_inverse=True)
            real = own[own > 0] - 1
            g = net.gradients(v.word[real], v.grams[real], inverse.reshape(c.shape) + (own[0] > 0), y[text[take]])
            rate = RATE * (1 - 0.8 * step / STEPS)
            for k, a in net.p.items():
                d = g[k] * mask[k] if k in mask else g[k] + 1e-4 * a
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                size = rate * (0.5 if k in mask else 1)
                a -= size * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        x, _ = net.inputs(v.word, v.grams)
        score = net.logits(x, codes)
    model = ToxicityModel(net, np.zeros(len(_TOPS) + 1))
    f = model.text_features(score, text, len(y)).astype(np.float64)
    w = np.array([1.0, *[0.0] * (len(_TOPS) - 1), -1.0])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        q = sigmoid(f @ w)
        ridge = np.diag([*[1.0] * len(_TOPS), 1e-3])
        w = w - np.linalg.solve(f.T @ (f * (q * (1 - q))[:, None]) + ridge, f.T @ (q - y) + ridge @ w)
    model.weights = w
    return model


# ---- on Spark -------------------------------------------------------------------------------


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """_id, label, text of at most TRAIN_TOXIC and TRAIN_CLEAN labelled ids that aren't held out, a text of each: where
    rows of one id differ, the one that hashes to least. An id with both labels is there with both."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")
    )
    by = F.xxhash64("_id")
    ids = known.where("label = 1").orderBy(by, "_id").limit(TRAIN_TOXIC).unionByName(
        known.where("label = 0").orderBy(by, "_id").limit(TRAIN_CLEAN)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    met = texts.join(F.broadcast(ids.distinct()), "_id")  # bounded: TRAIN_TOXIC + TRAIN_CLEAN rows
    return met.groupBy("_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    rows = sorted(
        (r["_id"], r["text"] or "", r["label"])
        for r in labelled_sample(docs, labels, id_col, text_col, label_col).collect()
    )
    return train([t for _, t, _ in rows], [k for _, _, k in rows])


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 from the threshold on).

    Null and empty texts have no window and get the score of a text with none; very long ones are
    scored whole, a window each STRIDE words. Repeated rows get equal scores; null ids pass
    through; an empty table gives an empty result; other columns are ignored. A model that was fitted
    without labels of both kinds rejects nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for row, end, b, offsets in bt.text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(own.scores(b, offsets), pa.float64())],
                    ["doc_id", "score"],
                )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document, by a model fitted on ``labels``."""
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, without a shuffle. Each row is judged
    by its own text, so null and repeated ids change nothing; null and empty texts are judged as texts without words."""
    model = fit_toxicity(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, b, offsets in bt.text_slices(batch.column(at)):
                yield batch.slice(row, end - row).filter(pa.array(sent.value.scores(b, offsets) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
