"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled texts: one of ordinary text, one of ordinary text
that ends in pieces typical of toxic text. A window (a word between fixed ordinary context) that the
second dictionary codes in fewer bytes than the first is evidence for toxicity. The distribution of
these differences over a text's windows goes through thresholds that are calibrated on labelled texts
that the dictionaries have not seen.

Dictionary pieces are runs of characters whose share among toxic texts is many times that among
ordinary ones. Ordinary windows that look toxic with a first pair of dictionaries are added to the
ordinary part, and the pair is built again.

The only inputs of a score are the text itself and the two dictionaries. Nulls and empty texts have
no windows and get the score of a text without evidence. Repeated rows get equal scores; a score of
exactly 0.5 is predicted toxic. Rows that repeat an id are learnt from once, with the larger label and
text. Very long texts are read whole. Without labels of both classes, every score is 0. Extra columns,
whatever their names, stay as they are or are left out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Names, renamed, small_batches, trim

#: Most labelled rows that the classifier is fitted on; above it, those with the smallest hashes of their ids.
MOST_ROWS = 5000
#: Of these, the share that the dictionaries are built from; the rest calibrates the thresholds.
DICTIONARY_SHARE = 0.6
WORD = re.compile(r"\w+")
#: Lengths of the character runs, the least number of toxic texts' words with one, and how much likelier it is there.
RUNS, LEAST_SEEN, TIMES = range(4, 9), 5, 20.0
#: Bytes of ordinary text, of toxic pieces and of misjudged ordinary windows in the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES, HARD_BYTES = 24_000, 8192, 20_000
#: Differences in bytes are counted up to this one; from MISJUDGED on, an ordinary window is misjudged.
MOST_BYTES, MISJUDGED = 10, 3
CACHE_WORDS = 400_000


def _ranked(counts: Counter) -> list[str]:
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]


def _content(pieces: list[str], size: int, gap: bytes) -> bytes:
    """The first pieces that fit, the most frequent last, where matches are cheapest."""
    out, n = [], 0
    for p in pieces:
        b = p.encode() + gap
        if n + len(b) > size:
            break
        out.append(b)
        n += len(b)
    return b"".join(reversed(out))


def _runs(word: str) -> set[str]:
    s = f" {word} "
    return {s[k : k + n] for n in RUNS for k in range(len(s) - n + 1)}


class Dictionaries:
    """The compressors of both classes and the window differences they give; travels as three byte strings."""

    def __init__(self, common: bytes, ordinary: bytes, toxic: bytes):
        self.parts = common, ordinary, toxic
        settings = dict(strategy=zstandard.STRATEGY_BTLAZY2, min_match=5, window_log=17, hash_log=17, chain_log=18, search_log=8, target_length=64)
        params = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, **settings)
        self.coders = []
        for own in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(common + own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        self.before, self.after = common[-40:-20], common[-20:]
        self.seen: dict[str, int] = {}

    def difference(self, word: str) -> int:
        """Bytes that the toxic dictionary saves on a word in its window."""
        window = self.before + f" {word} ".encode() + self.after
        saved = len(self.coders[0].compress(window)) - len(self.coders[1].compress(window))
        if len(word) < 40:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            self.seen[word] = saved
        return saved

    def profile(self, text: str | None) -> np.ndarray:
        """Number of windows of a text by bytes saved, from 0 to MOST_BYTES."""
        get = self.seen.get
        words = WORD.findall((text or "").lower())
        saved = [get(w) for w in words]
        if None in saved:
            saved = [self.difference(w) if s is None else s for s, w in zip(saved, words)]
        return np.bincount(np.clip(np.array(saved, np.int64), 0, MOST_BYTES), minlength=MOST_BYTES + 1)


def train_dictionaries(texts: list[str], toxic: list[bool]) -> Dictionaries | None:
    """None without texts of both classes, or without pieces typical of toxic ones."""
    seen = {True: Counter(), False: Counter()}
    n = Counter(map(bool, toxic))
    for text, y in zip(texts, toxic):
        seen[bool(y)].update(set(WORD.findall((text or "").lower())))
    if not n[True] or not n[False]:
        return None
    there, other = Counter(), Counter()
    for w, c in seen[True].items():
        for run in _runs(w):
            there[run] += c
    frequent = {r for r, c in there.items() if c >= LEAST_SEEN}
    for w, c in seen[False].items():
        for run in _runs(w) & frequent:
            other[run] += c
    typical = {r for r in frequent if there[r] / n[True] >= TIMES * (other[r] + 0.5) / n[False]}
    pieces: Counter = Counter()
    suspects = set()
    for w, c in seen[True].items():
        s = f" {w} "
        inside = np.zeros(len(s), bool)
        for k in RUNS:
            for at in range(len(s) - k + 1):
                if s[at : at + k] in typical:
                    inside[at : at + k] = True
        if inside.any():
            suspects.add(w)
            for part in "".join(c if i else "\0" for c, i in zip(s, inside)).split("\0"):
                if part:
                    pieces[part] += c
    own = _content(_ranked(pieces), TOXIC_BYTES, b"\0")
    everything = _content(_ranked(seen[False]), ORDINARY_BYTES + len(own), b" ")
    if not own or len(everything) <= len(own):
        return None
    filling, common = everything[: len(own)], everything[len(own) :]
    first = Dictionaries(common, filling, own)
    hard = Counter({w: c for w, c in seen[False].items() if w not in suspects and first.difference(w) >= MISJUDGED})
    return Dictionaries(_content(_ranked(hard), HARD_BYTES, b" ") + common, filling, own)


def features(profile: np.ndarray) -> np.ndarray:
    """Of one profile, or one in each row: shares and numbers of windows from each threshold on."""
    tail = np.cumsum(profile[..., ::-1], axis=-1)[..., ::-1].astype(float)
    total = np.maximum(tail[..., :1], 1.0)
    return np.concatenate([np.log1p(tail[..., 2:8]), np.sqrt(tail[..., 2:8] / total) * 4, np.log1p(total) / 4], axis=-1)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with an intercept, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w


def _crc(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> tuple[Dictionaries, np.ndarray] | None:
    """Dictionaries and weights from labelled rows whose crc32(id) mod 5 is not 0, at most most_rows of them."""
    usable = labels.where(_crc(id_col) % 5 != 0).where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max(label_col).alias("y"))
    order = lambda c: [F.xxhash64(F.col(c).cast("string")), c]
    chosen = usable.orderBy(*order("of")).limit(most_rows)
    # at most most_rows ids with their labels
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = named.join(F.broadcast(chosen), F.col("id") == F.col("of")).groupBy("id", "y").agg(F.max("text").alias("text")).orderBy(*order("id")).collect()
    texts, y = [r["text"] or "" for r in rows], np.array([int(r["y"] == 1) for r in rows])
    first = np.arange(len(rows)) % 100 < 100 * DICTIONARY_SHARE
    dictionaries = train_dictionaries([t for t, f in zip(texts, first) if f], list(y[first] == 1))
    if dictionaries is None or y[~first].min(initial=1) == y[~first].max(initial=0):
        return None
    profiles = np.array([dictionaries.profile(t) for t, f in zip(texts, first) if not f])
    return dictionaries, calibrate(features(profiles), y[~first])


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Names]:
    """docs under fresh names with score (0 to 1) and predicted (1 from 0.5 on), and the names."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model[0].parts, model[1]))
    plain, own = renamed(docs)
    text = plain.columns.index(own[text_col])

    def run(batches):
        model = shared.value
        dictionaries = Dictionaries(*model[0]) if model else None
        for batch in batches:
            if model and batch.num_rows:
                x = features(np.array([dictionaries.profile(t) for t in batch.column(text).to_pylist()]))
                p = 1 / (1 + np.exp(-np.clip(x @ model[1][:-1] + model[1][-1], -30, 30)))
            else:
                p = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])
        del dictionaries, model
        trim()

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields]
    return plain.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"])), own


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out (no label of it is ever learnt), score and predicted."""
    scored, own = _scored(docs.select(id_col, text_col), labels, id_col, text_col)
    return scored.select(F.col(own[id_col]).alias("doc_id"), (_crc(own[id_col]) % 5 == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic."""
    scored, own = _scored(docs, labels, id_col, text_col)
    return own.restore(scored.where("predicted = 0"))
