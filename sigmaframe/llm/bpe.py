"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A word is encoded greedily with its longest vocabulary match at each position; a token is accepted
only if it is compatible with the one before it, that is if merging the two tokens' joined bytes
gives exactly these two tokens again. When nothing fits, the last token is shortened. Each position
is ruled out at most once, so the work is linear in the word's length, and the accepted sequence is
the one that applying the merges in order would give.

Texts are gathered to about a million characters and cut into words together in NumPy, by a table of
every character's kind; Arrow numbers the words, so each different word of a gathering is looked up
once, and the texts' ids are gathered by the words' numbers. The new words are encoded together too: the
matcher reads them once, and each step (accept, shorten or go back) is taken for all of them at once in
NumPy. Long words are encoded one by one.

Texts are normalised and cut into words here, with Python's tables, but for texts with one of the
characters for which these tables and the tokenizer library's differ (another version of Unicode):
their words come from the library's normaliser and cutter. These characters are found by trying all.
Vocabularies with another pattern than that of `PATTERN` have their texts cut by the pattern itself.

Nulls and empty texts have no tokens; their digests are those of zero bytes. Repeated rows are encoded
each on its own, very long texts as a whole. Ties can't occur: a text has one encoding. Extra columns,
whatever their names, stay as they are or are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import unicodedata
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from .textkit import small_batches, trim

#: Marks the end of a word inside the matcher; it is no symbol of the byte alphabet.
END = "￿"
#: Distinct words kept with their ids by one worker. Only a cache: it is emptied when full.
CACHE_WORDS = 400_000
#: Pairs whose compatibility is kept; also only a cache.
CACHE_PAIRS = 2_000_000
#: Of each cache, the first entries (mostly frequent words) that a worker keeps between tasks.
KEPT = 100_000

#: Symbols of a word that is encoded together with others, at most; such words at a time; characters of texts whose words are gathered, about; and places for the verdicts on pairs of them.
TOGETHER, AT_ONCE, GATHERED, PLACES = 64, 20_000, 1 << 20, 1 << 18

#: The pattern of words that the table of kinds stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
OTHER, SPACE, LETTER, NUMBER = range(4)
WHITE = regex.compile(r"\s")


def byte_alphabet() -> list[str]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every character in PATTERN."""
    every, out = "".join(map(chr, range(sys.maxunicode + 1))), np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, of in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(of, every):
            out[found.start() : found.end()] = kind
    return out


class Encoder:
    """Tokens, merges and pair compatibility of one vocabulary file."""

    def __init__(self, path: str, odd: tuple[tuple[int, int], ...] = ()):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.odd = np.zeros(sys.maxunicode + 1, bool)
        for low, high in odd:
            self.odd[low : high + 1] = True
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {}
        for k, (a, b) in enumerate(pairs):
            made.setdefault(a.removesuffix(self.suffix) + b if self.suffix else a + b, (k, a, b))
        basic = sorted((t for t in vocab if t not in made), key=vocab.get)
        order = basic + sorted(made, key=lambda t: made[t][0])
        rank = {t: k for k, t in enumerate(order)}
        self.ids = [vocab[t] for t in order]
        self.left, self.right, self.joined = list(range(len(order))), list(range(len(order))), {}
        for t, (_, a, b) in made.items():
            self.left[rank[t]], self.right[rank[t]] = rank[a], rank[b]
            self.joined[rank[a], rank[b]] = rank[t]
        self.coded = [i.to_bytes(4, "little") for i in self.ids]
        self.shape = [self._marked(t) for t in order]
        self.length = [len(s) for s in self.shape]
        self.widest = max(self.length)
        self.matcher = ahocorasick.Automaton()
        for k, s in enumerate(self.shape):
            self.matcher.add_word(s, k)
        self.matcher.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        by_shape = {s: k for k, s in enumerate(self.shape)}
        for k, s in enumerate(self.shape):
            self.shorter[k] = next((by_shape[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_shape), -1)
        self.lengths, self.shorter_of, self.left_of, self.right_of = (np.array(x, np.int64) for x in (self.length, [self.shorter[k] for k in range(len(order))], self.left, self.right))
        self.id_of = np.array(self.ids, "<u4")
        codes = np.array([a * len(order) + b for a, b in self.joined], np.int64)
        by_code = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[by_code], np.array(list(self.joined.values()), np.int64)[by_code]
        #: At a pair's place, twice its code and its verdict; a pair that comes to a taken place takes it over.
        self.verdicts = np.full(PLACES, -1, np.int64)
        self.alphabet = byte_alphabet()
        # matches of one and two symbols are looked up by the symbols' numbers, so that the matcher of words read together only reports longer ones
        symbols = sorted({c for t in self.shape for c in t} | set(self.alphabet) | {END})
        self.symbol = np.zeros(ord(max(symbols)) + 1, np.int64)
        self.symbol[[ord(c) for c in symbols]] = np.arange(len(symbols))
        self.singles, self.doubles = np.full(len(symbols), -1, np.int64), np.full(len(symbols) ** 2, -1, np.int32)
        self.longer = ahocorasick.Automaton()
        for k, s in enumerate(self.shape):
            at = self.symbol[[ord(c) for c in s]] if len(s) < 3 else ()
            if len(s) == 1:
                self.singles[at[0]] = k
            elif len(s) == 2:
                self.doubles[at[0] * len(symbols) + at[1]] = k
            else:
                self.longer.add_word(s, k)
        self.longer.make_automaton()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_start = os.path.commonprefix(list(self.special))
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.kinds = kinds() if self.pattern.pattern == PATTERN else None
        self.words: dict[str, bytes] = {}
        shown = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        pieces = [(shown.get(i, "") + " ").encode() for i in range(max(shown) + 1)]
        self.table = np.frombuffer(b"".join(pieces), np.uint8)
        self.table_size = np.array([len(p) for p in pieces], np.int64)
        self.table_at = np.concatenate([[0], np.cumsum(self.table_size)[:-1]])

    def _marked(self, token: str) -> str:
        return token.removesuffix(self.suffix) + END if self.suffix and token.endswith(self.suffix) else token

    def compatible(self, a: int, b: int) -> bool:
        """Whether joining the bytes of tokens a and b (ranks) encodes to these two tokens again."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        bound = len(self.ids)
        while True:
            if self.joined.get((a, b), bound) < bound:
                return False  # a merge across the border would come before one inside
            undo_left = a > b  # the later merge is undone first
            if undo_left and self.right[a] != a:
                bound, a = a, self.right[a]
            elif not undo_left and self.left[b] != b:
                bound, b = b + 1, self.left[b]
            elif undo_left and self.left[b] != b:
                bound, b = b + 1, self.left[b]
            elif not undo_left and self.right[a] != a:
                bound, a = a, self.right[a]
            else:
                return True

    def _compatible_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs."""
        code = a * len(self.ids) + b
        place = ((code * 0x9E3779B1) >> 13) % PLACES
        known = self.verdicts[place]
        fits = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != code)
        if len(new):
            fits[new] = self._undone(a[new], b[new])
            self.verdicts[place[new]] = 2 * code[new] + fits[new]
        return fits

    def _undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_compatible() of many pairs."""
        size = len(self.ids)
        fits, live, bound = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), size)
        while len(live):
            code = a * size + b
            at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            across = (self.pair_codes[at] == code) & (self.pair_ranks[at] < bound)
            fits[live[across]] = False
            in_a, in_b, a_first = self.right_of[a] != a, self.left_of[b] != b, a > b
            undo_a = in_a & (a_first | ~in_b)
            bound = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right_of[a], a), np.where(undo_a, b, self.left_of[b])
            more = np.flatnonzero(~across & (in_a | in_b))
            live, a, b, bound = live[more], a[more], b[more], bound[more]
        return fits

    def _shown(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode("utf-8")])

    def words_together(self, words: list[str]) -> list[bytes]:
        """word() of many words."""
        shown = [self._shown(w) + END for w in words]  # where it isn't a word's mark, it keeps words apart
        alone = {k: self.word(words[k]) for k, s in enumerate(shown) if len(s) > TOGETHER}
        if alone:
            rest = iter(self.words_together([w for k, w in enumerate(words) if k not in alone]))
            return [alone[k] if k in alone else next(rest) for k in range(len(words))]
        if not words:
            return []
        size = np.fromiter(map(len, shown), np.int64, len(shown))
        at = np.cumsum(size) - size
        end = at + size - (0 if self.suffix else 1)
        text = "".join(shown)
        symbols = self.symbol[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        longest = np.full(len(text) + 1, -1, np.int64)
        longest[:-1] = self.singles[symbols]
        double = self.doubles[symbols[:-1] * len(self.singles) + symbols[1:]]
        longest[:-2] = np.where(double >= 0, double, longest[:-2])
        found = np.fromiter(chain.from_iterable(self.longer.iter(text)) if len(self.longer) else (), np.int64).reshape(-1, 2)
        # matches come by their ends, so the longest that starts at a position is written last
        longest[found[:, 0] + 1 - self.lengths[found[:, 1]]] = found[:, 1]
        barred = np.zeros(len(text) + 1, bool)
        if self.suffix:
            barred[end - 1] = True  # the mark belongs to the last symbol
        out, depth, token, live = np.zeros((len(words), int(size.max())), np.int64), np.zeros(len(words), np.int64), longest[at], np.arange(len(words))
        while len(live):
            here, trying, deep = at[live], token[live], depth[live]
            some = trying >= 0
            to = np.where(some, here + self.lengths[trying], here)
            good = some & ~barred[to]
            asked = np.flatnonzero(good & (deep > 0))
            good[asked] = self._compatible_pairs(out[live[asked], deep[asked] - 1], trying[asked])
            k = np.flatnonzero(good)
            w = live[k]
            out[w, deep[k]], depth[w], at[w], token[w] = trying[k], deep[k] + 1, to[k], longest[to[k]]
            k = np.flatnonzero(some & ~good)
            token[live[k]] = self.shorter_of[trying[k]]
            k = np.flatnonzero(~some)
            if len(k):
                w = live[k]
                if not deep[k].all():
                    raise ValueError(f"no encoding of {words[w[deep[k].argmin()]]!r}")
                barred[here[k]] = True
                before = out[w, deep[k] - 1]
                depth[w], at[w], token[w] = deep[k] - 1, here[k] - self.lengths[before], self.shorter_of[before]
            live = live[at[live] < end[live]]
        ids = self.id_of[out[np.arange(out.shape[1]) < depth[:, None]]].tobytes()
        cut = [0, *(4 * np.cumsum(depth)).tolist()]
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def word(self, word: str) -> bytes:
        """The ids of one pre-tokenised word, as little-endian unsigned 32-bit integers."""
        text = self._shown(word)
        n = len(text)
        if self.suffix:
            text += END
            barred = {n}  # the mark belongs to the last symbol
            n += 1
        else:
            barred = set()
        length, shorter, known, widest = self.length, self.shorter, self.fits, self.widest
        longest = self.matcher.iter_long if n <= widest else lambda text, at=0: self.matcher.iter_long(text[at : at + widest])  # the matcher copies what it is given
        out: list[int] = []
        at, token = 0, next(longest(text))[1]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                if at + length[token] not in barred:
                    if last < 0:
                        break
                    fits = known.get((last, token))
                    if fits if fits is not None else self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == n:
                    return b"".join([self.coded[k] for k in out])
                token = next(longest(text, at))[1]
            elif out:
                barred.add(at)
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError(f"no encoding of {word!r}")

    def _known(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.word(word)
            self._keep([(word, ids)])
        return ids

    def _keep(self, fresh: list[tuple[str, bytes]]) -> None:
        """Words and their ids go to the cache, but for long words."""
        if len(self.words) + len(fresh) > CACHE_WORDS:
            self.words.clear()
        self.words.update(islice(((w, i) for w, i in fresh if len(w) <= TOGETHER), CACHE_WORDS))

    def rest(self) -> None:
        """Between tasks, a worker keeps only the first entries of its caches."""
        self.words, self.fits = (dict(islice(c.items(), KEPT)) for c in (self.words, self.fits))
        trim()

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # lower case by character, without the final form
        return text.lower()

    def library_words(self, text: str) -> list[str]:
        """The words of a text by the library's normaliser and cutter."""
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.byte_of[c] for c in w]).decode("utf-8") for w, _ in shown]

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words of normalised texts, the number of each word of the texts among these, and how many words each text has."""
        if self.kinds is None:
            cut, number = [self.pattern.findall(t) for t in texts], {}
            which = np.fromiter((number.setdefault(w, len(number)) for ws in cut for w in ws), np.int64)
            return list(number), which, np.array([len(ws) for ws in cut], np.int64)
        points = np.frombuffer(" ".join([*texts, "", ""]).encode("utf-32-le"), "<u4")
        kind = self.kinds[points]
        first = np.ones(len(points), bool)
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == NUMBER
        # an apostrophe that begins a word takes one of its endings along, and no more letters
        quote = np.flatnonzero(first & (points == ord("'")))
        one, two = points[quote + 1], points[quote + 2]
        short = quote[np.isin(one, [ord(c) for c in "stmd"])]
        long = quote[(((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]
        first[short + 1] = first[long + 1] = False
        first[short + 2] = first[long + 3] = True
        inside = kind != SPACE
        first &= inside
        count = np.diff(np.searchsorted(np.flatnonzero(first), np.cumsum([0, *(len(t) + 1 for t in texts)])))
        kept = points[inside]
        at = 4 * np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int64)
        if len(at) == 1:
            return [], np.zeros(0, np.int64), count
        numbered = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(kept)]).dictionary_encode()
        _, where, what = numbered.dictionary.buffers()
        bound = (np.frombuffer(where, np.int64)[: len(numbered.dictionary) + 1] // 4).tolist()
        shown = what.to_pybytes()[: 4 * bound[-1]].decode("utf-32-le")
        return [shown[a:b] for a, b in zip(bound, bound[1:])], numbered.indices.to_numpy(), count

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of normalised texts."""
        words, which, count = self._cut(texts)
        ids = list(map(self.words.get, words))
        new = [k for k, known in enumerate(ids) if known is None]
        for low in range(0, len(new), AT_ONCE):
            some = new[low : low + AT_ONCE]
            for k, made in zip(some, self.words_together([words[k] for k in some])):
                ids[k] = made
        self._keep([(words[k], ids[k]) for k in new])
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, size = (np.cumsum(size) - size)[which], size[which]
        end = np.cumsum(size)
        coded = flat[np.repeat(start - (end - size), size) + np.arange(size.sum())].tobytes()
        bound = (4 * np.append(0, end)[np.append(0, np.cumsum(count))]).tolist()
        return [coded[a:b] for a, b in zip(bound, bound[1:])]

    def _pieces(self, text: str) -> list[str]:
        """A normalised text, cut at white space if it is long."""
        out, low = [], 0
        while self.kinds is not None and len(text) - low > GATHERED and (found := WHITE.search(text, low + GATHERED)):
            out.append(text[low : found.start()])
            low = found.start()
        return [*out, text[low:]]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special strings."""
        odd = [not t.isascii() and self.odd[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")].any() for t in texts]
        normal = [self.normal(t) for t, o in zip(texts, odd) if not o]
        size = sum(map(len, normal))
        if size <= TOGETHER:
            made = iter([b"".join(map(self._known, self.pattern.findall(t))) for t in normal])
        elif size <= 2 * GATHERED:
            made = iter(self._joined(normal))
        else:
            made = (b"".join([self._joined([p])[0] for p in self._pieces(t)]) for t in normal)
        return [b"".join(map(self._known, self.library_words(t))) if o else next(made) for t, o in zip(texts, odd)]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; the vocabulary's special strings become their ids, as in the library."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts."""
        out, low = [], 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high] or "") <= GATHERED):
                size += len(texts[high] or "")
                high += 1
            out += self._gathered(texts[low:high])
            low = high
        return out

    def _gathered(self, texts: list[str | None]) -> list[bytes]:
        parts = [None if not t or self.special_cut is None or self.special_start not in t else [p for p in self.special_cut.split(t) if p] for t in texts]
        plain = iter(self._plain([p for t, ps in zip(texts, parts) for p in ([t or ""] if ps is None else [p for p in ps if p not in self.special])]))
        return [next(plain) if ps is None else b"".join([np.array([self.special[p]], "<u4").tobytes() if p in self.special else next(plain) for p in ps]) for ps in parts]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings joined by spaces, gathered from one byte table by offsets."""
        out = []
        for k in range(0, len(ids), 1 << 20):
            which = np.frombuffer(ids[k : k + (1 << 20)], "<u4")
            size = self.table_size[which]
            shift = np.repeat(self.table_at[which] - (np.cumsum(size) - size), size)
            shift += np.arange(len(shift))
            out.append(self.table[shift].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def odd_characters(path: str) -> tuple[tuple[int, int], ...]:
    """Ranges of the characters that Python and the library normalise or class differently, and for those unknown to Python."""
    enc = Encoder(path)

    def differs(text: str) -> bool:
        return enc.pattern.findall(enc.normal(text)) != enc.library_words(text)

    odd = []
    for low in range(0, sys.maxunicode + 1, 128):
        known = []
        for c in range(low, low + 128):
            category = unicodedata.category(chr(c))
            if category == "Cn":
                odd.append(c)
            elif category != "Cs":
                known.append(c)
        if known and differs(" ".join(f"a{chr(c)}b" for c in known)):
            odd += [c for c in known if differs(f"a{chr(c)}b")]
    ranges: list[list[int]] = []
    for c in sorted(odd):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return tuple(map(tuple, ranges))


@lru_cache(maxsize=2)
def encoder(path: str, odd: tuple[tuple[int, int], ...]) -> Encoder:
    return Encoder(path, odd)


def encode_column(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds an array of token ids to each row, or replaces a column of that name; null and empty texts get an empty array."""
    docs = docs.drop(ids_col) if ids_col != text_col else docs
    small_batches(docs.sparkSession)
    names, odd = docs.columns, odd_characters(path)

    def run(batches):
        enc = encoder(path, odd)
        for batch in batches:
            ids = enc.encode_all(batch.column(names.index(text_col)).to_pylist())
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), flat)], [*names, ids_col])
        enc.rest()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*kept, f"`{ids_col}` array<int>"]))


def decode_column(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of an id array to each row; null and empty arrays decode to an empty text."""
    names, odd = tokens.columns, odd_characters(path)

    def run(batches):
        enc = encoder(path, odd)
        for batch in batches:
            texts = [enc.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8") for x in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out_col])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields]
    return tokens.mapInArrow(run, ", ".join([*kept, f"`{out_col}` string"]))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: number of tokens, digest of its ids and digest of their decoded text."""
    small_batches(docs.sparkSession)
    odd = odd_characters(path)

    def run(batches):
        enc = encoder(path, odd)
        for batch in batches:
            n, a, b = [], [], []
            for ids in enc.encode_all(batch.column(1).to_pylist()):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.rest()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
