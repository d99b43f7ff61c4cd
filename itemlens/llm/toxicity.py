"""Toxicity by noisy-channel deobfuscation and scoring of the restored text.

1. A character trigram model is counted over all documents.
2. Disguised words (leetspeak, letters set apart, letters repeated) become lattices:
   every observed character may stand for itself, for the letters it imitates, or,
   where it repeats or separates, for nothing.  Viterbi decoding finds the most likely
   word under channel costs and the character model.
3. A logistic model over words and word beginnings, present or not, scores the
   restored text.  It learns from a sample of the labelled rows, at most about
   ``TRAIN_ROWS`` of them, chosen by a hash of the id (by a hash of id and text, and at
   most about twice as many, where ids have many rows); labels of held-out rows are
   never read, and id, language, source and labels are no inputs of a score.

What reaches the driver is bounded: ``ALPHABET ** 3`` counts, ``SELECTED`` features
and the sample's selected features.

Defined cases: null and empty texts have no features and get the model's base score;
repeated label rows count as one row, toxic if any is; equal rows are one example; null labels are ignored; with
no labels of both kinds every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens.llm.arrays import mix64, slices, span_hashes, text_buffers, thrifty_batches, words
from itemlens.llm.common import map_texts

ALPHABET = 61
TRAIN_ROWS = 40_000
BUCKETS = 1 << 20
SELECTED = 4096
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
HELD_MODULUS, HELD_REMAINDER = 4, 2
CACHE = 50_000
#: Text bytes whose words are cut and restored at once (a task holds some 40 times as many).
SLICE = 1 << 20
#: Longer words are decoded anew each time.
CACHED_WORD = 64

#: Letters that a sign imitates.
LEET = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "*": "aeiou",
}
#: Log costs of the channel.
AS_LETTER, DROPPED, KEPT_TWICE = -0.7, -9.0, -1.0
#: At a word's end a sign may be a sign: punctuation at no cost, others seldom.
PUNCTUATION, AS_SIGN = "!|+(*", -3.0

_SIGNS = "".join(re.escape(c) for c in LEET)

_TOKEN = re.compile(rf"[\w{_SIGNS}]+")
_APART = re.compile(rf"(?<![\w{_SIGNS}])(?:[^\W_]|[{_SIGNS}])(?:[\x20\t\n\r.\-_*]++(?:[^\W_]|[{_SIGNS}])(?![^\W_])){{2,}}(?!\w)")
_THRICE = re.compile(r"([^\W\d_])\1\1")


def char_code(c: str) -> int:
    """0: no letter; 1-26: a-z; 27-59: Latin-1 letters; 60: other letters."""
    c = c.lower()[:1]
    if "a" <= c <= "z":
        return ord(c) - 96
    if "\xdf" <= c <= "\xff" and c != "\xf7":
        return 27 + ord(c) - 0xDF
    return 60 if c.isalpha() else 0


_CODES = np.array([char_code(chr(c)) if not 0xD800 <= c < 0xE000 else 0 for c in range(0x250)] + [60], np.int64)


def _trigrams(column: pa.Array) -> np.ndarray:
    """Counts of code trigrams; texts are bordered by two non-letters."""
    joined = "  ".join(["", *(t or "" for t in column.to_pylist()), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CODES[np.minimum(points, 0x250)]
    keep = np.ones(len(codes), bool)
    keep[2:] = (codes[2:] > 0) | (codes[1:-1] > 0) | (codes[:-2] > 0)
    codes = codes[keep]
    return np.bincount((codes[:-2] * ALPHABET + codes[1:-1]) * ALPHABET + codes[2:], minlength=ALPHABET**3)


class CharModel:
    """Interpolated character trigram log probabilities."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + ALPHABET)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                total += _trigrams(part.column("text"))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(thrifty_batches(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ALPHABET**3, np.int64)
    for r in rows:
        counts[r.code] = r.n
    return counts


def _spots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which a word looks disguised, and at which letters stand apart."""
    kind = _BYTE_KIND[data]
    letter, sign, blank = kind == 1, kind == 2, (kind == 3) | (data == 0x2A)
    some = letter | sign
    odd, apart = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data) > 2:
        odd[1:-1] = (sign[1:-1] & letter[:-2] & some[2:]) | (letter[1:-1] & (data[1:-1] == data[:-2]) & (data[1:-1] == data[2:]))
        odd[:-2] |= sign[:-2] & some[1:-1] & letter[2:]
        odd[1:] |= (kind[1:] == 2) & letter[:-1] & ~_PUNCTUATION[data[1:]]
        euro = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x82) & (data[2:] == 0xAC))
        odd[euro] = True
    # Single characters: at least three, with any run of separators between them.
    edge = np.zeros(len(data) + 1, np.int64)
    edge[offsets] = 1
    at = np.flatnonzero(~blank & ((data & 0xC0) != 0x80))
    if len(at) > 2:
        far = np.diff(np.cumsum(blank + edge[:-1])[at], prepend=-1, append=np.iinfo(np.int64).max) > 0
        lone = some[at] & far[:-1] & far[1:]
        apart[at[1:-1][lone[:-2] & lone[1:-1] & lone[2:]]] = True
    return odd, apart


_BYTE_KIND = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalpha() or _c >= 0x80:
        _BYTE_KIND[_c] = 1
    elif chr(_c) in LEET:
        _BYTE_KIND[_c] = 2
    elif _c in b" \t\n\r.-_":
        _BYTE_KIND[_c] = 3
_PUNCTUATION = np.array([chr(c) in PUNCTUATION for c in range(256)])


class Restorer:
    """Replaces disguised words by their most likely readings."""

    def __init__(self, model: CharModel):
        self.log = model.log
        self.cache: dict[str, tuple[str, float]] = {}
        self.words: dict[str, str] = {}

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        out: list[list[tuple[str, float]]] = []
        i, tail = 0, len(word.rstrip(_TAIL))
        while i < len(word):
            c, j = word[i], i
            while j < len(word) and word[j] == c:
                j += 1
            if char_code(c):
                options = [(word[i:j], 0.0)] if j - i < 3 else [(c, 0.0), (c + c, KEPT_TWICE)]
            else:
                # Two signs rather stand for two letters, more for a stretched one.
                one, two = (KEPT_TWICE, 0.0) if j - i == 2 else (0.0, KEPT_TWICE)
                options = [(x, AS_LETTER + one) for x in LEET.get(c, "")]
                options += [(x + x, AS_LETTER + two) for x in LEET.get(c, "")] if j - i > 1 else []
                if i >= tail:
                    options.append((word[i:j], 0.0 if c in PUNCTUATION else AS_SIGN))
                options.append(("", DROPPED))
            out.append(options)
            i = j
        return out

    def decode(self, word: str) -> str:
        return self.reading(word)[0]

    def reading(self, word: str) -> tuple[str, float]:
        """Viterbi over the lattice; the state is the last two characters."""
        if (known := self.cache.get(word)) is not None:
            return known
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*self.lattice(word), [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for letters, cost in options:
                    s, x, y = score + cost, a, b
                    for c in letters:
                        k = char_code(c)
                        if k or y:  # signs behind a word's end are free
                            s += self.log[x][y][k]
                        x, y = y, k
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = s, (path, letters)
            best = after
        score, path = max(best.values(), key=lambda v: v[0])
        letters = []
        while path is not None:
            path, some = path
            letters.append(some)
        out = "".join(reversed(letters)).strip() or word, score
        if len(word) <= CACHED_WORD:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = out
        return out

    def word(self, word: str) -> str:
        """A word without blanks, with its disguised parts restored."""
        if (known := self.words.get(word)) is None:
            known = _TOKEN.sub(self._token, word.lower())
            if len(word) <= CACHED_WORD:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[word] = known
        return known

    def _apart(self, m: re.Match) -> str:
        """Letters set apart as one word, if that is likelier than single letters."""
        joined = _BETWEEN.sub("", m[0]).lower()
        codes = [k for k in map(char_code, joined) if k]
        if not codes:
            return m[0]
        text, score = self.reading(joined)
        single = sum(self.log[0][0][k] + self.log[0][k][0] for k in codes)
        return text if score > single else m[0]

    def _token(self, m: re.Match) -> str:
        word = m[0]
        if not any(map(char_code, word)) or not all(char_code(c) or c in LEET for c in word):
            return word
        if all(map(char_code, word)) and not _THRICE.search(word):
            return word
        if all(c in PUNCTUATION for c in word[len(word.rstrip(_TAIL)) :]) and all(map(char_code, word.rstrip(_TAIL))) and not _THRICE.search(word):
            return word
        return self.decode(word)

    def restore(self, text: str) -> str:
        return _BLANKS.sub(lambda m: self.word(m[0]), _APART.sub(self._apart, text))


_TAIL = "".join(LEET)
_BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
_BETWEEN = re.compile(r"(?<=.)[\x20\t\n\r.\-_*]+(?=.)", re.DOTALL)


def restored(column: pa.Array, restorer: Restorer) -> pa.Array:
    """The column with disguised words restored; other words stay as they are."""
    data, offsets = text_buffers(column)
    odd, apart = _spots(data, offsets)
    odd_at, apart_at = np.flatnonzero(odd), np.flatnonzero(apart)
    if not len(odd_at) and not len(apart_at):
        return column
    changed: dict[int, str] = {}
    whole = np.unique(np.searchsorted(offsets, apart_at, side="right") - 1)
    for i in whole.tolist():
        changed[i] = restorer.restore(column[i].as_py() or "")
    w = words(column)
    edits: dict[int, list[tuple[int, int, str]]] = {}
    number = np.unique(np.searchsorted(w.starts, odd_at, side="right") - 1)
    for k in number[number >= 0].tolist():
        a, b = int(w.starts[k]), int(w.ends[k])
        old = data[a:b].tobytes().decode("utf-8", "replace")
        if (new := restorer.word(old)) != old:
            edits.setdefault(int(np.searchsorted(w.offsets, k, side="right")) - 1, []).append((a, b, new))
    for i, spans in edits.items():
        if i not in changed:
            out, at = [], int(offsets[i])
            for a, b, new in spans:
                out += [data[at:a].tobytes(), new.encode()]
                at = b
            out.append(data[at : int(offsets[i + 1])].tobytes())
            changed[i] = b"".join(out).decode("utf-8", "replace")
    if not changed:
        return column
    return pa.array([changed.get(i, t) for i, t in enumerate(column.to_pylist())], pa.string())


_BREAK = np.array([not (chr(c).isascii() and chr(c).isalnum() or c >= 0x80) for c in range(256)])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed feature) of all words and their beginnings."""
    w = words(column, _BREAK)
    doc = np.repeat(np.arange(len(column)), w.counts())
    ids, docs = [w.hashes % np.uint64(BUCKETS)], [doc]
    for k in PREFIXES:
        long = w.ends - w.starts >= k
        start = w.starts[long]
        ids.append(mix64(span_hashes(w.data, start, start + k) + np.uint64(k)) % np.uint64(BUCKETS))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(ids).astype(np.int64)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's labels are kept from training (a null id counts as the empty text)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_MODULUS == HELD_REMAINDER


class Scorer:
    """Logistic model over present features."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))
        self.weights, self.bias = weights, bias

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        doc, ids = features(column)
        place = self.place[ids]
        seen = np.unique(doc[place >= 0] * max(1, len(self.weights)) + place[place >= 0])
        return np.divmod(seen, max(1, len(self.weights)))

    def scores(self, column: pa.Array) -> np.ndarray:
        doc, place = self.present(column)
        z = np.bincount(doc, weights=self.weights[place], minlength=len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, model, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Learn from labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = max(1, -(-known.count() // train_rows))
    # At most about train_rows small rows: bounded, whatever the size of the labels.
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # An id may have many rows.  Equal ones are one example; of more than twice train_rows
    # different ones a share by hash stays.
    text_key = F.xxhash64("doc_id", "text")
    share = max(1, rows.agg(F.approx_count_distinct(text_key)).first()[0] // train_rows)
    rows = rows.where(F.pmod(text_key, F.lit(share)) == 0)
    rows = rows.groupBy("doc_id", "text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        total = np.zeros((2, BUCKETS), np.int64)
        size = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, ids = features(restored(part.column("text"), restorer))
                y = np.array(part.column("toxic").to_pylist(), np.int64) > 0
                size += np.bincount(y.astype(int), minlength=2)
                doc, ids = np.divmod(np.unique(doc * BUCKETS + ids), BUCKETS)
                for k in (0, 1):
                    total[k] += np.bincount(ids[y[doc] == k], minlength=BUCKETS)
        code = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(code, -1)), pa.array(np.append(total[0][code], size[0])), pa.array(np.append(total[1][code], size[1]))],
            names=["feature", "clean", "toxic"],
        )

    counts = rows.mapInArrow(thrifty_batches(counted), "feature long, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    sizes = counts.where("feature = -1").first()
    n0, n1 = (sizes.b, sizes.a) if sizes else (0, 0)
    nothing = Scorer(np.zeros(0, np.int64), np.zeros(0), math.log((n1 + 0.1) / (n0 + 0.9)))
    if not n0 or not n1:
        return nothing
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    gap = a * (n0 - b) - b * (n1 - a)
    chi = gap * gap * float(n0 + n1) / ((a + b) * (n0 + n1 - a - b) * float(n0) * float(n1))
    top = counts.where((F.col("feature") >= 0) & (a >= 2) & (a * n0 > b * n1)).select("feature", F.coalesce(chi, F.lit(0.0)).alias("chi"))
    chosen = np.array([r.feature for r in top.orderBy(F.desc("chi"), "feature").limit(SELECTED).collect()], np.int64)
    if not len(chosen):
        return nothing
    picker = docs.sparkSession.sparkContext.broadcast(Scorer(chosen, np.zeros(len(chosen)), 0.0))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, place = picker.value.present(restored(part.column("text"), restorer))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(place, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), lists], names=["toxic", "features"])

    sample_rows = rows.mapInArrow(thrifty_batches(picked), "toxic int, features array<int>").toArrow()
    y = np.array(sample_rows.column("toxic").to_pylist(), float)
    lists = sample_rows.column("features").to_pylist()
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    place = np.array([p for x in lists for p in x], np.int64)
    weights, bias = logistic(doc, place, (y > 0).astype(float), len(chosen))
    return Scorer(chosen, weights, bias)


def logistic(doc: np.ndarray, place: np.ndarray, y: np.ndarray, n: int, steps: int = 250, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Ridge-regularised logistic regression over present features, by Adam."""
    w = np.zeros(n + 1)
    w[n] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = np.bincount(doc, weights=w[place], minlength=len(y)) + w[n]
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(place, weights=r[doc], minlength=n), r.sum()) / len(y)
        g[:n] += ridge * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w[:n], float(w[n])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ("doc_id",), train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """``carry`` columns and ``score`` (0 to 1, higher: toxic likelier) of every whole text."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast(CharModel(char_counts(docs)))
    scorer = context.broadcast(fit(docs, labels, model, train_rows))

    def make():
        restorer = Restorer(model.value)
        return lambda texts: [pa.array(scorer.value.scores(restored(texts, restorer)), pa.float64())]

    return map_texts(docs, make, "score double", carry=carry, limit=SLICE)


def crc_held(doc_id) -> bool:
    """``held_out`` for one id, for tests."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % HELD_MODULUS == HELD_REMAINDER
