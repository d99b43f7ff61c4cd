"""BPE encoding and decoding of whole texts with a public tokenizer file.

Ids are those of the ``tokenizers`` library (no added special tokens, truncation or
padding).  A text is cut before every blank that something else than white space follows
(whatever might count as such, as a no-break space, included); such a place is always a
border between pre-tokens, so pieces encode independently.  The different pieces of a
slice are encoded once (a cache of bounded size keeps short ones); ids, their digits and
their bytes are put together by Arrow.

Long texts go another way, by tree concatenation.  They are cut into segments that
different tasks encode.  Where a run has no border for more than ``PIECE`` characters
the run is cut into halves, and halves of halves; neighbours are joined in a tree: the
tokens around a join are decoded and encoded again, in a window that grows until its
outermost tokens agree with both sides.  A sequence in which all neighbouring tokens
are compatible is the only encoding of its text, so the result is exact.

Defined cases: null and empty texts have no tokens and decode to the empty text; a
special token's literal in a text is that token, as in the library.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.llm.arrays import text_buffers
from itemlens.llm.common import map_texts
from itemlens.session import materialize

LONG = 32768
SEGMENT = 16384
PIECE = 4096
CACHE = 100_000
#: Text bytes that are encoded together.
SLICE = 2 << 20
CACHED_BYTES = 64

#: White space and whatever may or may not count as such: no border is sure before these.
_ODD_SPACE = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff"
_BORDER = re.compile(f" (?=[^{_ODD_SPACE}])")
#: The same by UTF-8 bytes: a blank before one of these is no sure border (the lead bytes
#: also begin other characters, before which a border is merely not used).
_UNSURE = np.zeros(256, bool)
_UNSURE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> dict[int, str]:
    """The characters by which byte-level BPE names bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.specials = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special_re = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        #: 32-bit ids, as bytes, of pieces seen lately, and of those seen before them.
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @cached_property
    def names(self) -> dict[int, str]:
        """Tokens in byte characters."""
        return {i: s for s, i in self.tok.get_vocab(with_added_tokens=False).items()}

    @cached_property
    def bytes(self) -> pa.Array:
        """What each id decodes to."""
        back = {c: b for b, c in byte_chars().items()}
        known = {i: bytes(back[c] for c in s) for i, s in self.names.items()}
        known |= {i: s.encode() for s, i in self.specials.items()}
        return pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.binary())

    @cached_property
    def decimals(self) -> pa.Array:
        """Each id in decimal digits and a comma."""
        return pa.array([b"%d," % i for i in range(len(self.bytes))], pa.binary())

    # whole texts -------------------------------------------------------------

    def pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces that encode independently and add up to the texts, and the number of
        the first piece of each text (and their total)."""
        data, offsets = text_buffers(column)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        border = np.zeros(len(data), bool)
        border[:-1] = (data[:-1] == 32) & ~_UNSURE[data[1:]] & ~edge[1:-1]
        raw = data.tobytes()
        for special in self.specials:
            at = raw.find(special.encode())
            while at >= 0:  # a text with such a literal is one piece
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                border[offsets[text] : offsets[text + 1]] = False
                at = raw.find(special.encode(), int(offsets[text + 1]))
        starts = np.flatnonzero(border | edge[:-1])
        ends = np.append(starts, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]), np.searchsorted(starts, offsets)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts among them); a piece that comes often
        is encoded once."""
        pieces, first = self.pieces(column)
        if not len(pieces):
            return np.zeros(0, np.int32), first
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_pylist()
        found = [self.cache.get(p) or self.older.get(p) for p in different]
        fresh = [i for i, ids in enumerate(found) if ids is None]
        for lo in range(0, len(fresh), 4096):
            part = fresh[lo : lo + 4096]
            for i, e in zip(part, self.tok.encode_batch_fast([different[i].decode() for i in part], add_special_tokens=False), strict=True):
                found[i] = array("i", e.ids).tobytes()
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache
        self.cache.update((p, ids) for p, ids in zip(different[:CACHE], found, strict=False) if len(p) <= CACHED_BYTES)
        size = np.array([len(f) for f in found]) // 4
        lists = pa.ListArray.from_arrays(_offsets(size), pa.array(np.frombuffer(b"".join(found), np.int32)))
        number = coded.indices.to_numpy()
        ids = lists.take(coded.indices).flatten().to_numpy()
        return ids, np.concatenate([[0], np.cumsum(size[number])])[first]

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        return b"".join(self.bytes.take(pa.array(ids, pa.int32())).to_pylist())

    def decode(self, ids: Sequence[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    # tree concatenation ------------------------------------------------------

    def fragment(self, chars: str) -> list[int]:
        """Ids of a part of one pre-token, written in byte characters."""
        return [t.id for t in self.tok.model.tokenize(chars)]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbouring parts of a pre-token."""
        if not a or not b:
            return a or b
        size = 4
        while True:
            left, right = a[-size:], b[:size]
            both = self.fragment("".join(self.names[i] for i in left + right))
            whole_a, whole_b = len(left) == len(a), len(right) == len(b)
            agrees_a = whole_a or both[:2] == left[:2]
            agrees_b = whole_b or both[-2:] == right[-2:]
            if agrees_a and agrees_b:
                return a[: len(a) - len(left)] + both + b[len(right) :]
            size *= 2

    def concat(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def segments(self, text: str) -> list[tuple[int, int, str, str]]:
        """(run, number, kind, content) rows of a long text.

        kind ``text`` encodes by itself, ``special`` is one special token, and the
        ``half`` rows of a run are parts of one pre-token, in byte characters;
        ``pretokens`` are whole short ones between such runs, with blanks between.
        """
        out: list[tuple[int, int, str, str]] = []
        rest = [(text, False)]
        if self.special_re and self.special_re.search(text):
            rest, at = [], 0
            for m in self.special_re.finditer(text):
                rest += [(text[at : m.start()], False), (m[0], True)]
                at = m.end()
            rest.append((text[at:], False))
        for part, special in rest:
            if special:
                out.append((len(out), 0, "special", part))
                continue
            at, last = 0, 0
            for b in [*(m.start() for m in _BORDER.finditer(part)), len(part)]:
                if b - at > SEGMENT and last > at:
                    self._add(out, part[at:last])
                    at = last
                last = b
            self._add(out, part[at:])
        return out

    def _add(self, out: list, part: str) -> None:
        if len(part) <= SEGMENT:
            if part:
                out.append((len(out), 0, "text", part))
            return
        short: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if short:
                out.append((len(out), 0, "pretokens", " ".join(short)))
                short.clear()
            size = 0

        for chars, _ in self.tok.pre_tokenizer.pre_tokenize_str(part):
            if len(chars) <= PIECE:
                if size + len(chars) > SEGMENT:
                    flush()
                short.append(chars)
                size += len(chars)
                continue
            flush()
            step = len(chars)
            while step > PIECE:
                step = -(-step // 2)
            run = len(out)
            out += [(run, i // step, "half", chars[i : i + step]) for i in range(0, len(chars), step)]
        flush()

    def encode_segment(self, kind: str, content: str) -> list[int]:
        if kind == "special":
            return [self.specials[content]]
        if kind == "text":
            return self.encode(content)
        return [i for chars in content.split(" ") for i in self.fragment(chars)]

    def encode_long(self, text: str) -> list[int]:
        """Tree concatenation within one process (the distributed form's reference)."""
        return self.merge((run, no, self.encode_segment(kind, s)) for run, no, kind, s in self.segments(text))

    def merge(self, rows: Iterable[tuple[int, int, list[int]]]) -> list[int]:
        runs: dict[int, list[tuple[int, list[int]]]] = {}
        for run, no, ids in rows:
            runs.setdefault(run, []).append((no, ids))
        out: list[int] = []
        for run in sorted(runs):
            out += self.concat([ids for _, ids in sorted(runs[run])])
        return out


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _joined(names: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """The names of each text's ids, one after the other."""
    data, at = text_buffers(names.take(pa.array(ids)))
    bounds = at[offsets].tolist()
    data = memoryview(data)
    return (data[a:b] for a, b in itertools.pairwise(bounds))


def _digests(codec: Codec, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256 of texts, whose ids lie one after the other."""
    listed = [_sha(text[:-1]) for text in _joined(codec.decimals, ids, offsets)]
    decoded = [_sha(str(text, "utf-8", "replace").encode()) for text in _joined(codec.bytes, ids, offsets)]
    return [pa.array(np.diff(offsets), pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]


def _long_ids(rows: DataFrame, path: str) -> DataFrame:
    """(row, ids) of long texts ``rows`` (row, text): segments are encoded by any tasks,
    then each text's segments come together and are joined in a tree."""

    def cut(batches):
        codec = Codec(path)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = codec.segments(text)
                run, no, kind, content = zip(*parts, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(parts), pa.int64()), pa.array(run, pa.int32()), pa.array(no, pa.int32()), pa.array(kind), pa.array(content)],
                    names=["row", "run", "no", "kind", "content"],
                )

    def encode_parts(batches):
        codec = Codec(path)
        for batch in batches:
            ids = [codec.encode_segment(k, c) for k, c in zip(batch.column("kind").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "run", "no")), pa.array(ids, pa.list_(pa.int32()))], names=["row", "run", "no", "ids"]
            )

    def together(group: pa.Table) -> pa.Table:
        codec = _shared(path)
        ids = codec.merge(zip(*(group.column(c).to_pylist() for c in ("run", "no", "ids")), strict=True))
        return pa.table({"row": group.column("row").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    parts = rows.select("row", "text").mapInArrow(cut, "row long, run int, no int, kind string, content string")
    spread = parts.repartition(F.col("row"), F.col("run"), F.col("no"))
    done = spread.mapInArrow(encode_parts, "row long, run int, no int, ids array<int>")
    return done.groupBy("row").applyInArrow(together, "row long, ids array<int>")


_CODECS: dict[str, Codec] = {}


def _shared(path: str) -> Codec:
    """One codec per worker process, for functions that run once in each group."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _split(docs: DataFrame, columns: Sequence[str], long: int) -> tuple[DataFrame, DataFrame]:
    """Texts of up to ``long`` characters, and the longer ones with a number in ``row``."""
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text"])])
    big = F.coalesce(F.length("text"), F.lit(0)) > long
    rows = materialize(docs.where(big).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    return docs.where(~big), rows


def roundtrip(docs: DataFrame, path: str | None = None, long: int = LONG) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and
    decoded_sha256 (of the text that the ids decode to)."""
    path = path or tokenizer_path()

    def short():
        codec = Codec(path)
        return lambda texts: _digests(codec, *codec.encode_column(texts))

    def digest(batches):
        codec = Codec(path)
        for batch in batches:
            ids = batch.column("ids")
            made = _digests(codec, ids.flatten().to_numpy(), _offsets(ids.value_lengths().to_numpy()).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    small, big = _split(docs, ["doc_id"], long)
    big_done = _long_ids(big, path).mapInArrow(digest, f"row long, {schema}")
    return map_texts(small, short, schema, limit=SLICE).unionByName(big.select("row", "doc_id").join(big_done, "row").drop("row"))


def encode(docs: DataFrame, carry: Sequence[str] = ("doc_id",), path: str | None = None, long: int = LONG) -> DataFrame:
    """``carry`` columns and ``ids``, the token ids of the whole text."""
    path = path or tokenizer_path()

    def short():
        codec = Codec(path)

        def work(texts: pa.Array):
            ids, offsets = codec.encode_column(texts)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

        return work

    small, big = _split(docs, carry, long)
    big_done = big.drop("text") if "text" not in carry else big
    return map_texts(small, short, "ids array<int>", carry=carry, limit=SLICE).unionByName(big_done.join(_long_ids(big, path), "row").select(*carry, "ids"))


def decode(rows: DataFrame, carry: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``carry`` columns and ``decoded``, the text of the ids (null ids: the empty text)."""
    path = path or tokenizer_path()
    import pyspark.sql.types as T

    out = T.StructType([rows.schema[c] for c in carry] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(texts, pa.string())], names=out.names)

    return rows.select(*carry, "ids").mapInArrow(run, out)
