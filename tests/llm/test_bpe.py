import hashlib
import random

import pyarrow as pa

from itemlens.llm import bpe as B

ALPHABETS = ["abcdefghij", "theandingoftion", "éèçñß", "0123456789", "!?.,-'", "日本語", "  \n\t\r", "aA1 é.\n  ", "'strevld m", "   x"]


def texts(seed, n, longest=6000):
    rng = random.Random(seed)
    out = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "a" * 5000, "ab" * 4000 + " x", "\u0000\u0007"]
    for _ in range(n):
        t = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 60)))
        one = rng.choice(ALPHABETS)
        out.append(t + "".join(rng.choice(one) for _ in range(rng.randint(0, longest))))
    return out


def test_pieces_and_tree_equal_the_library(monkeypatch):
    codec = B.Codec(B.tokenizer_path())
    for k, text in enumerate(texts(3, 120)):
        want = codec.tok.encode(text, add_special_tokens=False).ids
        monkeypatch.setattr(B, "SEGMENT", (40, 500, 3000)[k % 3])
        monkeypatch.setattr(B, "PIECE", (16, 64, 500)[k % 3])
        assert codec.encode_long(text) == want
        cut, first = codec.pieces(pa.array([text, text]))
        assert b"".join(cut.to_pylist()[: first[1]]).decode() == text
        ids, offsets = codec.encode_column(pa.array([text, None, text]))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [want, [], want]
        assert codec.decode(want) == codec.tok.decode(want, skip_special_tokens=False)


def test_odd_blanks_keep_the_borders():
    codec = B.Codec(B.tokenizer_path())
    odd = ["\xa0", "\u3000", "\x85", "\u2009", "\ufeff", "\x1c", "\u200b", "\u180e"]
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice([" ", " ", "a", "b1", "é", "日", "\n", *odd]) for _ in range(rng.randint(1, 30)))
        ids, _ = codec.encode_column(pa.array([text]))
        assert ids.tolist() == codec.tok.encode(text, add_special_tokens=False).ids, repr(text)
    text = "some words in a row " * 6_000 + "\xa0" + " and then others" * 8_000
    parts = codec.segments(text)
    assert len(text) > 240_000 and len(parts) > 14
    assert codec.encode_long(text) == codec.tok.encode(text, add_special_tokens=False).ids


def test_short_pretokens_in_bounded_rows():
    codec = B.Codec(B.tokenizer_path())
    text = "ab1." * 30_000  # no border anywhere
    parts = codec.segments(text)
    assert len(parts) > 5 and max(len(p[3]) for p in parts) < 2.5 * B.SEGMENT
    assert codec.encode_long(text) == codec.tok.encode(text, add_special_tokens=False).ids


def test_table_equals_the_library(spark, frame):
    rows = list(enumerate(texts(4, 30))) + [(None, None), (None, "x"), (3, "again")]
    codec = B.Codec(B.tokenizer_path())
    ids = [codec.tok.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((i, len(x), sha(",".join(map(str, x))), sha(codec.tok.decode(x, skip_special_tokens=False))) for (i, _), x in zip(rows, ids)), key=repr)
    got = B.roundtrip(frame(rows), long=700)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    coded = B.encode(frame(rows), long=700)
    assert sorted(((r.doc_id, list(r.ids)) for r in coded.collect()), key=repr) == sorted(((i, x) for (i, _), x in zip(rows, ids)), key=repr)
    back = B.decode(coded)
    assert sorted(r.decoded for r in back.collect()) == sorted(codec.tok.decode(x, skip_special_tokens=False) for x in ids)
    assert B.roundtrip(frame(rows).limit(0)).count() == 0
