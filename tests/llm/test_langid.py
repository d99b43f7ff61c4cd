"""Language profiles against plain counting, and predictions of texts held out."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from itemlens.llm import langid as L
from itemlens.llm.queries import QUERIES

LEARN = [
    ("the cat sat on the mat and the dog ran to the house", "en"),
    ("this is the thing that they thought through", "en"),
    ("der hund und die katze sind in dem haus", "de"),
    ("das ist nicht der richtige weg zur straße", "de"),
    ("le chat est sur la table et le chien dort", "fr"),
]


def plain(text):
    """n-grams of one to three letters of each word with a blank on both sides."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    out = Counter()
    for word in letters.split():
        word = f" {word} "
        out.update(word[1:-1])
        out.update(word[i : i + 2] for i in range(len(word) - 1))
        out.update(word[i : i + 3] for i in range(len(word) - 2))
    return out


def number(gram):
    total = 0
    for c in gram:
        total = total << 21 | ord(c)
    return total


TEXTS = ["", None, "  12 .", "a", "ab c", "Straße ΑΣ x-y_z ½", "漢字 𝔘x é", "the the  the\nthe", "xyz " * 400]


@pytest.mark.parametrize("part", [1 << 20, 5])
def test_counts(monkeypatch, part):
    monkeypatch.setattr(L, "PART", part)
    row, gram, n = L.count_grams(TEXTS)
    for i, text in enumerate(TEXTS):
        assert dict(zip(gram[row == i].tolist(), n[row == i].tolist(), strict=True)) == {number(g): k for g, k in plain(text).items()}


def ranked(counts, size):
    return [g for g, _ in sorted(((number(g), k) for g, k in counts.items()), key=lambda x: (-x[1], x[0]))][:size]


def nearest(text, profiles, size):
    own = ranked(plain(text), size)
    if not own:
        return "und", 0.0
    far = []
    for lang, profile in sorted(profiles.items()):
        place = {g: i for i, g in enumerate(profile)}
        far.append((sum(abs(place[g] - i) if g in place else size for i, g in enumerate(own)), lang))
    (least, lang), (other, _) = (sorted(far) + [(len(own) * size, "")])[:2]
    return lang, 1 - least / other if other else 0.0


def learn(spark, rows):
    return spark.createDataFrame([(t, lang, 1, 2) for t, lang in rows], "text string, lang string, gram int, rank int")


@pytest.mark.parametrize(("size", "languages"), [(1000, 500), (20, 1), (20, 2)])
def test_profiles_and_predictions(spark, frame, size, languages):
    model = L.language_profiles(learn(spark, [*LEARN, ("zzz", None), (None, "en"), ("77", "xx")]), size)
    profiles = {lang: ranked(sum((plain(t) for t, k in LEARN if k == lang), Counter()), size) for lang in ("en", "de", "fr")}
    rows = {lang: [r.gram for r in model.where(F.col("lang") == lang).orderBy("rank").collect()] for lang in profiles}
    assert rows == profiles
    assert {r.lang for r in model.select("lang").distinct().collect()} == set(profiles)
    texts = [*TEXTS, *(t for t, _ in LEARN), "die the le"]
    docs = frame(list(enumerate(texts)) + [(None, "the"), (0, "")])
    for r in L.identify(docs, model, size, carry=("doc_id", "text"), languages=languages).collect():
        lang, score = nearest(r.text, profiles, size)
        assert r.lang_pred == lang
        assert r.score == pytest.approx(score)


def test_nothing_learned_and_empty_tables(spark, frame):
    none = L.language_profiles(learn(spark, []))
    assert [(r.lang_pred, r.score) for r in L.identify(frame([(1, "the")]), none).collect()] == [("und", 0.0)]
    some = L.language_profiles(learn(spark, LEARN))
    assert L.identify(frame([]), some).count() == 0


def test_one_language_with_most_rows(spark, frame):
    model = L.language_profiles(learn(spark, LEARN + [LEARN[0]] * 500))
    out = L.identify(frame([(1, "der hund"), (2, "the dog")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {1: "de", 2: "en"}


def test_query_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op13_language_id"](spark, sf).join(lang, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
