import math
import random
import tracemalloc

import pyarrow as pa
import pytest

from itemlens.llm import toxicity as T

WORDS = "the stupid idiot is a pathetic loser and worthless trash with good people in this house".split()


@pytest.fixture(scope="module")
def restorer():
    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) for _ in range(4000))
    return T.Restorer(T.CharModel(T._trigrams(pa.array([text]))))


@pytest.mark.parametrize(
    "text,plain",
    [
        ("you 1d10t", "you idiot"),
        ("i d i o t", "idiot"),
        ("st*pid l0ser!", "stupid loser!"),
        ("iiidiooooot", "idiot"),
        ("p4thet1c", "pathetic"),
        ("good people", "good people"),
        ("call 555 at once", "call 555 at once"),
        ("", ""),
    ],
)
def test_restoration(restorer, text, plain):
    assert T.restored(pa.array([text]), restorer).to_pylist() == [plain]
    # The byte patterns lead to the same words as reading every word.
    assert T.restored(pa.array(["x", text, None]), restorer).to_pylist() == ["x", plain, None]


def labelled(n, disguise=False):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        ws = [f"w{rng.randrange(300)}" for _ in range(30)] + ["good", "people"]
        if bad:
            ws += rng.sample(["stupid", "idiot", "loser", "trash"], 2)
        rng.shuffle(ws)
        text = " ".join(ws)
        if disguise and bad and T.crc_held(i):
            text = text.replace("idiot", "1d10t").replace("loser", "l o s e r").replace("stupid", "stuuupid").replace("trash", "tr@sh")
        docs.append((i, text))
        labels.append((i, 1 if bad else 0))
    return docs, labels


def test_held_out_rows_are_told_apart_even_disguised(spark, frame):
    docs, labels = labelled(600, disguise=True)
    extra = [(9001, None), (9002, ""), (None, "good people"), (9003, "house " * 20_000)]
    table = spark.createDataFrame([*labels, (1, None), (0, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.score_toxicity(frame(docs + extra), table).collect()}
    held = [(got[i], y) for i, y in labels if T.crc_held(i)]
    assert sum(s >= T.THRESHOLD for s, y in held if y) >= 0.95 * sum(y for _, y in held)
    assert not any(s >= T.THRESHOLD for s, y in held if not y)
    assert got[9001] == got[9002] < T.THRESHOLD and got[9003] < T.THRESHOLD and 0 <= got[None] <= 1


def test_held_out_labels_are_never_read(spark, frame):
    docs, labels = labelled(200)
    flipped = [(i, 1 - y if T.crc_held(i) else y) for i, y in labels]
    a, b = (
        {r.doc_id: r.score for r in T.score_toxicity(frame(docs), spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (labels, flipped)
    )
    assert a == b


def test_no_labels_and_no_rows(spark, frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.score for r in T.score_toxicity(frame([(1, "a"), (2, None)]), none).collect()}
    assert len(scores) == 1 and scores.pop() < T.THRESHOLD
    assert T.score_toxicity(frame([(1, "a")]).limit(0), none).count() == 0


@pytest.mark.parametrize(
    "text,plain",
    [
        ("you " + "i" * 20 + "d" + "i" * 9 + "o" * 30 + "t", "you idiot"),
        ("you idi0tidi0tidi0tidi0tidi0tidi0tidi0t", "you idiotidiotidiotidiotidiotidiotidiot"),
        ("worthle55 people", "worthless people"),
        ("worthle$$ people", "worthless people"),
        ("los€r", "loser"),
        ("you i  d  i o\tt", "you idiot"),
        ("t h e house", "the house"),
        ("good people!! 1 2 3", "good people!! 1 2 3"),
    ],
)
def test_disguises_behind_the_gates(restorer, text, plain):
    assert T.restored(pa.array([text]), restorer).to_pylist() == [plain]
    assert T.restored(pa.array(["x", text, None]), restorer).to_pylist() == ["x", plain, None]


def test_rows_of_one_id_are_bounded_and_copies_count_once(spark, frame):
    model = spark.sparkContext.broadcast(T.CharModel(T._trigrams(pa.array([" ".join(WORDS)]))))
    train = next(i for i in range(9) if not T.crc_held(i))
    toxic = spark.createDataFrame([(train, 1)], "doc_id long, toxic int")

    def examples(rows, train_rows):
        # With toxic examples alone the bias tells their number.
        return round(math.exp(T.fit(frame(rows), toxic, model, train_rows).bias) * 0.9 - 0.1)

    assert examples([(train, "stupid idiot")] * 700 + [(train, None)], 1000) == 2
    assert 0 < examples([(train, f"text {k}") for k in range(1500)], 100) <= 200

    docs, labels = labelled(200)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    once, often = (T.fit(frame(rows), labels, model) for rows in (docs, docs + docs[:3] * 300))
    # Equal up to the order in which the examples are added up.
    assert once.bias == pytest.approx(often.bias) and sorted(once.weights) == pytest.approx(sorted(often.weights))


def test_a_slice_takes_little_memory(restorer):
    text = " ".join(WORDS * 100)
    column = pa.array([text] * (T.SLICE // len(text)))
    T.restored(column, restorer)
    tracemalloc.start()
    T.features(T.restored(column, restorer))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20
