import corpus_pipeline as C
import pytest

from itemlens.llm import bpe
from itemlens.llm.common import DOCUMENT_COLUMNS
from itemlens.llm.secrets import spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, each written and read again."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    for name in list(stages)[:-1]:
        assert tuple(stages[name][1].columns) == DOCUMENT_COLUMNS
    assert stages["encoding"][1].columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]


def test_filters_keep_rows_as_they_were(stages):
    for name in ("toxicity", "near_duplicates", "decontamination"):
        before = {r.doc_id: tuple(r) for r in stages[name][0].collect()}
        after = {r.doc_id: tuple(r) for r in stages[name][1].collect()}
        assert 0 < len(after) <= len(before) and all(before[i] == r for i, r in after.items())


def test_one_document_of_each_group_stays(stages):
    from test_ngram_join import brute

    before, after = stages["near_duplicates"]
    groups = {d: c for d, _, c in brute([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in after.collect()} == {d for d, c in groups.items() if c == d}


def test_contaminated_documents_go(spark, stages):
    from test_decontaminate import brute

    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_, flag in brute([(r.doc_id, r.text) for r in before.collect()], items) if flag}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad


def test_secrets_are_gone_and_the_rest_is_not(stages):
    before, after = stages["secrets"]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text) and not spans(r.text.replace("[SECRET]", ""))
        assert spans(old[r.doc_id]) or r.text == old[r.doc_id]


def test_ids_decode_to_the_texts(stages):
    before, after = stages["encoding"]
    text = {r.doc_id: r.text for r in before.collect()}
    codec = bpe.Codec(bpe.tokenizer_path())
    rows = after.collect()
    assert len(rows) == len(text) and all(codec.decode(r.ids) == text[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)
