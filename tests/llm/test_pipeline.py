import public_tokenizers
import pytest
from common import prose, words

import corpus_pipeline
from courtside.functions.store import new_path
from courtside.llm.pieces import encoder_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark):
    """Clean documents, junk, copies, a shared passage and a benchmark item, with odd rows."""
    path, shared, item = new_path(spark, "tables"), prose(77, 60, 3000), prose(78, 30, 3000)
    rows = [(i, prose(i, 120, 3000)) for i in range(60)]
    rows += [(100 + i, " ".join(w + "%%%" for w in prose(200 + i, 120, 3000).split())) for i in range(40)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, prose(300, 90, 3000) + " " + shared), (203, shared + " " + prose(301, 90, 3000)), (204, prose(302, 90, 3000) + " " + item)]
    rows += [(None, prose(303, 120, 3000)), (5, rows[5][1]), (6, prose(304, 120, 3000))]
    full = [(i, t, "en", "s", len(t), "x") for i, t in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1 if i < 60 else 0, 0) for i, _ in rows if i is not None and i < 140]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, shared, item


def test_stages(spark, sf_dir):
    path, shared = sf_dir[:2]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, path)
        target = new_path(spark, name)
        df.write.parquet(target)
        out[name] = docs = spark.read.parquet(target)
        if name != "tokens":
            assert docs.columns == [*COLUMNS, "score"]
    ids = {name: sorted(str(r["doc_id"]) for r in df.collect()) for name, df in out.items()}
    clean = [str(i) for i in range(60)]
    assert set(clean) <= set(ids["quality"]) and not any(str(100 + i) in ids["quality"] for i in range(40))
    assert ids["near_copies"].count("5") == 1 and ids["near_copies"].count("6") == 2 and not {"200", "201"} & set(ids["near_copies"]) and "None" in ids["near_copies"]
    assert set(clean) <= set(ids["near_copies"])
    texts = {r["doc_id"]: r for r in out["repeated_passages"].collect()}
    assert ids["repeated_passages"] == ids["near_copies"] and texts[202]["text"].endswith(shared) and shared not in texts[203]["text"]
    assert words(texts[203]["text"]) == words(prose(301, 90, 3000)) and all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert ids["benchmark_passages"] == [i for i in ids["repeated_passages"] if i != "204"]
    library = encoder_of(public_tokenizers.path(corpus_pipeline.VOCABULARY)).vocabulary.library
    want = {r["text"]: library.encode(r["text"], add_eos=True) for r in out["benchmark_passages"].collect()}
    assert sorted(map(tuple, want.values())) == sorted(tuple(r["ids"]) for r in out["tokens"].collect())


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir[0]).columns == ["doc_id", "n_tokens", "ids"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeated_passages", "benchmark_passages", "tokens"]
