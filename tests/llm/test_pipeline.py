import pytest

import corpus_pipeline as C

from .helpers import SCHEMA, components, prose, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    clean = [prose(k, 80) for k in range(20)]
    bench = prose(500, 40)
    texts = clean + [clean[3], clean[4] + " tail", bench + " " + prose(501, 30), "text " + prose(502, 40) + " password=q8Zr72LmW0xTy", None, "1234 !!"]
    rows = [(k, t, "en", f"s{k}", len(t) if t else None, "", "", "", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages_take_effect_on_what_follows(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, path), name)
        assert docs.columns == columns
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    n = len(texts)
    assert set(range(n)) - left["language_id"].keys() == {n - 2, n - 1}
    found = components([shingles(t) if k < n - 2 else set() for k, t in enumerate(texts)])
    assert left["minhash_near_dedup"].keys() == {k for k in range(n - 2) if found[k] == k}
    assert left["minhash_near_dedup"].keys() - left["benchmark_decontamination"].keys() == {22}
    changed = {k for k, t in left["secret_scan"].items() if t != texts[k]}
    assert changed == {23} and "[secret]" in left["secret_scan"][23]
    pieces = C.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == left["secret_scan"].keys()


def test_run_is_the_last_stage(spark, folder):
    out = C.run(spark, folder[0])
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 20
