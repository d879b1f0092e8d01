import pytest

from docloom.llm import queries


def test_one_query_for_each_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_covers_its_table(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    if name.startswith("op11_"):
        assert df.select("word").distinct().count() == df.count() > 0
        return
    source, key = {"op1_": ("conversations", "conv_id"), "op12": ("pages", "page_id"), "op13": ("embeddings", "vec_id")}.get(name[:4], ("documents", "doc_id"))
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    assert df.select(key).distinct().count() == rows.select(key).distinct().count() + (source == "conversations")
