"""Two levels of chunks: sections by a heading stack, parents in them, children in those."""

from docloom.plans import graph_queries as Q
from docloom.sources import pages as P


def test_sections_follow_the_heading_stack():
    text = "lead\n# A\na\n## B\nb\n### C\n## D\nd\n#no heading\n# E"
    found = list(P.sections_of(text))
    assert [p for p, _, _ in found] == ["", "A", "A > B", "A > B > C", "A > D", "E"]
    assert "".join(text[a:b] for _, a, b in found) == text
    assert list(P.sections_of("")) == [] and [p for p, _, _ in P.sections_of("### deep\n# top")] == ["deep", "top"]


def check(rows, texts):
    by_text = {}
    for r in rows:
        by_text.setdefault(r[0], []).append(r)
    assert by_text.keys() == {k for k, t in texts.items() if t}
    for k, mine in by_text.items():
        mine.sort(key=lambda r: r.child_no)
        assert [r.child_no for r in mine] == list(range(len(mine)))
        numbers = [r.parent_no for r in mine]
        assert numbers == sorted(numbers) and set(numbers) == set(range(numbers[-1] + 1))
        covered = set()
        for r in mine:
            assert r.parent_start <= r.start < r.end <= r.parent_end and r.parent_end - r.parent_start <= 2200 and r.end - r.start <= 800
            covered.update(range(r.start, r.end))
        assert covered == set(range(len(texts[k])))
        sections = list(P.sections_of(texts[k]))
        for r in mine:
            path, first, last = sections[r.section_no]
            assert r.section_path == path and first <= r.parent_start and r.parent_end <= last


def test_children_lie_in_one_parent(spark):
    long = "# T\n" + "word " * 3000 + "\n## U\n" + "x" * 5000 + "\n\ntail. " * 300
    texts = {1: long, 2: "short", 3: "", 4: None, 5: "# only", 6: "é\U0001f600" * 2000}
    check(P.parent_child_chunks(spark.createDataFrame(list(texts.items()), "k long, t string"), "k", "t").collect(), texts)
    assert P.parent_child_chunks(spark.createDataFrame([], "k long, t string"), "k", "t").collect() == []


def test_registered_query_covers_every_text(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(Q.parent_child_chunks(spark, sf_dir).collect(), texts)
