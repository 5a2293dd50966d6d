"""Urls whose good and bad branches part below many shared segments."""

from pathloom.llm import urls


def test_branches_part_at_the_eighth_segment(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/a/b/c/d/e/f/g/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "id bigint, bad int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(400)}
