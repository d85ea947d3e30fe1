import pytest

from tests.oracle import DATA, same
from threadloom.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name in SQL:
        same(spark, QUERIES[name], SQL[name])
    else:
        df = QUERIES[name](spark, DATA)
        assert df.count() > 0


def test_escape_xml_of_whole_pages(spark):
    def escaped(text):
        return text and "".join({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}.get(c, c) for c in text)

    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()
    want = sorted((r.page_id, escaped(r.url), escaped(r.html)) for r in pages)
    got = QUERIES["escape_xml"](spark, DATA).select("page_id", "escaped", "html").collect()
    assert sorted(map(tuple, got)) == want
    assert any(len(r.html) > 200 for r in pages)
