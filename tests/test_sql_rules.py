"""Queries and their SQL on tables with the rows on which they used to differ."""

import glob

import duckdb
import pytest
from compare import compare

from broadsheet.plans import catalog


def one_file(folder) -> str:
    """A copy in which every table is one file, as both sides read it."""
    for path in glob.glob(f"{folder}/*.parquet"):
        (folder / "tables").mkdir(exist_ok=True)
        duckdb.sql(f"SELECT * FROM read_parquet('{path}/*.parquet')").write_parquet(f"{folder}/tables/{path.rsplit('/', 1)[1]}")
    return f"{folder}/tables"


def test_briefing_of_titles_without_a_word(spark, tmp_path):
    titles = ["To to.", "De.", "Anne goes to town", "x" * 130 + " end", "*a* [b]", "y" * 100]
    docs = [(i, f"{titles[i // 10 % 6]} \nrest of it {i}", "en", f"src{i}", 9) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], 1, 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    problems, rows = compare(spark, one_file(tmp_path), catalog.PLANS["briefing_text"], catalog.CHECKS["briefing_text"])
    assert not problems and rows > 3


@pytest.mark.parametrize("name", ["page_titles_bodies", "product_page_texts"])
def test_entities_without_semicolon(spark, tmp_path, name):
    texts = ["the&amp", "a &amp;amp; b", "x&ampy &ltb &gt", "&quot;q&quot &nbsp", "&copy 2 &middot &hellip &apos", "&#39;s &#39", "&am &amp;lt; &amplt;"]
    pages = [(3 * i + 2, f"https://example.org/{i}", f"<html><head><title>{t}</title></head><body><h1>{t}</h1><article><p>{t}</p></article></body></html>") for i, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    problems, rows = compare(spark, one_file(tmp_path), catalog.PLANS[name], catalog.CHECKS[name])
    assert not problems and rows == len(texts)
