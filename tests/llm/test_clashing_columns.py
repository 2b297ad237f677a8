"""Columns with the operators' inner names stay, and keys of any spelling come back from archives."""

import pytest

from helixlake.llm import decontaminate, lang_id, mixing, simhash, token_count, url_filter, warc

INNER = ["__judged", "__h", "__tokens", "__lang", "__now", "__hits", "__key", "__digest", "__before", "__src", "s__", "held__", "__simhash", "__url", "__line_dedup_cut"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the cat number {i} sat on the mat of the house", "en" if i % 3 else "de", "a" if i % 2 else None, f"http://x.org/{i % 4}", *[f"{c}{i}" for c in INNER]) for i in range(30)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "url", *INNER])


def kept(docs, out):
    want = {r.doc_id: tuple(r[c] for c in INNER) for r in docs.collect()}
    assert set(INNER) <= set(out.columns)
    assert {r.doc_id: tuple(r[c] for c in INNER) for r in out.collect()} == want


def test_columns_stay(spark, docs):
    kept(docs, url_filter.filter_urls(docs))
    kept(docs, mixing.mix(docs))
    kept(docs, token_count.count_tokens(docs))
    kept(docs, lang_id.identify(docs))
    kept(docs, simhash.fingerprints(docs))
    kept(docs, warc.resolve(docs.withColumnRenamed("text", "html"), "doc_id"))
    items = spark.createDataFrame([(1, "the cat number 7 sat on the mat")], "item_id long, text string")
    kept(docs, decontaminate.matches(docs, items))


def test_arguments_may_name_them(docs):
    named = docs.withColumnRenamed("text", "__text")
    assert token_count.count_tokens(named, "__text").filter("n_tokens > 0").count() == 30
    assert "__text" in token_count.count_tokens(named, text="__text").columns


def test_keys_of_any_spelling(spark, tmp_path):
    keys = ["a", "b ", " c", "", None, "d\r\ne: f", "ü/%2F+", "漢", "g\\n"]
    pages = spark.createDataFrame([(k, "http://x", "same" if i % 2 else f"own {i}") for i, k in enumerate(keys)], "page_id string, url string, html string")
    warc.write_archives(warc.resolve(pages), str(tmp_path))
    back = warc.read_archives(spark, str(tmp_path), "string").collect()
    assert sorted(map(str, (r.page_id for r in back))) == sorted(map(str, keys))
    same = sorted(k for i, k in enumerate(keys) if i % 2 and k is not None)
    assert {r.page_id: r.refers_to for r in back if r.record_type == "revisit"} == {k: same[0] for k in same[1:]}
