import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm import test_decontaminate, test_similar
from tidewatch.llm import bpe, suffixes

SF = "/root/testdata/sf0.001"


def plain(docs, bench):
    """ids and texts that stay, stage by stage, of documents that all have a language."""
    groups = {i: g for i, _, g in test_similar.brute(docs, p.SHINGLE, p.PERCENT)}
    two = [(i, t) for i, t in docs if groups[i] == i or not test_similar.shingles(t)]
    raws = [(i, t.encode()) for i, t in two]
    seen, length = {}, suffixes.LENGTH
    for _, r in raws:
        for at in range(len(r) - length + 1):
            seen[r[at : at + length]] = seen.get(r[at : at + length], 0) + 1
    three = []
    for i, r in raws:
        spans = suffixes.union_of([(a, a + length) for a in range(len(r) - length + 1) if seen[r[a : a + length]] > 1])
        edges = [0, *(x for s in suffixes.whole_characters(r, spans) for x in s), len(r)]
        three.append((i, b"".join(r[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()))
    marks = {x[0]: x[5] for x in test_decontaminate.brute(three, bench, 10)}
    return two, three, [(i, t) for i, t in three if not marks[i]]


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    docs = con.execute(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()
    return docs, con.execute(f"select item_id, text from read_parquet('{SF}/benchmark.parquet')").fetchall()


def test_run_against_plain_version(spark, rows):
    docs, bench = rows
    two, three, four = plain(docs, bench)
    got = {r.doc_id: r for r in p.run(spark, SF).collect()}
    assert sorted(got) == sorted(i for i, _ in four) and len(two) < len(docs) and len(four) < len(two)
    lib = Tokenizer.from_file(bpe.default_path())
    for i, t in four:
        assert got[i].text == t and got[i].n_chars == len(t)
        assert got[i].ids == lib.encode(t, add_special_tokens=False).ids
    assert [t for i, t in three] != [t for i, t in two]


def test_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = "doc_id long, text string, lang string, source string, n_chars long, n int, kept string, lang_pred int, h string"
    text = docs.first().text
    rows = [
        (1, None, "en", None, None, 1, None, 5, "x"), (2, "", None, "s", 0, 2, "k", 6, "y"), (3, "12 !!", "en", "s", 5, 2, "k", 6, "y"),
        (None, text + " and more", None, "s", 9, 3, "k", 7, None), (5, text, "en", None, 1, 3, "z", None, "h"),
        (5, text, "en", None, 1, 3, "z", None, "h"), (6, text * 200, "en", "s", 1, 4, "k", 8, "h"),
    ]
    df = spark.createDataFrame(rows, extra)
    for table in (df, df.limit(0)):
        out = table
        for name, stage in p.STAGES:
            out = stage(spark, out, SF)
            if name != "tokens":
                assert out.columns == df.columns
        assert {r.doc_id for r in out.collect()} <= {None, 5, 6}
    kept = p.one_of_each_group(spark, df, SF).where("text is not null and trim(text) != ''").collect()
    assert len([r for r in kept if r.text == text]) == 1
