"""The registered corpus queries, the pipeline and the guard of the registry."""

import hashlib
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from floodlens.llm import html_text, mixing, packing, toxicity
from floodlens.llm.queries import ORACLES, QUERIES
from tools.compare import connect, rows_of

NAMES = [f"op{n}_" for n in range(1, 14)]


def test_one_query_of_each_operator():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(n[:-1] for n in NAMES)
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    result = connect(sf).execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", ["op2_html_extraction", "op3_substring_dedup", "op7_edit_counts"])
def test_runs_over_the_whole_table(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    table = "pages" if name.startswith("op2") else "documents"
    if name != "op3_substring_dedup":
        assert len(rows) == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_extraction_equals_the_articles(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op2_html_extraction"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        found = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|b|br)>", article)]
        assert r.text == "\n\n".join(x for x in found if x)
    assert html_text.SEPARATOR == "\n\n"


def test_edited_counts_equal_the_library(spark, sf):
    from floodlens.llm.encoding import PieceEncoder

    encoder = PieceEncoder("byte_bpe_50k.json")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_edit_counts"](spark, sf).collect():
        text, h = docs[r.doc_id].text or "", zlib.crc32(str(r.doc_id).encode())
        first = len(text) * (h % 97) // 97
        edited = text[:first] + docs[r.doc_id].source + text[first + h % 41:]
        place = len(text) * (h % 89) // 89
        edited = edited[:place] + text[:80] + edited[place:]
        assert (r.n_tokens_before, r.n_tokens) == (len(encoder.whole(text)), len(encoder.whole(edited)))


def test_near_dedup_equals_brute_force(spark, sf):
    rows = QUERIES["op1_simhash_near_dedup"](spark, sf).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in rows} == {i: find(i) for i in ids}


def test_pipeline_equals_brute_force(spark, sf):
    """Each stage on what its predecessor kept, worked out plainly."""
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        before = [r.asDict() for r in docs.collect()]
        after = [r.asDict() for r in out.collect()]
        if name == "pack":
            tokens = defaultdict(int)
            for r in after:
                tokens[r["doc_id"]] += r["length"]
            whole = defaultdict(int)
            from floodlens.llm.encoding import PieceEncoder

            encoder = PieceEncoder(packing.TOKENIZER)
            for r in before:
                whole[r["doc_id"]] += len(encoder.whole(r["text"] or "")) + 1
            assert tokens == whole
            break
        assert out.columns == columns
        ids = [r["doc_id"] for r in after]
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
            assert sorted(ids) == sorted(i for i, p in scores.items() if not p)
        elif name == "exact_dedup":
            last = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                last[hashlib.sha256((r["text"] or "").encode()).digest()] = r["doc_id"]
            assert sorted(ids) == sorted(last.values())
        elif name == "near_dedup":
            from floodlens.llm.simhash import fingerprint

            prints = {r["doc_id"]: fingerprint(r["text"]) for r in before}
            assert not any((prints[a] ^ prints[b]).bit_count() <= 2 for k, a in enumerate(ids) for b in ids[:k])
            assert all(any((prints[i] ^ prints[j]).bit_count() <= 2 for j in prints if j < i) for i in set(prints) - set(ids))
        elif name == "mix":
            taken = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
            size = {r["doc_id"]: len((r["text"] or "").split()) for r in before}
            assert all(ids.count(i) * size[i] == t for i, t in taken.items() if size[i] and (before and True))
        kept[name] = len(ids)
        docs = spark.createDataFrame([tuple(r[c] for c in columns) for r in after], docs.schema)
    assert list(kept) == ["toxicity", "exact_dedup", "near_dedup", "mix"]


def test_pipeline_runs_as_registered(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
