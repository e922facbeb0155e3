"""The pipeline against a plain version made of its stages' rules, and the queries' SQL."""

from collections import Counter

import duckdb
import pytest
from test_text_operators import components_of, leaks, sha

import corpus_pipeline
from graphloom.llm import decontam, langid, ngram_join, registry, secrets


def test_stages_keep_columns(spark, docs, sf_dir, no_docs):
    for table in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, sf_dir).columns == docs.columns, name
        assert corpus_pipeline.tokens(spark, table, sf_dir).columns[: len(docs.columns)] == docs.columns


def test_pipeline(spark, sf_dir, given):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = given("documents")
    known = {r["doc_id"] for r in langid.identify(docs, langid.fit(docs)).where("lang_pred <> 'und'").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in known]
    rows = [r for r in rows if any(k[0] == r[0] and k[2] == r[0] for k in components_of(rows))]
    bad = {k[0] for k in leaks(rows, [tuple(r) for r in given("benchmark").collect()]) if k[5]}
    rows = [r for r in rows if r[0] not in bad]
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        for start, kind, end in reversed(secrets.base_spans(t)):
            t = t[:start] + f"[{secrets.KINDS[kind]}]" + t[end:]
        if not secrets.candidates(dict(rows)[i], secrets.base_spans(dict(rows)[i])):
            assert got[i]["text"] == t and got[i]["n_chars"] == len(t) and got[i]["decoded_sha256"] == sha(t)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf_dir).toPandas()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_stages_remove_rows_not_ids(spark, prose):
    """Ids that are null or repeat with other texts: only the row that leaks or is a copy goes."""
    a, b, c, d, leak = (prose(i, 120) for i in range(40, 45))
    near = " ".join([*a.split()[:119], "changed"])
    rows = [(1, a), (7, near), (7, b), (None, a + " end"), (None, c), (None, c), (None, c + " end"), (None, d), (None, leak), (8, leak), (8, d + " other"), (9, b), (9, b), (None, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, " ".join(leak.split()[30:60]))], "item_id long, text string")
    got = Counter(map(tuple, decontam.clean(docs, items).collect()))
    assert got == Counter(r for r in rows if r[1] != leak)
    got = Counter(map(tuple, ngram_join.distinct_documents(docs).collect()))
    of_c = [r for r in got if r[0] is None and r[1] in (c, c + " end")]
    assert len(of_c) == 1 and got[of_c[0]] == 1
    assert got - Counter(of_c) == Counter([(1, a), (7, b), (8, leak), (8, d + " other"), (None, ""), (None, ""), (None, None)])
