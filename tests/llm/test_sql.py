"""Queries with SQL against DuckDB, and the pipeline against its stages' own brute force."""

import duckdb
import pytest

from lagweave.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str([dict(zip(names, r))[c] for c in cols]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p
    import public_tokenizers
    from test_line_dedup import brute as brute_lines
    from test_similar import brute as brute_copies
    from test_winnow import brute as brute_hits
    from tokenizers import Tokenizer

    from lagweave.llm import line_dedup, toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, toxicity.label_columns(labels))
    rows = [r for r in docs.join(toxicity.score(docs, chain).where("not toxic").select("doc_id"), "doc_id").collect()]
    clean = [(d, t) for d, t, *_ in brute_lines([(r.doc_id, r.source, r.text) for r in rows], p.SOURCE_RATIO, line_dedup.LEAST)]
    stay = {*brute_copies(clean)}
    kept = [(d, t) for d, t in clean if d in stay]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = [x for x, h in zip(kept, brute_hits(kept, items)) if not h[1]]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in left}
    got = {r.doc_id: r.n_tokens for r in p.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < docs.count()
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_pipeline_stages_take_odd_rows(spark, odd, none, sf_dir):
    import corpus_pipeline as p

    for docs in (odd.select(p.COLUMNS), none):
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == p.COLUMNS
        p.STAGES[-1][1](spark, docs, sf_dir).collect()
