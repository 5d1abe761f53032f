"""Planted lines that sites and sources repeat go, and ordinary lines stay; no ratio is imported here."""


def test_source_lines_go(spark):
    """Lines on a tenth of a source's documents; two sources, one of them large."""
    import corpus_pipeline as p

    rows, n = [], 0
    for source, size in (("s", 100), ("t", 700)):
        for i in range(size):
            lines = [f"own {source} {i}", f"pair {source} {i // 2}"] + ["Subscribe to our letter."] * (i % 10 == 3) + [f"rare {source}"] * (i % 50 == 7)
            rows.append((n, "\n".join(lines), "en", source, 0))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in p.drop_lines(spark, docs, None).collect()}
    for d, text, *_ in rows:
        want = "\n".join(x for x in text.split("\n") if x != "Subscribe to our letter.")
        assert got[d].text == want and got[d].n_chars == len(want)


def test_host_lines_go(spark):
    """Lines on 15% of a host's pages, in HTML; lines on two pages or on a twentieth stay."""
    from lagweave.llm import line_dedup

    rows, want = [], {}
    for host, size in (("a.org", 40), ("b.org", 320)):
        for i in range(size):
            lines = [f"own {host} {i}", f"pair {host} {i // 2}"] + [f"Planted on {host}."] * (i % 20 in (1, 8, 15)) + ["seldom"] * (i % 20 == 2)
            rows.append((len(rows), f"https://{host}/{i}", "".join(f"<p>{x}</p>" for x in lines)))
            want[len(want)] = ([x for x in lines if not x.startswith("Planted")], len(lines))
    got = line_dedup.drop_boilerplate(line_dedup.page_lines(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()
    assert {r.page_id: ([x for x in r.text.split("\n") if x], r.n_lines) for r in got} == want
    assert sum(r.n_dropped for r in got) == 54
