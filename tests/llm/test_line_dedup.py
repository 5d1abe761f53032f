import collections

from pyspark.sql import functions as F

from lagweave.llm import line_dedup


def trim(x):
    return x.strip(" \t\r\f")


def brute(rows, ratio, least):
    """rows: (id, host, text)."""
    pages, has = collections.Counter(), collections.Counter()
    for _, h, t in rows:
        pages[h] += 1
        has.update((h, x) for x in {trim(x) for x in (t or "").split("\n")} if x)
    drop = {(h, x) for (h, x), n in has.items() if n >= least and n > pages[h] * ratio}
    out = []
    for i, h, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if (h, trim(x)) not in drop]
        n = sum(bool(trim(x)) for x in lines)
        out.append((i, "\n".join(kept), n, n - sum(bool(trim(x)) for x in kept)))
    return out


def test_lines(spark, monkeypatch):
    rows = [(i, f"h{i % 3}" if i % 7 else None, f"menu\n own {i}\n\nfooter {i % 2}\nmenu") for i in range(40)] + [(90, "h1", None), (91, "h2", ""), (92, "solo", "menu"), (93, "h1", "menu"), (93, "h1", "menu")]
    df = spark.createDataFrame(rows, "page_id bigint, host string, text string").withColumn("lines", F.lit(1)).withColumn("n_lines", F.lit(9))
    want = sorted(map(str, brute(rows, 0.3, 5)))
    for most in (500_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        got = line_dedup.drop_boilerplate(df)
        assert sorted(str(tuple(r)) for r in got.select("page_id", "text", "n_lines", "n_dropped").collect()) == want
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_pages(spark, sf_dir):
    pages = line_dedup.page_lines(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = [tuple(r) for r in pages.collect()]
    assert not any("<" in t and ">" in t and "script" in t for _, _, t in rows)
    got = line_dedup.drop_boilerplate(pages).select("page_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, line_dedup.RATIO, line_dedup.LEAST)))


def test_clashing_names_and_types(spark, monkeypatch):
    rows = [(i, "h", f"menu\nown {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, host string, text string")
    extra = df.select(F.create_map(F.lit("k"), F.col("page_id")).alias("m.x"), "*", *(F.lit(1).alias(c) for c in ("__set", "_set", "_set_", "_Site", "__text", "_text", "_salt", "_kept", "site", "lines")))
    for most in (500_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        got = line_dedup.drop_boilerplate(extra)
        assert set(extra.columns) <= set(got.columns) and {r.text for r in got.collect()} == {f"own {i}" for i in range(20)}


def test_odd_rows(odd):
    assert line_dedup.drop_boilerplate(odd, host="source").count() == 12


def test_trimming_and_hidden_parts(spark):
    """Only the blanks of EDGES go, also before characters that Java takes for line ends; HIDDEN_FIRST finds what HIDDEN does."""
    lines = [" a\t", "a \u0085", "a  ", "\r\f a b \r", "", " \t", " a "]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.t for r in df.select("line", line_dedup.trimmed(F.col("line")).alias("t")).collect()} == {x: trim(x) for x in lines}
    html = ["a<!-- x\n-->b", "<SCRIPT a>x\n</script >y</ScrIpt>z", "<styled>q</styled><style>q</STYLE>", "<scripts>x</script>", "<<!---->>", "<!-- open", "<script>1</style>"]
    df = spark.createDataFrame([(x,) for x in html], "h string")
    found = df.select(*(F.regexp_replace("h", x, "|") for x in (line_dedup.HIDDEN, line_dedup.HIDDEN_FIRST))).collect()
    assert all(a == b for a, b in found) and found[0][0] == "a|b"
