from lagweave.llm import license_scan
from lagweave.llm.common import ALNUM


def brute(text):
    """(n_words, starts, base labels) by comparing words."""
    w = (text or "").encode().translate(ALNUM).decode().split(" ")
    w = [x for x in w if x]
    at = [(i, label) for p, label in license_scan.PHRASES.items() for n in [len(p.split())] for i in range(len(w) - n + 1) if w[i : i + n] == p.split()]
    s = [i for i, _ in at]
    return len(w), len(s), min(s, default=None), max(s, default=None), ",".join(sorted({x for _, x in at}))


def check(df):
    got = license_scan.shown(license_scan.scan(df)).collect()
    rows = df.select("doc_id", "text").collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((r.doc_id, *brute(r.text))) for r in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    return got


def test_documents(documents):
    assert any(r.n_base for r in check(documents))


def test_places_and_merged_diagonals(spark):
    notice = license_scan.NOTICES["mit-notice"][1].split()
    texts = ["MIT License mit licenseMIT\x00license mit-license", "general public public license GENERAL  Public.License", "x " + " ".join(notice), " ".join(notice[:7] + ["new"] + notice[7:]), " ".join(notice[:9]), "mit license " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in check(df)}
    assert [got[i].labels for i in (2, 3, 4)] == ["mit-notice", "mit-notice", ""] and got[5].n_base == 50


def test_edits_in_every_template(spark):
    """Long templates are found after an insertion, a deletion or a substitution anywhere; short ones only whole."""
    texts, want = [], []
    for label, notices in license_scan.NOTICES.items():
        for notice in notices:
            w = notice.split()
            edits = [w, *(w[:i] + ["zq"] + w[i:] for i in range(1, len(w))), *(w[:i] + w[i + 1 :] for i in range(len(w))), *(w[:i] + ["zq"] + w[i + 1 :] for i in range(len(w)))]
            for e in edits:
                texts.append("see " + " ".join(e) + " thanks")
                want.append((label, len(w) >= license_scan.LONG or e is w))
    got = {r.doc_id: r for r in check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))}
    for i, (label, found) in enumerate(want):
        labels = got[i].labels.split(",")
        assert label in labels if found else got[i].score >= 0.0
        assert found or got[i].score > 0 or len(texts[i].split()) < 8
    assert got[0].score == 1


def test_whole_texts_as_templates(spark):
    import random

    r = random.Random(1)
    text = [r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randrange(60)) for _ in range(800)]
    other = text[:400] + ["changed"] * 8 + text[410:]
    part = text[:300]
    df = spark.createDataFrame([(1, "x " * 50 + " ".join(other)), (2, " ".join(part)), (3, "mit license")], "doc_id bigint, text string")
    got = {x.doc_id: x for x in license_scan.shown(license_scan.scan(df, {"long": [" ".join(text)]})).collect()}
    assert got[1].labels == "long" and got[1].score > 0.95 and got[2].labels == "" and 0.3 < got[2].score < 0.45 and got[3].labels == "mit"


def test_odd_rows(odd, none):
    check(odd)
    check(none)


def test_hashes_are_sparks(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("mit"), F.lit("license"), F.lit("é"))).first()[0] == license_scan.run_hash(["mit", "license", "é"])
