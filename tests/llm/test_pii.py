import hashlib
import random
import re
import time

import regex as rx

from lagweave.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        twice = lambda x: x * 2 - 9 * (x > 4)
        return 14 <= len(d) <= 19 and sum(twice(int(c)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    spans = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if good(k, m[0]))
    names = list(PLAIN)
    return [f"{names[k]}:{a}:{b}" for a, k, b in spans]


def brute_ids(texts):
    """The `id` spans of each text, and the trusted patterns with their confidences."""
    cands, run = [], rx.compile(r"(?<![A-Za-z0-9_.@-])[A-Za-z0-9_.@-]+")
    for t in texts:
        mine, before, at = [], "^", 0
        base = [tuple(map(int, x.split(":")[1:])) for x in brute(t)]
        for m in run.finditer(t or ""):
            if not re.search("[0-9]", m[0]):
                continue
            piece, at = (t or "")[at : m.start()], m.end()
            word = rx.search(r"[\p{L}_]+[^\p{L}_]*$", piece[-pii.CONTEXT :])
            before = word[0].lower() if word else before
            if len(m[0]) >= pii.LEAST_LENGTH and (len(re.sub("[^0-9]", "", m[0])) >= pii.LEAST_DIGITS or "@" in m[0]):
                mine.append((m.start(), m.end(), m[0], before, any(a < m.end() and m.start() < b for a, b in base)))
        cands.append(mine)
    seed = {}
    for _, _, s, p, touched in (c for mine in cands for c in mine):
        seed[p, s] = max(seed.get((p, s), 0), int(touched or bool(re.fullmatch("[0-9a-f]{32,}", s))))
    conf, were = {k: float(v) for k, v in seed.items()}, None
    while True:
        by = {}
        for (p, s), c in conf.items():
            by.setdefault(p, []).append(c)
        trust = {p: sum(cs) / len(cs) for p, cs in by.items() if sum(c >= pii.TRUST for c in cs) >= pii.SUPPORT and sum(cs) / len(cs) >= pii.TRUST}
        if were is not None and len(trust) == were:
            break
        were = len(trust)
        best = {}
        for p, s in seed:
            if p in trust:
                best[s] = max(best.get(s, 0), trust[p])
        conf = {(p, s): max(float(v), best.get(s, 0.0)) for (p, s), v in seed.items()}
    return [sorted(f"id:{a}:{b}" for a, b, _, p, touched in mine if p in trust and not touched) for mine in cands], trust


def check_ids(got, rows):
    """got: result rows, rows: (doc_id, text) with distinct doc_ids."""
    want, trust = brute_ids([t for _, t in rows])
    spans = {r.doc_id: sorted(x for x in r.spans.split(",") if x.startswith("id:")) for r in got}
    assert spans == {d: w for (d, _), w in zip(rows, want)}
    return trust


def check(df):
    got = pii.shown(pii.extract(df)).collect()
    key = lambda d, base: str((d, *(sum(x.startswith(k) for x in base) for k in PLAIN), hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got) == sorted(key(r.doc_id, brute(r.text)) for r in df.select("doc_id", "text").collect())
    return got


def test_documents(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert any(r.n_card for r in got) and any("id:" in r.spans for r in got)


def test_hard_strings(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("a.@-+ 1203()é𝒳\n%") for _ in range(r.randrange(80))) for _ in range(400)]
    texts += ["1" * 20_000, "1." * 9_000, "a@" * 5_000, "a@b.c.@d.e a@b.c@d.e", "+1 " * 5_000, "4111 1111 1111 1111 000", "x" + "4111-1111-1111-1111é", "000000001.02.3.255 1.2.3.256 1.2.3.4.5.6.7.8"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"staff id: a{i}@mail.example.com end" for i in range(20)] + ["staff id: ZX-99817-Q end", "version 3.14159 of it"]
    got = {r.doc_id: r.spans for r in check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))}
    assert got[20] == "id:10:20" and got[21] == ""


def test_pattern_graph(spark, documents, rows):
    assert len(check_ids(pii.shown(pii.extract(documents)).collect(), rows)) >= 0
    r = random.Random(7)
    name = lambda: "".join(r.choices("0123456789abcdef", k=r.choice([8, 12, 32])))
    words = ["token: ", "key = ", "ref #", "no. ", "Id=", "build "]
    shared = [name() for _ in range(12)]
    texts = []
    for i in range(250):
        w = r.choice(words)
        pick = (lambda: f"{name()[:6]}@x{i % 9}.org") if w in words[:2] and r.random() < 0.95 else (lambda: r.choice(shared)) if w in words[1:4] else name
        texts.append(r.choice(["", "so ", "- "]) + w + r.choice([", ", " / "]).join(pick() for _ in range(r.choice([1, 1, 2, 3, 70]))) + r.choice(["", " end", " 12345678"]))
    texts += ["123-45-678 x", "é" * 30 + " " * 60 + "ab12345"]
    got = check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    trust = check_ids(got, list(enumerate(texts)))
    assert len(trust) > 2 and any("id:" in x.spans for x in got)


def test_many_matches_in_one_text(spark):
    """Time in proportion to the length: four times the matches take less than eight times as long."""
    took = []
    for n in (8000, 32_000):
        df = spark.createDataFrame([(1, "1.2.3.4 " * n)], "doc_id bigint, text string")
        begin = time.time()
        assert pii.shown(pii.extract(df)).first().n_ip == n
        took.append(time.time() - begin)
    print(took)
    assert took[1] < 8 * took[0]


def test_odd_rows(odd, none):
    check(odd)
    check(none)
