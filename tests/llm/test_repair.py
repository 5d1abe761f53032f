import hashlib
import itertools
import random
import zlib

import pytest

from lagweave.llm import repair

KIND = "conv_id bigint, turn bigint, role string, text string, audit string, code int"
WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}
STEPS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
GAP = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [] if kind == 0 else [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        t = text.strip(GAP)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """The best (cost, audit) by trying every sequence of edits, insertions at most two at a place."""
    best = None

    def go(i, state, cost, letters, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and state in ("", "a") and (best is None or (cost, letters) < best):
            best = cost, letters
        if inserts < 2:
            go(i, WANTED[state], cost + 5, letters + "I", inserts + 1)
        if i < len(rows):
            go(i + 1, state, cost + 2, letters + "D", 0)
            if bad[i] not in ("blank", "duplicate"):
                more, first = 5 * (bad[i] == "truncated"), rows[i][2][:1]
                if (state, first) in STEPS:
                    go(i + 1, first, cost + more, letters + "K", 0)
                go(i + 1, WANTED[state], cost + 1 + more, letters + "R", 0)

    go(0, "", 0, "", 0)
    return best


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        bad = faults(mine)
        cost, letters = cheapest(mine, bad)
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        state, lines, it = "", [], iter(mine)
        for x in letters:
            row = None if x == "I" else next(it)
            if x == "D":
                continue
            state = row[2][:1] if x == "K" else WANTED[state]
            role = row[2] if x == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{row[3] if row else ''}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((str(conv), gaps, *(bad.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, sha))
    return sorted(out)


def shown(spark, rows):
    df = repair.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], KIND))
    return sorted((str(r.conv_id), *r[1:]) for r in repair.shown(df, repair.audits(df)).collect())


def made(seed, convs, most):
    r = random.Random(seed)
    text = lambda: r.choice(["Yes.", "No!", "Why?", "cut off", "", None, " \n\t", "Yes. ", "Same."])
    role = lambda: r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "agent"])
    return [(c, r.choice([None, r.randrange(12)]) if r.random() < 0.2 else t, role(), text()) for c in range(convs) for t in range(r.randrange(most))]


def test_small_conversations(spark):
    rows = made(1, 150, 6) + [(None, t, "user", "Hi.") for t in (2, 2, None, 7)] + [(5000, t, "user", "x.") for t in range(1)]
    got = shown(spark, rows)
    assert got == brute(rows)
    assert len({len(r[7]) for r in got}) > 3 and any("R" in r[7] for r in got)


def test_dropped_and_empty(spark):
    gone = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = shown(spark, gone)
    assert got == brute(gone) and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got) and got
    assert shown(spark, []) == []


def by_letter(codes):
    """The same minimum row by row from the back: of equal costs the first letter decides, as it tells the path."""
    five = repair.INSERT
    now = {"": (0, ""), "s": (2 * five, "II"), "u": (five, "I"), "a": (0, "")}
    for code in reversed(codes):
        row = {s: min((c + now[t][0], x + now[t][1]) for x, c, t in repair.edges(s, code)) for s in repair.STATES}
        into = lambda s, row=row: (five + row[WANTED[s]][0], "I" + row[WANTED[s]][1])
        once = {s: min(row[s], into(s)) for s in repair.STATES}
        now = {s: min(once[s], (five + once[WANTED[s]][0], "I" + once[WANTED[s]][1])) for s in repair.STATES}
    return now[""]


@pytest.mark.parametrize("block", [1, 3, 32])
@pytest.mark.parametrize("insert", [5, 1])  # at 5 it never pays to insert
def test_blocks_change_nothing(monkeypatch, block, insert):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "INSERT", insert)
    repair.solve.cache_clear()
    r = random.Random(block)
    for n in [*range(9), 31, 32, 33, 64, 150, 700]:
        for _ in range(6):
            codes = bytes(r.choice([0, 2, 3, 3, 3, 4, 5, 6, 6, 6, 7, 8, 9, 10, 11]) for _ in range(n))
            assert repair.audit(codes) == by_letter(codes)
    assert insert > 1 or "I" in repair.audit(bytes([3]))[1]
    repair.solve.cache_clear()


def test_long_conversation_and_repaired_rows(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"Line {t // 4}." if t % 9 else "") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    df = repair.plain(spark.createDataFrame([(*r, "x", 1) for r in rows], KIND))
    found = repair.audits(df)
    out = {}
    for r in repair.repaired(df, found).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    roles = "".join(x[0] for x in out[1])
    assert roles == "ua" * (len(roles) // 2) and len(roles) > 1000
    want = {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in out.items()}
    got = {r.conv_id: r for r in repair.shown(df, found).collect()}
    assert {c: got[c].repaired_sha256 for c in want} == want
    bad = faults([r for r in rows if r[0] == 1])
    codes = bytes(3 * (1 + t % 2) + (2 if b in ("blank", "duplicate") else 0) for t, b in enumerate(bad))
    assert (got[1].cost, got[1].audit) == by_letter(codes)
