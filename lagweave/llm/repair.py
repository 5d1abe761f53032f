"""Structure repair of conversations: the cheapest edits that make roles read (s?(ua)+)?, by one integer minimum.

Rows of a conversation are taken by turn (nulls first), then role, then text. A row's first fault counts: blank,
duplicate (its role and text seen earlier in the conversation), truncated (its last character is none of . ! ?).
Edits: Keep 0, Rerole 1, Delete 2 (the only one for blank and duplicate rows), Insert an empty user or assistant text 5;
a truncated row that stays adds 5. Of the cheapest the audit (the edits' initials) that is least in ASCII wins.

A path through the graph of (rows read, texts inserted, role before) is weighed by one big integer: its high digits are
the cost, the low ones the audit, a fixed number of BITS a letter at the letter's place, zeros after the end. Weights
of edges add up, so the least integer is the cheapest path with the least audit. Long conversations are solved by
blocks of BLOCK rows from the back: a block's digits hold its own letters and later blocks enter as costs. That is
exact, as a block's path ends with a row's letter: of two different ones none continues the other.

Conversations stream through a task in order, so one of any length holds a byte a row; its texts pass by a second time
for the repair. Nulls count as one space, a null conv_id is a conversation of its own; extra columns are not carried.
Conversations without rows give zeros, an empty audit and no rows; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Rows that one big integer spans, and bits of a letter.
BLOCK, BITS = 32, 3
LETTERS = "DIKR"
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
#: The initial of the role before; the empty string before any.
STATES = ["", "s", "u", "a"]
#: A row's code: 3 times the place of its role's initial here, plus whether it is whole, truncated or has to go.
INITIALS = "sua?"
WHOLE, TRUNCATED, GONE = range(3)
#: The code of a row that only tells that its conversation exists.
ABSENT = 255


def follows(before: str, initial: str) -> bool:
    return before + initial in ("s", "u", "su", "ua", "au")


def wanted(before: str) -> str:
    """The role's initial that an edit can put after this one."""
    return "a" if before == "u" else "u"


def edges(before: str, code: int) -> list[tuple[str, int, str]]:
    """(letter, cost, initial after it) of the edits of a row."""
    initial, fault = INITIALS[code // 3], code % 3
    out = [("D", DELETE, before)]
    if fault != GONE:
        cut = CUT if fault == TRUNCATED else 0
        out.append(("R", REROLE + cut, wanted(before)))
        if follows(before, initial):
            out.append(("K", cut, initial))
    return out


@lru_cache(1 << 15)
def solve(codes: bytes, ends: tuple, last: bool) -> tuple:
    """(cost, letters) for each state before the block; ends: costs of what follows it by state, None where it can't.

    No path needs more insertions than deleting every row and building the state anew would cost.
    """
    n, most = len(codes), (DELETE * len(codes) + 2 * INSERT) // INSERT
    width = BITS * (n + most)
    letter = lambda x, place: LETTERS.index(x) + 1 << width - BITS * (place + 1)
    best: dict[tuple[int, int, str], int] = {}
    for i in range(n, -1, -1):
        for j in range(most, -1, -1):
            for k, s in enumerate(STATES):
                found = [ends[k] << width] if i == n and ends[k] is not None else []
                if i < n:
                    found += [(cost << width) + letter(x, i + j) + rest for x, cost, t in edges(s, codes[i]) if (rest := best.get((i + 1, j, t))) is not None]
                if j < most and (i < n or last) and (rest := best.get((i, j + 1, wanted(s)))) is not None:
                    found.append((INSERT << width) + letter("I", i + j) + rest)
                if found:
                    best[i, j, s] = min(found)
    out = []
    for s in STATES:
        value = best.get((0, 0, s))
        if value is None:
            out.append((None, ""))
            continue
        digits = (value >> width - BITS * (p + 1) & (1 << BITS) - 1 for p in range(n + most))
        out.append((value >> width, "".join(LETTERS[d - 1] for d in digits if d)))
    return tuple(out)


def replay(letters: str, codes: bytes, state: str) -> str:
    """The state after a block's letters."""
    at = 0
    for x in letters:
        if x in "KR":
            state = INITIALS[codes[at] // 3] if x == "K" else wanted(state)
        elif x == "I":
            state = wanted(state)
        at += x != "I"
    return state


def audit(codes: bytes) -> tuple[int, str]:
    """The cost and the audit of a conversation's rows."""
    parts = [bytes(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)] or [b""]
    ends, solved = (0, None, None, 0), []
    for k in range(len(parts) - 1, -1, -1):
        solved.append(solve(parts[k], ends, k == len(parts) - 1))
        ends = tuple(cost for cost, _ in solved[-1])
    state, out = "", []
    for codes, found in zip(parts, reversed(solved)):
        out.append(found[STATES.index(state)][1])
        state = replay(out[-1], codes, state)
    return ends[0], "".join(out)


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn (long), role, text, with one space for null roles and texts, and whether the row is there."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(True).alias("there"))


def damaged(conversations: DataFrame) -> DataFrame:
    """plain rows, a share of them dropped (not there), emptied, without ends of sentences, repeated, or by the user."""
    df = plain(conversations)
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).cast("int")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("there"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("again"))
    return df.drop("again")


def in_order(df: DataFrame, *more: str) -> DataFrame:
    """Every conversation in one partition, by turn, role and text."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *more, F.col("turn").asc_nulls_first(), "role", "text")


def stream(batches, names: list[str]):
    """(conv_id, its rows) one after the other, across batches."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names)))
    return groupby(rows, key=lambda r: r[0])


def coded(df: DataFrame) -> DataFrame:
    """conv_id, turn and code, in order. Earlier rows of equal role and text are found in the same partitions."""
    before = Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = df.repartition("conv_id").withColumn("copy", F.row_number().over(before) > 1)
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", 0).when(F.col("copy"), 1).when(~end.isin(".", "!", "?"), 2).otherwise(3)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    rows = seen.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    return rows.select("conv_id", "turn", F.when(F.col("there"), initial * 4 + fault).otherwise(ABSENT).cast("int").alias("code"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(df: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of rows as plain() or damaged() give them."""
    kind = df.schema["conv_id"].dataType

    def run(batches):
        out: list[tuple] = []
        for conv, rows in stream(batches, ["conv_id", "turn", "code"]):
            codes, faults, turns, illegal, last, lo, hi = bytearray(), [0] * 4, 0, 0, None, None, None
            for _, turn, code in rows:
                if code == ABSENT:
                    continue
                if turn is not None and turn != hi:
                    lo, hi, turns = turn if lo is None else lo, turn, turns + 1
                initial, fault = INITIALS[code // 4], code % 4
                faults[fault] += 1
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
                codes.append(code // 4 * 3 + (GONE, GONE, TRUNCATED, WHOLE)[fault])
            cost, letters = audit(codes)
            out.append((conv, hi - lo + 1 - turns if turns else 0, *faults[:3], illegal, cost, letters))
            if len(out) >= 1000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(out):
        cols = list(zip(*out)) or [()] * 8
        types = [None, *[pa.int64()] * 6, pa.string()]
        first = pa.array(cols[0], to_arrow(kind))
        return pa.RecordBatch.from_arrays([first, *(pa.array(c, t) for c, t in zip(cols[1:], types[1:]))], names=["conv_id", *COUNTS, "audit"])

    return coded(df).mapInArrow(run, f"conv_id {kind.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string")


def to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def edited(rows, letters: str):
    """(role, text) of a conversation's rows after the edits."""
    state, rows = "", iter(rows)
    for x in letters:
        role, text = (None, "") if x == "I" else next(rows)
        if x == "D":
            continue
        state = role[:1] if x == "K" else wanted(state)
        yield (role if x == "K" else ROLES[state]), text


def with_audits(df: DataFrame, found: DataFrame) -> DataFrame:
    """A conversation's audit as its first row, then its rows in order."""
    head = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = df.where("there").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text")
    return in_order(head.union(rows), "part").select("conv_id", "role", "text")


def repaired(df: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, from the rows and their audits."""
    kind = df.schema["conv_id"].dataType

    def run(batches):
        out, size = [], 0
        for conv, rows in stream(batches, ["conv_id", "role", "text"]):
            letters = next(rows)[2]
            for place, (role, text) in enumerate(edited(((r, t) for _, r, t in rows), letters)):
                out.append((conv, place, role, text))
                size += len(text)
                if len(out) >= 10_000 or size >= 1 << 23:
                    yield batch(out)
                    out, size = [], 0
        yield batch(out)

    def batch(out):
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow(kind)), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["conv_id", "place", "role", "text"])

    return with_audits(df, found).mapInArrow(run, f"conv_id {kind.simpleString()}, place bigint, role string, text string")


def digests(df: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired rows as role:text, joined by newlines, hashed as they pass by."""
    kind = df.schema["conv_id"].dataType

    def run(batches):
        out: list[tuple] = []
        for conv, rows in stream(batches, ["conv_id", "role", "text"]):
            digest, letters = hashlib.sha256(), next(rows)[2]
            for place, (role, text) in enumerate(edited(((r, t) for _, r, t in rows), letters)):
                digest.update((("\n" if place else "") + f"{role}:{text}").encode())
            out.append((conv, digest.hexdigest()))
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(out):
        cols = list(zip(*out)) or [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow(kind)), pa.array(cols[1], pa.string())], names=["conv_id", "repaired_sha256"])

    return with_audits(df, found).mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def shown(df: DataFrame, found: DataFrame) -> DataFrame:
    """audits with repaired_sha256; a null conv_id meets itself."""
    hashes = digests(df, found).withColumnRenamed("conv_id", "id")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")


def oracle_sql() -> str:
    """The same for DuckDB: strings of a cost in nine digits and an audit, least first, row by row from the back."""
    # The table of the checksum from its rule, and the checksum of a key.
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1])), 4294967295)"
    add = lambda cost, letter, v: f"lpad(CAST(CAST({v}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{letter}' || {v}[10:]"
    stays = f"{CUT} * CAST(fault = 2 AS INTEGER)"

    def row(own: str, to: str, kept: dict[str, str]) -> str:
        """The least of a row's edits in a state: the value of what follows by state."""
        keep = " ".join(f"WHEN role[1:1] = '{i}' THEN {add(stays, 'K', v)}" for i, v in kept.items())
        return f"least({add(DELETE, 'D', own)}, CASE WHEN fault > 1 THEN {add(f'{REROLE} + {stays}', 'R', to)} END, CASE WHEN fault > 1 THEN CASE {keep} END END)"

    raw = {"n": row("v.n", "v.u", {"s": "v.s", "u": "v.u"}), "s": row("v.s", "v.u", {"u": "v.u"}), "u": row("v.u", "v.a", {"a": "v.a"}), "a": row("v.a", "v.u", {"u": "v.u"})}
    into = add(INSERT, "I", "ru")
    twice = add(2 * INSERT, "II", "ra")
    closed = f"least(rn, {into}, {twice}) AS n, least(rs, {into}, {twice}) AS s, least(ru, {add(INSERT, 'I', 'ra')}) AS u, least(ra, {into}) AS a"
    gone = "CASE WHEN state = 'u' THEN 'a' ELSE 'u' END"
    named = "CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END"
    space = "\\x20\\x09-\\x0D"
    return rf"""
WITH RECURSIVE
b AS (SELECT {table} AS crcs),
q AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT q.*, {crc} % 20 AS kind FROM q, b),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM
    (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[{space}]+$', '') AS t FROM e),
r AS (SELECT *, CASE WHEN t = '' THEN 0 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 1 WHEN t[-1:] NOT IN ('.', '!', '?') THEN 2 ELSE 3 END AS fault FROM o),
v AS (SELECT conv_id, max(i) + 1 AS i, '000000000' AS n, '000000010II' AS s, '000000005I' AS u, '000000000' AS a FROM r GROUP BY conv_id
    UNION ALL SELECT conv_id, i, {closed} FROM (SELECT r.conv_id, r.i, {", ".join(f"{x} AS r{k}" for k, x in raw.items())} FROM v JOIN r ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = v.i - 1)),
z AS (SELECT conv_id, CAST(n[1:9] AS BIGINT) AS cost, n[10:] AS audit FROM v WHERE i = 1),
w AS (SELECT conv_id, audit, 0 AS p, 0 AS i, '' AS state, CAST(NULL AS VARCHAR) AS out FROM z
    UNION ALL SELECT w.conv_id, audit, p + 1, w.i + CAST(x <> 'I' AS INTEGER), CASE x WHEN 'D' THEN state WHEN 'K' THEN r.role[1:1] ELSE {gone} END,
        CASE WHEN x = 'D' THEN out ELSE coalesce(out || chr(10), '') || CASE x WHEN 'K' THEN r.role ELSE {named} END || ':' || CASE x WHEN 'I' THEN '' ELSE r.text END END
        FROM (SELECT *, audit[p + 1 : p + 1] AS x FROM w WHERE p < len(audit)) w LEFT JOIN r ON w.x <> 'I' AND w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate, count(*) FILTER (fault = 2) AS truncated FROM r GROUP BY conv_id),
g AS (SELECT conv_id, count(*) FILTER (before IS NOT NULL AND before || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id)
SELECT k.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in COUNTS)}, coalesce(z.audit, '') AS audit, sha256(coalesce(w.out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN f ON k.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN g ON k.conv_id IS NOT DISTINCT FROM g.conv_id
    LEFT JOIN z ON k.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN w ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND w.p = len(w.audit)"""
