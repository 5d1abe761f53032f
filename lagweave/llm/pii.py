"""Personal data: fixed patterns, then bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from four patterns. Their matches, and long hexadecimal secrets, are the seed entities. Candidates
are runs of identifier characters with digits; a candidate's lexical pattern is the last word before it with what
stands between, within CONTEXT characters. A candidate without a word there, as in lists, shares the pattern of the
candidate before it; the first of a text then has the pattern `^`. Over the graph of patterns and instances (distinct
strings), Spark scores in rounds, until no further pattern is trusted: a pattern's confidence is the mean confidence
of its instances, an instance's the best confidence of a trusted pattern, one that has at least SUPPORT instances of
worth and confidence TRUST; seeds keep 1. Trusted patterns extract the candidates that no base span touches, as spans
of kind `id`.

Spans are code-point offsets, end exclusive. Null and empty texts have none. The graph holds one row per distinct
pattern and instance, pre-aggregated before each shuffle, so a pattern that a third of all rows have is as cheap as
its distinct instances. Repeated rows get equal results; extra columns are not carried.

Places of matches are running sums over chunks of matches, so a text takes time in proportion to its length, and
candidates meet the base spans that touch them on cells of CELL characters.

The patterns here are written so that Java matches them in linear time and without recursion: runs are possessive
and a match may begin only where a run begins or the last match ended, which changes no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_row_id

SUPPORT, TRUST = 5, 0.8
LEAST_LENGTH, LEAST_DIGITS, CONTEXT, CELL = 6, 3, 48, 64
#: Matches whose places are summed up one after the other.
CHUNK = 64

# ---- fixed values: kinds in the order in which they are listed, with a cheap necessary condition -----
KINDS = ("email", "ip", "card", "phone", "id")
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
IDENT = "A-Za-z0-9_.@-"
CANDIDATE = rf"(?:(?<![{IDENT}])|\G)(?=[A-Za-z_.@-]*+[0-9])[{IDENT}]++"
SECRET = r"^[0-9a-f]{32,}$"
BEFORE = r"[\p{L}_]+[^\p{L}_]*$"
# ------------------------------------------------------------------------------------------------------


def digits(s) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d) -> Column:
    """Whether a digit string passes the Luhn test."""
    at = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.struct(F.try_to_number(c, F.lit("9")).cast("int").alias("c"), i.alias("i")))
    at = F.filter(at, lambda x: x.c.isNotNull())
    double = lambda x: F.when(x.i % 2 == 0, x.c).when(x.c < 5, 2 * x.c).otherwise(2 * x.c - 9)
    return F.aggregate(at, F.lit(0), lambda acc, x: acc + double(x)) % 10 == 0


def holds(kind: str, s) -> Column:
    """The condition on a match beyond its pattern."""
    n = F.length(digits(s))
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0")))
        return F.forall(F.split(s, r"\."), lambda p: (part(p) < 3) | ((part(p) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    if kind == "card":
        return (n >= 14) & (n <= 19) & luhn(digits(s))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def let(value, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def found(text, pattern: str, with_context: bool = False) -> Column:
    """array of (start, end, s, before): every match in turn; the pieces between matches tell where each begins.

    before, if asked for: the last word of the piece before the match and what follows it, else that of the match
    before, else `^`.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    word = (lambda p: F.lower(F.regexp_extract(F.substring(p, -CONTEXT, CONTEXT), BEFORE, 0))) if with_context else (lambda p: F.lit(""))
    pairs = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap"), word(p).alias("word")))
    kind = "array<struct<start:int,end:int,s:string,before:string>>"
    last = lambda acc, x: F.when(x.word == "", acc.word).otherwise(x.word).alias("word")
    begin = F.struct(F.lit(0).alias("at"), F.lit("^").alias("word"))

    def move(acc, x):
        return F.struct((acc.at + x.gap + F.length(x.m)).alias("at"), last(acc, x))

    def step(acc, x):
        start = acc.at + x.gap
        one = F.struct(start.alias("start"), (start + F.length(x.m)).alias("end"), x.m.alias("s"), last(acc, x).alias("before"))
        return F.struct((start + F.length(x.m)).alias("at"), last(acc, x), F.concat(acc.out, F.array(one)).alias("out"))

    def inside(chunk, state):
        first = F.struct(state.at.alias("at"), state.word.alias("word"), F.array().cast(kind).alias("out"))
        return F.aggregate(chunk, first, step, lambda acc: acc.out)

    def summed(chunks):
        """The state before each chunk: each chunk's own sum and last word, then those of the chunks before it."""
        own = F.transform(chunks, lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), F.lit("").alias("word")), move))
        states = F.aggregate(
            own,
            F.struct(F.lit(0).alias("at"), F.lit("^").alias("word"), F.array().cast("array<struct<at:int,word:string>>").alias("out")),
            lambda acc, x: F.struct((acc.at + x.at).alias("at"), last(acc, x), F.concat(acc.out, F.array(F.struct(acc.at.alias("at"), acc.word.alias("word")))).alias("out")),
            lambda acc: acc.out,
        )
        return F.flatten(F.zip_with(chunks, states, inside))

    def chunked(ps):
        return F.transform(F.sequence(F.lit(0), ((F.size(ps) - 1) / CHUNK).cast("int")), lambda c: F.slice(ps, c * CHUNK + 1, CHUNK))

    few = lambda ps: inside(ps, begin)
    return let(pairs, lambda ps: F.when(F.size(ps) <= CHUNK, few(ps)).otherwise(let(chunked(ps), summed)))


def base_spans(text) -> Column:
    """array of (start, kind number, end) by start, then kind."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        spans = F.transform(F.filter(found(text, PATTERNS[kind]), _holds(kind)), _span(k))
        parts.append(F.when(text.rlike(GUARDS[kind]), spans).otherwise(empty))
    return F.array_sort(F.concat(*parts))


def _holds(kind):
    return lambda x: holds(kind, x.s)


def _span(k):
    return lambda x: F.struct(x.start.alias("start"), F.lit(k).alias("kind"), x.end.alias("end"))


def candidates(text) -> Column:
    """array of (start, end, s, pattern): identifier-like runs and the lexical pattern before each."""
    enough = F.filter(found(text, CANDIDATE, True), lambda x: (F.length(x.s) >= LEAST_LENGTH) & ((F.length(digits(x.s)) >= LEAST_DIGITS) | x.s.contains("@")))
    shaped = F.transform(enough, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.s.alias("s"), x.before.alias("pattern")))
    return F.when(text.rlike("[0-9]"), shaped).otherwise(F.array().cast("array<struct<start:int,end:int,s:string,pattern:string>>"))


def trusted(edges: DataFrame) -> DataFrame:
    """pattern and its confidence p: those to trust, from a table (pattern, s, seed) of distinct patterns and instances.

    seed (0 or 1) starts as an instance's confidence; every round trusted patterns pass theirs on to instances.
    Confidences never fall, so rounds end when no further pattern becomes trusted.
    """
    scored, were = edges.withColumn("c", F.col("seed").cast("double")), -1
    while True:
        worth = F.sum((F.col("c") >= TRUST).cast("long"))
        patterns = materialize(scored.groupBy("pattern").agg(F.avg("c").alias("p"), worth.alias("worth")).where((F.col("worth") >= SUPPORT) & (F.col("p") >= TRUST)).select("pattern", "p"), "patterns")
        now = patterns.count()
        if now == were:
            return patterns
        were = now
        instances = edges.join(patterns, "pattern").groupBy("s").agg(F.max("p").alias("best"))
        scored = materialize(edges.join(instances, "s", "left").select("pattern", "s", "seed", F.greatest(F.col("seed").cast("double"), F.coalesce("best", F.lit(0.0))).alias("c")), "scored")


def cells(spans: DataFrame) -> DataFrame:
    return spans.withColumn("cell", F.explode(F.sequence((F.col("start") / CELL).cast("int"), ((F.col("end") - 1) / CELL).cast("int"))))


def extract(docs: DataFrame) -> DataFrame:
    """Per row: _row, doc_id, base and spans, both arrays of (start, kind number, end)."""
    text = F.col("t")
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    scanned = materialize(with_row_id(read, "_row").select("_row", "doc_id", base_spans(text).alias("base"), candidates(text).alias("cands")), "pii")
    each = scanned.where(F.size("cands") > 0).select("_row", F.explode("cands").alias("c")).select("_row", "c.*")
    taken = scanned.where("size(cands) > 0 and size(base) > 0").select("_row", F.explode("base").alias("b")).select("_row", "b.start", "b.end")
    x, y = cells(each.select("_row", "start", "end")).alias("x"), cells(taken).alias("y")
    meet = (F.col("x._row") == F.col("y._row")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
    touched = x.join(y, meet).select("x._row", "x.start").distinct().withColumn("touched", F.lit(True))
    each = materialize(each.join(touched, ["_row", "start"], "left").withColumn("touched", F.coalesce("touched", F.lit(False))), "candidates")
    edges = materialize(each.groupBy("pattern", "s").agg(F.max((F.col("touched") | F.col("s").rlike(SECRET)).cast("int")).alias("seed")), "edges")
    new = each.where("not touched").join(trusted(edges), "pattern").groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("more"))
    return scanned.select("_row", "doc_id", "base").join(new, "_row", "left").select("_row", "doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def written(spans) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def shown(got: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    return got.select("doc_id", *map(count, range(4)), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
