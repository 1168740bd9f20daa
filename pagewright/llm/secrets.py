"""Secret scans with multipart credential linking. DataFrame functions only.

Three base kinds are found by pattern and stand on their own: assignments of a secret,
access ids, and long hexadecimal strings. Beside them are weak parts, which alone mean
little: identifiers (upper-case letters and digits, or the user of an assignment such as
user=...), secrets (long strings of letters and digits of mixed kinds) and endpoints
(host names after a scheme). Parts of one document are linked
within a scope of SCOPE characters. A weak part is reported only if a complementary one
lies in its scope: a secret with an identifier or an endpoint, an identifier or an endpoint
with a secret. Base spans count as partners of their kind, an access id as an identifier,
an assignment or a hexadecimal string as a secret. Weak parts overlap neither base spans
nor each other: an endpoint goes before a weak secret, both before a weak identifier.

The link is an interval join of sorted parts: both sides are sorted by start into one
sequence, one pass over it carries the largest end of partners so far, one from behind the
least start of partners to come, and each part looks at those two numbers alone. It happens
inside a document's row, on the parts found there: nothing is shuffled, no pair is made,
and it does not matter how many rows a source has. Passes over arrays work in groups of
WIDTH, so that the work for a text grows with its length and not with its square.

Places are code points, the end exclusive. Null texts count as empty and have no span;
repeated rows have the same spans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reach of a weak part to each side, in characters.
SCOPE = 200

#: The patterns of base kinds. Letters of the first are spelt in both cases.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w).replace("#", "_?") for w in ("password", "passwd", "secret", "token", "api#key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Patterns of weak parts. All are runs of a class, found in one pass; MIXED_* tell which runs count.
WEAK_ID = r"(?:user|login|client_id|account)\x20*[:=]\x20*[A-Za-z0-9_.@-]{3,}|[A-Z0-9]{16,}"
MIXED_ID = (r"[A-Z]", r"[0-9]")
WEAK_SECRET = r"[A-Za-z0-9+/_-]{20,}"
MIXED_SECRET = (r"[a-z]", r"[A-Z]", r"[0-9]")
ENDPOINT = r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9.-]+(?::[0-9]+)?"

#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")


#: Elements of a pass that are carried one by one; groups of them are then carried as one.
WIDTH = 256

SPANS = "array<struct<start:int,kind:int,end:int,whole:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, carry: Callable[[Column, Column], Column]) -> Column:
    """values (an array of int) carried from left to right: each place holds carry of all up to it."""

    def flat(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.coalesce(carry(F.try_element_at(done, F.lit(-1)), x), x))))

    def groups(whole: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / WIDTH).cast("int")), lambda g: flat(F.slice(whole, g * WIDTH + 1, F.lit(WIDTH))))

    def carried(local: Column) -> Column:
        ahead = F.concat(F.array(F.lit(None).cast("int")), flat(F.transform(local, lambda g: F.try_element_at(g, F.lit(-1)))))
        return F.flatten(F.zip_with(local, F.slice(ahead, F.lit(1), F.size(local)), lambda g, before: F.transform(g, lambda x: F.coalesce(carry(before, x), x))))

    return bound(values, lambda whole: F.when(F.size(whole) == 0, whole).otherwise(bound(groups(whole), carried)))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches that do not overlap, as structs (start, kind, end, whole).

    Places come from the lengths of matches and of what lies between them. Texts without
    a match, most of all, cost one search.
    """

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(between, found, lambda gap, m: F.length(gap) + F.length(m)), lambda a, b: a + b)
        return F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("whole")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), bound(found, placed).cast(SPANS)).otherwise(F.array().cast(SPANS))


#: What comes before the value of an assignment, and how long a value must be.
BEFORE_VALUE, VALUE = rf"""^(?:{_NAMES})["']?\x20*[:=]\x20*["']?""", 8


def base_spans(text: Column) -> list[Column]:
    """Spans of the three base kinds, one array each. Assignments of shorter values match, and are dropped then."""
    assign = F.filter(matches(text, ASSIGN, 1), lambda x: F.length(F.regexp_replace(x["whole"], BEFORE_VALUE, "")) >= VALUE)
    return [assign, matches(text, ACCESS, 2), matches(text, HEX, 3)]


def _mixed(x: Column, needed: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [x["whole"].rlike(p) for p in needed])


def _joined(parts: Column, others: Column, within: Callable[[Column, Column, Column], Column], keep: bool) -> Column:
    """The parts for which within(part, end, start) is `keep`: end is the largest of others that start no later, start the least of those that start later."""
    far = 2**30

    def pick(events: Column) -> Column:
        before = running(F.transform(events, lambda e: F.when(e["mine"] == 0, e["span"]["end"]).otherwise(-far)), F.greatest)
        after = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(e["mine"] == 0, e["at"]).otherwise(far))), F.least))
        edges = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        seen = F.zip_with(events, edges, lambda e, x: F.struct(e["mine"].alias("mine"), e["span"].alias("span"), x.alias("x")))
        return F.transform(F.filter(seen, lambda e: (e["mine"] == 1) & (within(e["span"], e["x"]["a"], e["x"]["b"]) == keep)), lambda e: e["span"])

    event = lambda mine: lambda x: F.struct(x["start"].alias("at"), F.lit(mine).alias("mine"), x.alias("span"))
    events = lambda x: F.array_sort(F.concat(F.transform(x["parts"], event(1)), F.transform(x["others"], event(0))))
    alone = lambda x: F.array().cast(SPANS) if keep else x["parts"]
    either = lambda x: (F.size(x["parts"]) == 0) | (F.size(x["others"]) == 0)
    return bound(F.struct(parts.alias("parts"), others.alias("others")), lambda x: F.when(either(x), alone(x)).otherwise(bound(events(x), pick)))


def near(parts: Column, partners: Column) -> Column:
    """Parts with a partner in scope."""
    return _joined(parts, partners, lambda x, end, start: (end >= x["start"] - SCOPE) | (start <= x["end"] + SCOPE), True)


def apart(parts: Column, spans: Column) -> Column:
    """Parts that overlap no span."""
    return _joined(parts, spans, lambda x, end, start: (end > x["start"]) | (start < x["end"]), False)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `assign`, `access`, `hex` and `linked`: arrays of (start, kind, end), kind numbered from 1 as in KINDS.

    `linked` has the weak parts with a complementary part in scope. Columns of docs with
    these names are replaced.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumns(dict(zip(("assign", "access", "hex"), base_spans(whole), strict=True)))
    base = F.concat("assign", "access", "hex")
    # a weak part needs a partner, so texts without any secret need no search for identifiers and endpoints
    out = out.withColumn("__weak_secret", apart(F.filter(matches(whole, WEAK_SECRET, 5), lambda x: _mixed(x, MIXED_SECRET)), base))
    some_secret = (F.size("__weak_secret") + F.size("assign") + F.size("hex")) > 0
    out = out.withColumn("__endpoint", F.when(some_secret, apart(matches(whole, ENDPOINT, 6), base)).otherwise(F.array().cast(SPANS)))
    out = out.withColumn("__weak_secret", apart(F.col("__weak_secret"), F.col("__endpoint")))
    ids = F.filter(matches(whole, WEAK_ID, 4), lambda x: _mixed(x, MIXED_ID) | x["whole"].rlike("[:=]"))
    out = out.withColumn("__weak_id", F.when(some_secret, apart(ids, F.concat(base, F.col("__endpoint"), F.col("__weak_secret")))).otherwise(F.array().cast(SPANS)))
    secrets = F.concat("__weak_secret", "assign", "hex")
    others = F.concat("__weak_id", "__endpoint", "access")
    linked = F.concat(near(F.col("__weak_id"), secrets), near(F.col("__weak_secret"), others), near(F.col("__endpoint"), secrets))
    out = out.withColumn("linked", linked).drop("__weak_secret", "__weak_id", "__endpoint")
    slim = {c: F.array_sort(F.transform(c, lambda x: F.struct(x["start"], x["kind"], x["end"]))) for c in ("assign", "access", "hex", "linked")}
    return out.withColumns(slim)


def spelt(spans: Column) -> Column:
    """kind:start:end of each span, in order, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


#: Gaps between spans that are cut from one piece of a text: a place is found by counting from the start.
GAPS = 1024


def _cut(whole: Column, gaps: Column, mark: str) -> Column:
    """The gaps (a, b) of a text, joined by marks."""

    def group(part: Column) -> Column:
        start = F.element_at(part, 1)["a"]
        piece = F.substring(whole, start + 1, F.element_at(part, -1)["b"] - start)
        return bound(piece, lambda p: F.array_join(F.transform(part, lambda x: F.substring(p, x["a"] - start + 1, x["b"] - x["a"])), mark))

    groups = F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / GAPS).cast("int"))
    return F.array_join(F.transform(groups, lambda g: bound(F.slice(gaps, g * GAPS + 1, F.lit(GAPS)), group)), mark)


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of `text` replaced by a mark; spans that touch or overlap are one. Null stays null.

    Columns of docs stay as they are, those that bear the names of scan's too.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = scan(docs.select(row.alias("row"), F.col(text).cast("string").alias("whole")), "whole")
    out = out.withColumn("spans", F.array_sort(F.concat("assign", "access", "hex", "linked")))
    out = out.withColumn("ends", running(F.transform("spans", lambda x: x["end"]), F.greatest))
    starts = F.filter(F.transform("spans", lambda x, i: F.struct(F.coalesce(F.get("ends", i - 1), F.lit(-1)).alias("a"), x["start"].alias("b"))), lambda x: x["a"] < x["b"])
    starts = F.transform(starts, lambda x: F.struct(F.greatest(x["a"], F.lit(0)).alias("a"), x["b"].alias("b")))
    last = F.struct(F.try_element_at("ends", F.lit(-1)).alias("a"), F.length("whole").alias("b"))
    out = out.withColumn("gaps", F.concat(starts, F.array(last)))
    made = F.when(F.size("spans") > 0, _cut(F.col("whole"), F.col("gaps"), mark)).otherwise(F.col("whole"))
    return out.select(*[made.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
