"""Secret scan with Spark SQL functions only.

Base kinds are pattern matches: `assign` (a key word, a separator and a value of 8 or more characters), `access`
(AKIA and 12 or more capitals or digits) and `hex` (32 or more lower-case hex digits). Beside them, candidate
strings of 20 or more key characters that hold both letters and digits are scanned by windows of 20 characters: the Shannon
entropy of each window comes from the one before by taking the leaving character's count down and the entering
one's up. Each character class (hex, one-case letters and digits, mixed) has its own bound; the span runs from the first to
the last window over it. Candidates on the allow list (UUIDs, integrity prefixes, alphabets and digit rows in order, one
character again and again) and spans that touch a base span are left out.

Defined cases: a null text is an empty one; very long texts are read whole; repeated rows are scanned each; an empty table
gives no rows; extra columns stay as they are unless they have a result's name, which the result then takes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.arrays import let, running, running_sum


def _any_case(words: str) -> str:
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


# The base patterns of the contract (letters of the key words in either case).
ASSIGN = "(" + _any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 or more: a run's first AKIA has the longest rest
HEX = "[0-9a-f]{32,}"  # as [0-9a-f]+ of 32 or more: runs are maximal
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_mixed")

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character in a window of 20 (at most 4.32).
BOUNDS = {"entropy_hex": 3.0, "entropy_alnum": 3.4, "entropy_mixed": 3.7}
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^sha(1|256|384|512)-",
    "(?i)abcdefghijkl|0123456789|9876543210|zyxwvutsrq",
)


_SPAN = "array<struct<start:int,kind:string,end:int,text:string>>"
#: Characters in a block of a text that is cut into many pieces.
_BLOCK = 1024


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """All matches as (start, kind, end, text): the lengths of matches and of the texts between them, summed up, have the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        steps = F.transform(m["found"], lambda x, i: F.length(F.get(m["gaps"], i)) + F.length(x))
        ends = running_sum(steps)
        span = lambda e: lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), x.alias("text"))
        return let(ends, lambda e: F.transform(m["found"], span(e)))

    places = let(F.struct(found.alias("found"), gaps.alias("gaps")), placed)
    return F.when(text.rlike(pattern), places).otherwise(F.array().cast(_SPAN))


def _entropy_extent(s: Column, bound: Column) -> Column:
    """(first, last) window start whose entropy reaches the bound, as a struct; nulls if none does.

    With c the counts in a window, its entropy is log2(WINDOW) - sum(c log2 c) / WINDOW. From window to window the sum changes by
    the count of the character that leaves, going down by one, and of the one that enters, going up."""
    f = [0.0, 0.0] + [c * math.log2(c) for c in range(2, WINDOW + 1)]
    up, down = (F.array(*(F.lit(f[c + 1] - f[c]) for c in range(WINDOW))), F.array(*(F.lit(f[max(0, c - 1)] - f[c]) for c in range(WINDOW + 1))))
    none = F.lit(None).cast("int")

    def scanned(given: Column) -> Column:
        codes, least = given["codes"], given["least"]
        count = lambda start, n, c: n - F.size(F.array_remove(F.slice(codes, start, n), c))

        def step(a: Column, i: Column) -> Column:
            # Character i (from 0) enters; from the 21st on, character i - WINDOW leaves first.
            gone = F.when(i >= WINDOW, let(F.get(codes, i - WINDOW), lambda c: count(i - WINDOW + 1, F.lit(WINDOW), c))).otherwise(F.lit(0))
            held = F.least(i, F.lit(WINDOW - 1))
            new = let(F.get(codes, i), lambda c: count(i - held + 1, held, c))
            change = F.get(down, gone) + F.get(up, new)

            def noted(total: Column) -> Column:
                hot = (i >= WINDOW - 1) & (total - least < 5e-7)  # sums of rounded logarithms
                at = i - (WINDOW - 1)
                return F.struct(total.alias("total"), F.coalesce(a["first"], F.when(hot, at)).alias("first"), F.when(hot, at).otherwise(a["last"]).alias("last"))

            return let(a["total"] + change, noted)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), F.struct(F.lit(0.0).alias("total"), none.alias("first"), none.alias("last")), step)

    letters = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    return let(F.struct(letters.alias("codes"), (F.lit(WINDOW * 1.0) * (F.lit(math.log2(WINDOW)) - bound)).alias("least")), scanned)


def _apart(added: Column, base: Column) -> Column:
    """Those of `added` that overlap no span of `base`: the furthest end of the base spans that start before their end is no later than their start."""
    bare = F.lit(None).cast("int")
    item = lambda at, base_end, x: F.struct(at.alias("at"), base_end.alias("base_end"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    # At the same place a candidate comes first (null before numbers): a base span that starts at its end is apart.
    both = F.array_sort(F.concat(F.transform(base, lambda x: item(x["start"], x["end"], x)), F.transform(added, lambda x: item(x["end"], bare, x))), _by_place)

    def kept(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda x: x["base_end"]), lambda x, y: F.greatest(x, y))
        free = lambda r: lambda x, i: x["base_end"].isNull() & (F.coalesce(F.get(r, i), F.lit(0)) <= x["start"])
        return F.transform(let(reach, lambda r: F.filter(xs, free(r))), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return let(both, kept)


def _by_place(x: Column, y: Column) -> Column:
    rank = lambda v: v["at"] * 2 + F.when(v["base_end"].isNull(), 0).otherwise(1)
    return (rank(x) - rank(y)).cast("int")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base_spans` and `spans`: arrays of (start, kind, end), by start, then kind as in KINDS."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = F.create_map([x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ranked = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["start"], x["kind"], x["end"]))

    long_value = lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= 8
    base = F.concat(
        F.when(t.rlike(ASSIGN[:-2] + "{8,})"), F.filter(_spans(t, ASSIGN, "assign"), long_value)).otherwise(F.array().cast(_SPAN)),
        _spans(t, ACCESS, "access"),
        _spans(t, HEX, "hex"),
    )
    s = lambda x: x["text"]
    kind = lambda x: F.when(s(x).rlike("^([0-9a-f]+|[0-9A-F]+)$"), "entropy_hex").when(s(x).rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "entropy_alnum").otherwise("entropy_mixed")
    bounds = F.create_map([x for k, v in BOUNDS.items() for x in (F.lit(k), F.lit(v))])
    suspicious = lambda x: s(x).rlike("[0-9]") & s(x).rlike("[A-Za-z]") & ~s(x).rlike("|".join(f"({p})" for p in ALLOWED))
    candidates = F.filter(_spans(t, CANDIDATE, "candidate"), suspicious)
    judged = lambda x: let(kind(x), lambda k: F.struct(x["start"].alias("start"), k.alias("kind"), _entropy_extent(s(x), bounds[k]).alias("extent")))
    hot = F.filter(F.transform("__candidates", judged), lambda x: x["extent"]["first"].isNotNull())
    added = F.transform(hot, lambda x: F.struct((x["start"] + x["extent"]["first"]).alias("start"), x["kind"].alias("kind"), (x["start"] + x["extent"]["last"] + WINDOW).alias("end")))
    out = docs.withColumn("base_spans", plain(ranked(base))).withColumn("__candidates", candidates)
    both = let(_apart(added, F.col("base_spans")), lambda more: plain(ranked(F.concat("base_spans", more))))
    return out.withColumn("spans", F.when(F.size("__candidates") == 0, F.col("base_spans")).otherwise(both)).drop("__candidates")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(scanned: DataFrame, text: str = "text") -> DataFrame:
    """The text with each span replaced by `[kind]`; overlapping spans become one, named by the first."""
    t = F.coalesce(F.col(text), F.lit(""))

    def done(given: Column) -> Column:
        blocks, spans, reach = given["blocks"], given["spans"], given["reach"]
        upto = lambda i: F.coalesce(F.get(reach, i), F.lit(0))  # noqa: E731  where the spans up to i end

        def part(a: Column, b: Column) -> Column:
            first = F.call_function("div", a, F.lit(_BLOCK)).cast("int")
            some = F.slice(blocks, first + 1, F.call_function("div", b, F.lit(_BLOCK)).cast("int") - first + 1)
            return F.when(b > a, F.substring(F.array_join(some, ""), a % _BLOCK + 1, b - a)).otherwise("")

        heads = F.filter(F.transform(spans, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: h["x"]["start"] >= upto(h["i"] - 1))
        said = F.transform(heads, lambda h: F.concat(part(upto(h["i"] - 1), h["x"]["start"]), F.lit("["), h["x"]["kind"], F.lit("]")))
        return F.concat(F.array_join(said, ""), part(upto(F.size(spans) - 1), given["size"]))

    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    reach = running(F.transform("spans", lambda x: x["end"]), lambda x, y: F.greatest(x, y))
    whole = let(F.struct(blocks.alias("blocks"), F.col("spans").alias("spans"), reach.alias("reach"), F.length(t).alias("size")), done)
    return scanned.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs.select("doc_id", "text")).select("doc_id", *map(count, KINDS[:3]), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))
