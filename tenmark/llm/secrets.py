"""Secret scans: fixed forms, and sliding-window entropy over candidate strings. DataFrame functions only.

Spans are code points, end exclusive. Spark gives the matches of a pattern and the text between them, so
positions are running sums of their lengths. Each pattern runs only on texts where a cheaper test says that
it can match.

Entropy: a candidate is a run of 20 or more characters of the base64 alphabets with a letter and a digit.
What an allow-list pattern matches or a base span overlaps is cut out of it, in one sweep over all spans by
start; each part left is judged by itself, if it still is a candidate. Its class is ``hex`` if it has hexadecimal digits alone, ``lower`` or
``upper`` (base32) if it has letters of one case and digits alone, else ``base64``. A window of ``WINDOW``
characters slides over it; the counts and the sum of c*log2(c) are updated by the character that enters and
the one that leaves. A part is reported when a window's entropy reaches the class's threshold.

All of it takes time in proportion to the text, also with one run of any length or any number of matches. Spark
copies the state of a fold at each step, so no fold here has a state that grows; running sums and maxima go by
chunks, and what is cut out of a text is cut out of blocks of it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The contract's patterns. Hex and access runs are maximal, so their least lengths can stand in the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
NO_CANDIDATE = r"[^A-Za-z0-9+/_=-]"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
THRESHOLD = {"hex": 3.0, "lower": 3.4, "upper": 3.4, "base64": 3.7}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Values that look random and are none: identifiers, placeholders, rows of the alphabet.
ALLOWED = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"(?i)example|sample|placeholder|changeme|dummy", r"(?i)abcdefgh|qwertyui", r"01234567|12345678", r"(.)\1{7}")
_NONE = "array<struct<start:int,kind:int,stop:int>>"
_CHUNK = 16
_BLOCK = 4096


def _bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _before(df: DataFrame, values: dict[str, Column], op) -> DataFrame:
    """Adds for each name an array: for each of its ``values`` what ``op`` makes of 0 and all values before it.

    Values go in chunks of the root of their number, so n of them take n times that root, and far less in practice.
    """
    fold = lambda v: F.aggregate(v, F.lit(0), op)
    plain = lambda v: F.transform(v, lambda _, i: fold(F.slice(v, F.lit(1), i)))
    held = {n: unused([*df.columns, *values], f"{n}_values", f"{n}_chunks", f"{n}_totals") for n in values}
    df = df.withColumns({held[n][0]: v for n, v in values.items()})

    def cut(own):
        size = F.greatest(F.lit(_CHUNK), F.ceil(F.sqrt(F.size(own))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / size).cast("int")), lambda k: F.slice(F.col(own), k * size + 1, size))

    df = df.withColumns({chunk: F.when(F.size(own) > 0, cut(own)) for own, chunk, _ in held.values()})
    df = df.withColumns({total: F.transform(chunk, fold) for _, chunk, total in held.values()})
    whole = {}
    for n, (_, chunk, total) in held.items():
        both = F.arrays_zip(F.col(chunk).alias("own"), plain(F.col(total)).alias("base"))
        whole[n] = F.flatten(F.transform(both, lambda z: F.transform(plain(z["own"]), lambda x: op(z["base"], x))))
    return df.withColumns(whole).drop(*(c for three in held.values() for c in three))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """Characters ``start`` to ``stop`` of a text by its blocks, without a scan from its beginning."""
    first = F.floor(start / _BLOCK).cast("int")
    own = F.array_join(F.slice(blocks, first + 1, F.greatest(F.floor((stop - 1) / _BLOCK).cast("int") - first + 1, F.lit(1))), "")
    return F.when(stop > start, F.substring(own, start - first * _BLOCK + 1, stop - start)).otherwise(F.lit(""))


def _span(start: Column, kind: int, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), stop.cast("int").alias("stop"))


class _Form(NamedTuple):
    """A pattern, its kind, the group that must have ``least`` characters, and where it may match at all."""

    pattern: str
    kind: int
    may: Column
    group: int = 0
    least: int = 1
    mixed: bool = False


def _with_matches(df: DataFrame, text: Column, forms: dict[str, _Form]) -> DataFrame:
    """Adds for each name the spans of its form in ``text``, in order."""
    found = dict(zip(forms, unused([*df.columns, *forms], *(f"{n}_found" for n in forms)), strict=True))
    at = dict(zip(forms, unused([*df.columns, *forms, *found.values()], *(f"{n}_at" for n in forms)), strict=True))

    def matches(f):
        every = F.regexp_extract_all(text, F.lit(f.pattern), F.lit(0))
        columns = [every.alias("m"), F.slice(F.split(text, f.pattern), F.lit(1), F.greatest(F.size(every), F.lit(1))).alias("p")]
        if f.group:
            columns.append(F.regexp_extract_all(text, F.lit(f.pattern), F.lit(f.group)).alias("g"))
        return F.when(f.may, F.arrays_zip(*columns))

    df = df.withColumns({found[n]: matches(f) for n, f in forms.items()})
    df = _before(df, {at[n]: F.transform(found[n], lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))) for n in forms}, lambda a, x: a + x)

    def spans(n, f):
        def good(z):
            own = z["x"]["g" if f.group else "m"]
            return F.coalesce(F.length(own) >= f.least, F.lit(False)) & (_mixed(own) if f.mixed else F.lit(True))

        start = lambda z: z["at"] + F.length(z["x"]["p"])
        whole = F.filter(F.arrays_zip(F.col(found[n]).alias("x"), F.col(at[n]).alias("at")), good)
        return F.coalesce(F.transform(whole, lambda z: _span(start(z), f.kind, start(z) + F.length(z["x"]["m"]))), F.array().cast(_NONE))

    return df.withColumns({n: spans(n, f) for n, f in forms.items()}).drop(*found.values(), *at.values())


def _mixed(s: Column) -> Column:
    return s.rlike("[0-9]") & s.rlike("[A-Za-z]")


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of ``window`` consecutive characters (of all of them if fewer).

    Characters outside ``ALPHABET`` are skipped. ``window`` is at most 60.
    """
    codes = F.filter(F.transform(F.split(s, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.position(c, F.lit(ALPHABET)))), lambda c: c > 0)
    part = F.lit([0.0] + [n * math.log2(n) for n in range(1, window + 2)])  # n * log2(n)
    # counts are one character each, so that one can be read and replaced by its place
    zero = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))

    def peak(code):  # bound to a variable, so that it is evaluated once
        moves = F.flatten(F.transform(code, lambda c, i: F.when(i >= window, F.array(-F.element_at(code, i - window + 1), c)).otherwise(F.array(c))))
        size = F.least(F.size(code), F.lit(window))

        def step(a, move):
            place, by = F.abs(move), F.signum(move.cast("double")).cast("int")
            count = F.ascii(F.substring(a["counts"], place, F.lit(1))) - ord("A")
            total = a["sum"] - part[count] + part[count + by]
            n = a["n"] + by
            entropy = F.log2(size.cast("double")) - total / size
            return F.struct(
                F.overlay(a["counts"], F.char(F.lit(ord("A")) + count + by), place, F.lit(1)).alias("counts"), total.alias("sum"),
                F.when(n == size, F.greatest(a["best"], entropy)).otherwise(a["best"]).alias("best"), n.alias("n"),
            )

        return F.aggregate(moves, zero, step, lambda a: F.round(a["best"], 9))

    return _bound(codes, peak)


def _parts(df: DataFrame, name: str, spans: Column) -> DataFrame:
    """Adds what of the candidates (kind 3) among sorted ``spans`` no other span covers, if it has ``WINDOW`` characters.

    Such a part can only lie between the start of one span and that of the next: from where the others so far
    reach, or the candidate begins, to there, or where the candidate ends.
    """
    every, opens, cuts, ends = unused(df.columns, "_every", "_opens", "_cuts", "_ends")
    df = df.withColumn(every, spans)
    of = {
        opens: lambda x: F.when(x["kind"] == 3, x["start"]).otherwise(0),
        cuts: lambda x: F.when(x["kind"] == 3, 0).otherwise(x["stop"]),
        ends: lambda x: F.when(x["kind"] == 3, x["stop"]).otherwise(0),
    }
    df = _before(df, {n: F.transform(every, f) for n, f in of.items()}, lambda a, x: F.greatest(a, x))
    starts = F.transform(every, lambda x: x["start"])
    following = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(every), F.lit(1))), F.array(F.lit(2**31 - 1)))
    whole = F.arrays_zip(F.col(every).alias("x"), following.alias("next"), *(F.col(n).alias(k) for n, k in ((opens, "open"), (cuts, "cut"), (ends, "end"))))

    def part(z):
        own = {n: f(z["x"]) for n, f in of.items()}
        start = F.greatest(z["open"], own[opens], z["cut"], own[cuts])
        return _span(start, 3, F.least(z["next"], F.greatest(z["end"], own[ends])))

    found = F.filter(F.transform(whole, part), lambda x: x["stop"] - x["start"] >= WINDOW)
    return df.withColumn(name, found).drop(every, opens, cuts, ends)


def _random(parts: Column, blocks: Column, threshold: dict[str, float]) -> Column:
    """Those of the parts that look random."""

    def keep(s):
        least = F.lit(threshold["base64"])
        for name, pattern in (("upper", "^[A-Z0-9]+=*$"), ("lower", "^[a-z0-9]+$"), ("hex", "^[0-9a-fA-F]+$")):
            least = F.when(s.rlike(pattern), F.lit(threshold.get(name, threshold["base64"]))).otherwise(least)
        return F.when(_mixed(s), peak_entropy(s) >= least).otherwise(F.lit(False))

    return F.filter(parts, lambda p: _bound(_between(blocks, p["start"], p["stop"]), keep))


def with_spans(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED, threshold: dict[str, float] | None = None, names: tuple[str, str] = ("_base", "_all")) -> DataFrame:
    """Adds the sorted base spans and all sorted spans of a text, arrays of ``(start, kind, stop)``, under ``names``.

    Other columns stay. An allow-list pattern sees every run of candidate characters as a line of its own.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    assign, access, hexes, maybe, lines, blocks, parts, *allow = unused([*docs.columns, *names], "_assign", "_access", "_hex", "_maybe", "_lines", "_text", "_parts", *(f"_allow{k}" for k in range(len(allowed))))
    forms = {
        assign: _Form(ASSIGN, 0, own.rlike(ASSIGN), 2, 8),
        access: _Form(ACCESS, 1, own.contains("AKIA")),
        hexes: _Form(HEX, 2, own.rlike(HEX)),
        maybe: _Form(CANDIDATE, 3, own.rlike(CANDIDATE), mixed=True),
    }
    held = _with_matches(docs, own, forms).withColumn(names[0], F.sort_array(F.concat(assign, access, hexes)))
    some = F.size(maybe) > 0
    held = held.withColumns({lines: F.when(some, F.regexp_replace(own, NO_CANDIDATE, "\n")), blocks: F.when(some, _blocks(own))})
    patterns = {n: f"(?m:{p})" for n, p in zip(allow, allowed, strict=True)}
    held = _with_matches(held, F.col(lines), {n: _Form(p, -1, F.col(lines).rlike(p)) for n, p in patterns.items()})
    held = _parts(held, parts, F.when(some, F.sort_array(F.concat(names[0], maybe, *allow))))
    added = _random(F.col(parts), F.col(blocks), threshold or THRESHOLD)
    return held.withColumn(names[1], F.when(some, F.sort_array(F.concat(names[0], added))).otherwise(F.col(names[0]))).drop(*forms, lines, blocks, parts, *allow)


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans.

    Null and empty texts have no span. Repeated rows are scanned each; other columns are dropped.
    """
    found = with_spans(docs.select(id_column, F.col(text).alias("text")))
    of = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    n = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select(id_column, *n, F.sha2(_named(F.col("_base")), 256).alias("base_sha256"), _named(F.col("_all")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span by ``mark``; overlapping spans become one. Columns, rows and null texts stay."""
    base, spans, blocks, upto = unused(docs.columns, "_base", "_all", "_text", "_upto")
    found = with_spans(docs, text, names=(base, spans)).withColumn(blocks, F.when(F.size(spans) > 0, _blocks(F.col(text))))
    found = _before(found, {upto: F.transform(spans, lambda s: s["stop"])}, lambda a, x: F.greatest(a, x))
    of = F.col(blocks)

    def piece(z):
        return F.when(z["x"]["start"] >= z["at"], F.concat(_between(of, z["at"], z["x"]["start"]), F.lit(mark))).otherwise(F.lit(""))

    last = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["stop"]))
    pieces = F.transform(F.arrays_zip(F.col(spans).alias("x"), F.col(upto).alias("at")), piece)
    whole = F.concat(F.array_join(pieces, ""), _between(of, last, F.length(text)))
    return found.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).select(*docs.columns)
