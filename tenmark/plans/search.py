"""The query language of a search body, compiled to a plan over a base relation that is already isolated.

Tenancy is a property of the base: the planner filters to the partition's placement and fields first and only
then applies what the client asked. Client predicates are built-in expressions alone, so nothing of theirs
can observe a row that the filter has not let through. What cannot be isolated is rejected before a plan
exists.

Values are made literals of their field's type before a plan exists, and a conjunct may be null, which matches
nothing as false does. So tenant and client predicates on stored columns reach the scan as pushed filters.
"""

from __future__ import annotations

import datetime
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenmark.functions import scalars as S

DEFAULT_SIZE = 10


class Rejected(ValueError):
    """A body that cannot be evaluated in isolation, or that uses what is not supported."""


def check(body: dict[str, Any], filtered: bool) -> None:
    """Filter or reject: suggestions, and ``global`` aggregations at any depth, ignore a query's filter."""
    if not isinstance(body, dict):
        raise Rejected("the body is no object")
    if filtered and "suggest" in body:
        raise Rejected("suggest cannot be filtered")
    if filtered and any(has_global(body[k]) for k in ("aggs", "aggregations") if k in body):
        raise Rejected("a global aggregation leaves the filter")


def has_global(aggs: Any) -> bool:
    if not isinstance(aggs, dict):
        return False
    for one in aggs.values():
        if isinstance(one, dict) and ("global" in one or any(has_global(one.get(k)) for k in ("aggs", "aggregations"))):
            return True
    return False


def _single(node: dict) -> tuple[str, Any]:
    if not isinstance(node, dict) or len(node) != 1:
        raise Rejected("a query has exactly one kind")
    return next(iter(node.items()))


def _list(x: Any) -> list:
    return x if isinstance(x, list) else [x]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def typed(value: Any, kind: T.DataType) -> Column | None:
    """A literal of a field's type; None if no value of that type can equal it, ``Rejected`` if it is ill-typed."""
    if value is None or isinstance(value, (dict, list)):
        raise Rejected("a value is a text, a number or a boolean")
    bad = Rejected(f"{value!r} is no {kind.simpleString()}")
    if isinstance(kind, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value))
    if isinstance(kind, T.BooleanType):
        if value in (True, "true") or value in (False, "false"):
            return F.lit(value in (True, "true"))
        raise bad
    if isinstance(value, bool):
        raise bad
    try:
        if isinstance(kind, T.IntegralType):
            number = Decimal(str(value))
            if not number.is_finite():
                raise bad
            bits = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[kind.simpleString()]
            if number != int(number) or not -(1 << bits) <= number < 1 << bits:
                return None
            return F.lit(int(number)).cast(kind)
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            return F.lit(float(value)).cast(kind)
        if isinstance(kind, T.DecimalType):
            number = Decimal(str(value))
            if not number.is_finite():
                raise bad
            return F.lit(number)
        if isinstance(kind, T.DateType):
            return F.lit(datetime.date.fromisoformat(value))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.lit(datetime.datetime.fromisoformat(value)).cast(kind)
    except (ValueError, TypeError, InvalidOperation) as e:
        raise bad from e
    raise Rejected(f"a {kind.simpleString()} cannot be compared")


def _bounds(own: Column, kind: T.DataType, value: dict) -> list[Column]:
    unknown = set(value) - {"gt", "gte", "lt", "lte"}
    if unknown:
        raise Rejected(f"unknown range bound {sorted(unknown)}")
    out = []
    for k, v in value.items():
        if isinstance(kind, T.IntegralType) and not isinstance(v, bool) and typed(v, kind) is None:
            own, bound = own.cast("decimal(38,10)"), F.lit(Decimal(str(v)))  # a fraction, or beyond the type
        else:
            bound = typed(v, kind)
        out.append({"gt": own.__gt__, "gte": own.__ge__, "lt": own.__lt__, "lte": own.__le__}[k](bound))
    return out


def predicate(query: dict | None, schema: T.StructType) -> Column:
    """A query as a boolean column; absent is everything. A row matches where it is true; null fields give null or false."""
    if not query:
        return F.lit(True)

    def field(name: str) -> tuple[Column, T.DataType]:
        name = name.removesuffix(".keyword")
        return (F.col(name), schema[name].dataType) if name in schema.names else (F.lit(None).cast("string"), T.StringType())

    kind, arg = _single(query)
    if kind == "match_all":
        return F.lit(True)
    if not isinstance(arg, dict):
        raise Rejected(f"{kind} has no body")
    if kind == "bool":
        unknown = set(arg) - {"must", "filter", "should", "must_not", "minimum_should_match"}
        if unknown:
            raise Rejected(f"unknown bool clause {sorted(unknown)}")
        sure = lambda q: F.coalesce(predicate(q, schema), F.lit(False))
        every = [predicate(q, schema) for k in ("must", "filter") for q in _list(arg.get(k, []))]
        should = _list(arg.get("should", []))
        least = int(arg.get("minimum_should_match", 0 if every else 1)) if should else 0
        if least == 1:
            every.append(reduce(lambda a, b: a | b, (predicate(q, schema) for q in should)))
        elif least > 1:
            every.append(reduce(lambda a, b: a + b, (sure(q).cast("int") for q in should)) >= least)
        elif least == 0:
            for q in should:
                predicate(q, schema)  # has no effect, but must be one
        every += [~sure(q) for q in _list(arg.get("must_not", []))]
        return reduce(lambda a, b: a & b, every) if every else F.lit(True)
    if kind == "ids":
        return F.col("_id").isin(list(map(str, arg["values"])))
    if kind == "exists":
        return field(arg["field"])[0].isNotNull()
    name, value = _single(arg)
    own, of = field(name)
    if kind in ("term", "prefix") and isinstance(value, dict):
        value = value.get("value")
    if kind == "term":
        one = typed(value, of)
        return F.lit(False) if one is None else own == one
    if kind == "terms":
        some = [x for x in (typed(v, of) for v in _list(value)) if x is not None]
        return own.isin(*some) if some else F.lit(False)
    if kind == "prefix":
        if not isinstance(value, str):
            raise Rejected("a prefix is a text")
        return own.cast("string").startswith(value)
    if kind == "range":
        if not isinstance(value, dict):
            raise Rejected("a range has bounds")
        return reduce(lambda a, b: a & b, _bounds(own, of, value), own.isNotNull())
    if kind == "match":
        text, every = (value.get("query"), str(value.get("operator", "or")).lower() == "and") if isinstance(value, dict) else (value, False)
        wanted = sorted({w for w in "".join(c if c.isalnum() else " " for c in str(text).lower()).split()})
        if not wanted:
            return F.lit(False)
        has = F.array(*map(F.lit, wanted))
        return F.size(F.array_intersect(words(own.cast("string")), has)) == len(wanted) if every else F.arrays_overlap(words(own.cast("string")), has)
    raise Rejected(f"unsupported query {kind}")


def sort_terms(sort: Any, columns: list[str]) -> list[tuple[str, bool]]:
    """``(field, descending)`` of each term of a sort."""
    out = []
    for one in _list(sort or []):
        name, how = (one, "asc") if isinstance(one, str) else _single(one)
        how = how.get("order", "asc") if isinstance(how, dict) else how
        if name == "_score":
            raise Rejected("there are no scores to sort by")
        if name not in columns:
            raise Rejected("a sort names no field")
        out.append((name, how == "desc"))
    return out


def ordering(sort: Any, columns: list[str]) -> list[Column]:
    return [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last() for name, down in sort_terms(sort, columns)]


def isolation(schema: T.StructType, fields: dict[str, Any]) -> Column:
    """What the partition-valued fields own. A shared placement without such a field is refused.

    The partition, a text, is compared as a value of the field's stored type; one that is none owns nothing.
    """
    if not fields:
        raise Rejected("a shared placement needs a field that holds the partition")
    out = []
    for k, v in fields.items():
        try:
            one = typed(v, schema[k].dataType) if str(v).strip() == str(v) else None
        except Rejected:
            one = None
        out.append(F.lit(False) if one is None else F.col(k) == one)
    return reduce(lambda a, b: a & b, out)


def isolated(base: DataFrame, fields: dict[str, Any]) -> DataFrame:
    return base.filter(isolation(base.schema, fields))


def matched(base: DataFrame, body: dict, fields: dict[str, Any] | None) -> DataFrame:
    """Rows that a body matches; ``fields`` None means a dedicated placement, which needs no filter."""
    check(body, fields is not None)
    own = base if fields is None else isolated(base, fields)
    return own.filter(predicate(body.get("query"), own.schema))


def search(base: DataFrame, body: dict, fields: dict[str, Any] | None, tie: str = "_id") -> DataFrame:
    """Hits in order, ``from`` and ``size`` applied, ``_source`` columns picked. ``tie`` makes the order total."""
    hits = matched(base, body, fields)
    hits = hits.orderBy(*ordering(body.get("sort"), hits.columns), F.col(tie)).offset(int(body.get("from", 0))).limit(int(body.get("size", DEFAULT_SIZE)))
    picked = body.get("_source", True)
    if picked is False:
        return hits.select(*[c for c in hits.columns if c.startswith("_") and c != "_source"])
    return hits if picked is True else hits.select(*[c for c in hits.columns if c.startswith("_")], *[c for c in _list(picked) if c in hits.columns])


def count(base: DataFrame, body: dict, fields: dict[str, Any] | None) -> DataFrame:
    return matched(base, body, fields).agg(F.count("*").alias("count"))


def response(base: DataFrame, body: dict, fields: dict[str, Any] | None, tie: str = "_id") -> DataFrame:
    """One row: the exact ``total`` of what matches and, in order, the ``hits`` of the page as JSON objects.

    The page is at most ``size`` rows, so they fit a row; the total is a count of its own over the same scan.
    """
    page = search(base, body, fields, tie).select(F.to_json(F.struct("*")).alias("hit"), F.monotonically_increasing_id().alias("at"), F.lit(0).cast("long").alias("total"))
    total = matched(base, body, fields).agg(F.count("*").alias("total")).select(F.lit(None).cast("string").alias("hit"), F.lit(None).cast("long").alias("at"), "total")
    held = F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "hit"))))
    return page.unionAll(total).agg(F.sum("total").alias("total"), F.transform(held, lambda x: x["hit"]).alias("hits"))


_METRICS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "value_count": F.count}


def aggregate(base: DataFrame, body: dict, fields: dict[str, Any] | None, name: str) -> DataFrame:
    """One ``terms`` aggregation, possibly nested, with metrics or ``top_hits`` below: a row per bucket.

    Buckets are ``key`` (``key2`` ... when nested) and ``doc_count``; the outermost are cut to ``size``, most
    first, ties by key. ``top_hits`` gives the ids of each bucket as ``top``, an array.
    """
    rows = matched(base, body, fields)
    aggs, keys, outer = body.get("aggs", body.get("aggregations", {})), [], None
    spec, metrics, top = aggs[name], [], None
    while True:
        kind = next(k for k in spec if k not in ("aggs", "aggregations"))
        if kind != "terms":
            raise Rejected(f"unsupported aggregation {kind}")
        keys.append(spec["terms"]["field"].removesuffix(".keyword"))
        outer = outer or int(spec["terms"].get("size", 10))
        below, spec = spec.get("aggs", spec.get("aggregations", {})), None
        for label, one in below.items():
            kind = next(k for k in one if k not in ("aggs", "aggregations"))
            if kind in _METRICS:
                metrics.append(_METRICS[kind](one[kind]["field"]).alias(label))
            elif kind == "top_hits":
                order = one[kind].get("sort", "_id")
                top = (int(one[kind].get("size", 3)), order)
            else:
                spec = one
        if spec is None:
            break
    rows = rows.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    names = ["key", *(f"key{k}" for k in range(2, len(keys) + 1))]
    out = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.count("*").alias("doc_count"), *metrics)
    if top:
        # ranks are cut before rows are dealt, so a bucket of any size sends a few rows a task
        order = Window.partitionBy(*names).orderBy(*ordering(top[1], rows.columns), "_id")
        best = rows.withColumns({n: F.col(k) for k, n in zip(keys, names, strict=True)}).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top[0])
        hits = best.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_id"))), lambda x: x["_id"]).alias("top"))
        out = out.join(hits, names)
    if len(keys) == 1:
        return out.orderBy(F.desc("doc_count"), "key").limit(outer)
    best = rows.groupBy(F.col(keys[0]).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(outer)
    return out.join(best.select("key"), "key", "left_semi")


def get_by_ids(base: DataFrame, wanted: DataFrame, fields: dict[str, Any] | None) -> DataFrame:
    """Positional multi-get: ``wanted (pos, _id)`` in order, repeats repeated, missing ones with ``found`` false."""
    own = base if fields is None else isolated(base, fields)
    found = own.withColumnRenamed("_id", "_fid").withColumn("found", F.lit(True))
    both = wanted.join(found, F.col("_id") == F.col("_fid"), "left").drop("_fid")
    return both.withColumn("found", F.coalesce("found", F.lit(False)))


def point_read(base: DataFrame, logical: str, fields: dict[str, Any] | None, template: str, partition: str, key: str) -> DataFrame:
    """The document of a client's id, if the partition has it.

    ``key`` is the stored column that the template's document value comes from. The id is compared as its type, so the
    scan is pruned to where it can be; the physical id then decides.
    """
    own = base if fields is None else isolated(base, fields)
    try:
        one = typed(logical, base.schema[key].dataType)
    except Rejected:
        one = None
    physical = S.to_physical(template, F.lit(partition), F.lit(logical))
    return own.filter(F.lit(False) if one is None else F.col(key) == one).filter(F.col("_id") == physical)


def multi_search(base: DataFrame, items: list[tuple[dict, dict[str, Any] | None]], columns: list[str], tie: str = "_id") -> DataFrame:
    """Several searches of one relation in one scan: hits with their item's ``ordinal``; a rejected item gives one row with its ``error``.

    A row meets every item once, under the item's own isolation and query. Items rank their rows by their own terms, and
    ranks are cut before rows are dealt.
    """
    wanted, errors = [], []
    for k, (body, fields) in enumerate(items):
        try:
            check(body, fields is not None)
            own = predicate(body.get("query"), base.schema)
            own = own if fields is None else isolation(base.schema, fields) & own
            first = int(body.get("from", 0))
            wanted.append((k, own, sort_terms(body.get("sort"), base.columns), first, first + int(body.get("size", DEFAULT_SIZE))))
        except Rejected as e:
            errors.append((k, str(e)))
    spark, none = base.sparkSession, F.lit(None)
    kinds = {c: base.schema[c].dataType for c in columns}
    out = spark.createDataFrame(errors, "ordinal int, error string").select(*(none.cast(t).alias(c) for c, t in kinds.items()), "error", "ordinal")
    if not wanted:
        return out
    found = base.filter(reduce(lambda a, b: a | b, (own for _, own, *_ in wanted)))
    found = found.withColumn("ordinal", F.explode(F.array_compact(F.array(*(F.when(own, F.lit(k)) for k, own, *_ in wanted)))))
    terms = []
    for k, _, sort, *_ in wanted:
        for name, down in sort:
            term = F.when(F.col("ordinal") == k, F.col(name))  # null, and so without effect, for other items
            terms.append(term.desc_nulls_last() if down else term.asc_nulls_last())
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy("ordinal").orderBy(*terms, F.col(tie))))
    ranked = ranked.filter(F.col("_rank") <= max(stop for *_, stop in wanted))
    page = reduce(lambda a, b: a | b, ((F.col("ordinal") == k) & (F.col("_rank") > first) & (F.col("_rank") <= stop) for k, _, _, first, stop in wanted))
    return ranked.filter(page).select(*columns, none.cast("string").alias("error"), "ordinal").unionAll(out)
