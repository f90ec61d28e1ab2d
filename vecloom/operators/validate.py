"""Row checks of a declared schema, as columns and as reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.schema import DENSE, Field, Kind, Schema

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_RANGE = {Kind.INT8: 7, Kind.INT16: 15, Kind.INT32: 31, Kind.INT64: 63}


class InvalidRows(ValueError):
    """Rows or columns break the schema."""


def is_integer(c: Column | str) -> Column:
    """Text that is a whole number of 64 bits."""
    return F.col(c).try_cast("bigint").isNotNull() if isinstance(c, str) else c.try_cast("bigint").isNotNull()


def is_float(c: Column | str) -> Column:
    """Text that is a number; NaN and infinity count."""
    return F.col(c).try_cast("double").isNotNull() if isinstance(c, str) else c.try_cast("double").isNotNull()


def within_length(c: Column | str, most: int) -> Column:
    """At most so many characters."""
    return F.length(c) <= most


def has_dim(c: Column | str, dim: int) -> Column:
    """A list of exactly dim numbers without nulls; NaN counts as a number."""
    return (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull())


def within_capacity(c: Column | str, most: int) -> Column:
    return F.size(c) <= most


def elements_within_length(c: Column | str, most: int) -> Column:
    return F.forall(c, lambda x: x.isNotNull() & (F.length(x) <= most))


def is_json_object(c: Column | str) -> Column:
    """Text that is a JSON object; arrays, scalars and what can't be parsed are not, nor is an object with text behind it.

    The parser stops at the end of the first value. What follows an object can't continue both a list and an object.
    """
    c = F.col(c) if isinstance(c, str) else c
    within = F.schema_of_variant(F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}"))))
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.coalesce(within.startswith("OBJECT<x: OBJECT"), F.lit(False)) & listed.isNotNull()


def rules(field: Field, kind: T.DataType) -> list[tuple[str, Column]]:
    """(rule, holds) for a column of the given type, where it isn't null; TypeError if no value of that type can pass."""
    c, text = F.col(f"`{field.name}`"), isinstance(kind, T.StringType)
    listed = isinstance(kind, T.ArrayType)

    def fail():
        raise TypeError(f"{field.name}: a column of {kind.simpleString()} can't be {field.kind.value}")

    k = field.kind
    if k in _RANGE:
        if text:
            whole = is_integer(c)
        elif isinstance(kind, (T.BooleanType, *_INTEGRAL)):
            whole = F.lit(True)
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            whole = ~F.isnan(c.cast("double")) & (c == F.floor(c.cast("double")))
        else:
            fail()
        limit = 2 ** _RANGE[k]
        value = c.try_cast("decimal(38,0)")
        return [("integer", F.coalesce(whole, F.lit(False))), ("range", F.coalesce(value.between(F.lit(-limit).cast("decimal(38,0)"), F.lit(limit - 1).cast("decimal(38,0)")), F.lit(False)))]
    if k in (Kind.FLOAT, Kind.DOUBLE):
        if not isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)):
            fail()
        return [("float", is_float(c))]
    if k is Kind.BOOL:
        if not isinstance(kind, (T.BooleanType, T.StringType, *_INTEGRAL)):
            fail()
        return [("bool", c.cast("string").try_cast("boolean").isNotNull())]
    if k in (Kind.STRING, Kind.VARCHAR):
        if not text:
            fail()
        return [("max_length", within_length(c, field.max_length))] if k is Kind.VARCHAR else []
    if k is Kind.JSON:
        if isinstance(kind, (T.MapType, T.StructType)):
            return []
        if not text:
            fail()
        return [("json_object", is_json_object(c))]
    if k is Kind.FLOAT_VECTOR:
        if not listed or not isinstance(kind.elementType, T.NumericType):
            fail()
        return [("dim", has_dim(c, field.dim))]
    if k in DENSE:
        if not isinstance(kind, T.BinaryType):
            fail()
        return [("bytes", F.octet_length(c) == (field.dim // 8 if k is Kind.BINARY_VECTOR else 2 * field.dim))]
    if k is Kind.SPARSE_FLOAT_VECTOR:
        if isinstance(kind, T.MapType):
            return [("sparse", F.forall(F.map_entries(c), lambda e: e["value"].isNotNull() & (e["key"] >= 0)))]
        if isinstance(kind, T.StructType) and {"indices", "values"} <= set(kind.names):
            i, v = c["indices"], c["values"]
            return [("sparse", F.coalesce((F.size(i) == F.size(v)) & F.forall(i, lambda x: x.isNotNull() & (x >= 0)) & F.forall(v, lambda x: x.isNotNull()), F.lit(False)))]
        fail()
    if not listed or Field("x", field.element, max_length=field.max_length).spark_type() != kind.elementType:
        fail()
    out = [("element", F.forall(c, lambda x: x.isNotNull()))]
    if field.max_capacity is not None:
        out.append(("max_capacity", within_capacity(c, field.max_capacity)))
    if field.element is Kind.VARCHAR:
        out.append(("element_length", elements_within_length(c, field.max_length)))
    return out


def _columns(df: DataFrame, schema: Schema) -> list[tuple[str, str, Column]]:
    """(field, rule, broken) for each rule of each field; a missing column or a wrong type raises."""
    out = []
    for f in schema.fields:
        if f.auto_id:
            continue
        if f.name not in df.columns:
            raise InvalidRows(f"column {f.name} is missing")
        try:
            own = rules(f, df.schema[f.name].dataType)
        except TypeError as e:
            raise InvalidRows(str(e)) from None
        null = F.col(f"`{f.name}`").isNull()
        out.append((f.name, "required", null))
        out += [(f.name, rule, ~null & ~F.coalesce(ok, F.lit(False))) for rule, ok in own]
    return out


def violations(df: DataFrame, schema: Schema) -> DataFrame:
    """(pk, field, rule) for each rule that a row breaks; pk is text, null without a primary key.

    Extra columns pass, and so do absent columns of automatic ids.
    """
    broken = _columns(df, schema)
    pk = F.col(f"`{schema.primary.name}`").cast("string") if schema.primary and schema.primary.name in df.columns else F.lit(None).cast("string")
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"))) for name, rule, bad in broken)))
    return df.select(pk.alias("pk"), F.explode(found).alias("_v")).select("pk", "_v.field", "_v.rule")


def counts(df: DataFrame, schema: Schema) -> DataFrame:
    """(field, rule, broken): how many rows break each rule, in one pass."""
    broken = _columns(df, schema)
    one = df.agg(*(F.coalesce(F.sum(bad.cast("bigint")), F.lit(0)).alias(f"c{k}") for k, (_, _, bad) in enumerate(broken)))
    rows = F.array(*(F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"), F.col(f"c{k}").alias("broken")) for k, (name, rule, _) in enumerate(broken)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def check(df: DataFrame, schema: Schema) -> None:
    """Raises InvalidRows, which says how often each rule is broken."""
    bad = counts(df, schema).where("broken > 0").collect()
    if bad:
        raise InvalidRows("; ".join(f"{r.field}: {r.rule} broken by {r.broken} rows" for r in bad))


def conform(df: DataFrame, schema: Schema) -> DataFrame:
    """df with the declared columns cast to the declared types, the others behind them."""
    own = [f for f in schema.fields if f.name in df.columns]
    names = {f.name for f in own}
    return df.select(*(F.col(f"`{f.name}`").cast(f.spark_type()).alias(f.name) if not isinstance(df.schema[f.name].dataType, (T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in own), *(F.col(f"`{c}`") for c in df.columns if c not in names))
