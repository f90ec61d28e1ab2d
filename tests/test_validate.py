import pytest

from vecloom.operators import validate
from vecloom.operators.validate import InvalidRows
from vecloom.schema import Field, Kind, Schema


def broken(spark, field, kind, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"pk bigint, x {kind}")
    schema = Schema((Field("pk", Kind.INT64, is_primary=True), field))
    return {(int(r.pk), r.rule) for r in validate.violations(df, schema).collect()}


def test_scalars(spark):
    assert broken(spark, Field("x", Kind.INT8), "bigint", [127, 128, -129, None]) == {(1, "range"), (2, "range"), (3, "required")}
    assert broken(spark, Field("x", Kind.INT64), "string", ["1", "1.5", "a"]) == {(1, "integer"), (2, "integer"), (1, "range"), (2, "range")} - {(1, "range")}
    assert broken(spark, Field("x", Kind.INT32), "double", [1.0, 1.5, float("nan")]) == {(1, "integer"), (2, "integer"), (2, "range")}
    assert broken(spark, Field("x", Kind.FLOAT), "double", [1.0, float("nan"), float("inf")]) == set()
    assert broken(spark, Field("x", Kind.DOUBLE), "string", ["1.5", "x"]) == {(1, "float")}
    assert broken(spark, Field("x", Kind.BOOL), "string", ["yes", "perhaps"]) == {(1, "bool")}
    assert broken(spark, Field("x", Kind.VARCHAR, max_length=3), "string", ["日本語", "abcd", "", None]) == {(1, "max_length"), (3, "required")}


def test_vectors_and_arrays(spark):
    v = Field("x", Kind.FLOAT_VECTOR, dim=2)
    assert broken(spark, v, "array<float>", [[1.0, 2.0], [1.0], [1.0, None], None, [1.0, float("nan")]]) == {(1, "dim"), (2, "dim"), (3, "required")}
    a = Field("x", Kind.ARRAY, element=Kind.VARCHAR, max_length=2, max_capacity=2)
    assert broken(spark, a, "array<string>", [["a", "bb"], ["a", "b", "c"], ["abc"], [None], []]) == {(1, "max_capacity"), (2, "element_length"), (3, "element"), (3, "element_length")}
    assert broken(spark, Field("x", Kind.BINARY_VECTOR, dim=16), "binary", [b"ab", b"a"]) == {(1, "bytes")}
    assert broken(spark, Field("x", Kind.FLOAT16_VECTOR, dim=1), "binary", [b"ab", b"a"]) == {(1, "bytes")}


def test_sparse_and_json(spark):
    s = Field("x", Kind.SPARSE_FLOAT_VECTOR)
    assert broken(spark, s, "map<int,float>", [{1: 0.5}, {}, {1: None}]) == {(2, "sparse")}
    pair = Field("x", Kind.SPARSE_FLOAT_VECTOR, sparse_pair=True)
    assert broken(spark, pair, "struct<indices:array<int>,values:array<float>>", [([1], [0.5]), ([1, 2], [0.5]), ([], []), (None, [1.0])]) == {(1, "sparse"), (3, "sparse")}
    texts = ['{"a":1}', "[1]", "1", "{", '{"a":1}}', '{"a":1},{"b":2}', '{"a":1}], [2', ' {"a":1} ', "{}"]
    assert broken(spark, Field("x", Kind.JSON), "string", texts) == {(k, "json_object") for k in range(1, 7)}


def test_columns(spark):
    schema = Schema((Field("id", Kind.INT64, is_primary=True), Field("t", Kind.VARCHAR, max_length=2)))
    validate.check(spark.createDataFrame([(1, "a", 5)], "id bigint, t string, more int"), schema)
    with pytest.raises(InvalidRows, match="t is missing"):
        validate.check(spark.createDataFrame([(1,)], "id bigint"), schema)
    with pytest.raises(InvalidRows, match="can't be varchar"):
        validate.check(spark.createDataFrame([(1, 2)], "id bigint, t int"), schema)
    with pytest.raises(InvalidRows, match="t: max_length broken by 2 rows"):
        validate.check(spark.createDataFrame([(1, "aaa"), (2, "bbb")], "id bigint, t string"), schema)
    validate.check(spark.createDataFrame([], "id bigint, t string"), schema)
    auto = Schema((Field("id", Kind.INT64, is_primary=True, auto_id=True), Field("t", Kind.STRING)))
    assert validate.violations(spark.createDataFrame([(None,)], "t string"), auto).collect()[0][:] == (None, "t", "required")


def test_schema_round_trip():
    schema = Schema(
        (
            Field("id", Kind.INT64, is_primary=True, auto_id=True),
            Field("v", Kind.FLOAT_VECTOR, dim=3),
            Field("a", Kind.ARRAY, element=Kind.VARCHAR, max_length=9, max_capacity=4),
            Field("s", Kind.SPARSE_FLOAT_VECTOR, sparse_pair=True),
            Field("j", Kind.JSON),
        ),
        "what it holds",
    )
    back = Schema.from_json(schema.json())
    assert back == schema and back.description == "what it holds" and back.primary.name == "id"
    for bad in (dict(kind="float_vector"), dict(kind="varchar"), dict(kind="binary_vector", dim=9), dict(kind="array")):
        with pytest.raises(ValueError):
            Field("x", **bad)
    with pytest.raises(ValueError):
        Schema((Field("x", "int8"), Field("x", "int8")))
