import pytest
from pyspark.sql import types as S

from lakeferry.plans.catalog import column_type, parse_columns
from lakeferry.types.grammar import check_structure, parse_structure, parse_type, render_structure, render_type
from lakeferry.types.mapping import column_field, structure_of, wire_type


@pytest.mark.parametrize(
    "text",
    ["Int32", "Nullable(String)", "Array(Nullable(Decimal(12, 6)))", "DateTime64(6, 'UTC')", "Map(String, Array(Int64))", "Tuple(a String, b UInt8)", "Tuple(UInt8, UInt8)",
     "Nested(a Int32, b Nullable(String))", "Enum8('a' = 1, 'it\\'s' = 2)", "LowCardinality(Nullable(String))", "SimpleAggregateFunction(sum, Int64)", "FixedString(4)"],
)
def test_types_render_as_they_are_read(text):
    assert render_type(parse_type(text)) == text


def test_structure_names_and_line_breaks():
    found = parse_structure("ReqId UInt32,\n`odd name` String, `a\\`b\\\\` Nullable(Int8)")
    assert [n for n, _ in found] == ["ReqId", "odd name", "a`b\\"]
    assert parse_structure(render_structure(found)) == found


def test_structure_errors():
    with pytest.raises(ValueError, match="structure declares 2 columns, copy has 3"):
        check_structure("a Int8, b Int8", 3)
    with pytest.raises(ValueError, match="structure column 1 has no name"):
        check_structure("Int8, Int16", 2)


@pytest.mark.parametrize(
    "text, kind, logical",
    [("UInt64", S.DecimalType(20, 0), "numeric(20,0)"), ("Int128", S.StringType(), "numeric(39,0)"), ("DateTime64", S.TimestampType(), "timestamp(3) with time zone"), ("UInt8", S.ShortType(), "smallint"),
     ("Array(Array(Decimal(9, 4)))", S.ArrayType(S.ArrayType(S.DecimalType(9, 4))), "numeric(9,4)[][]"), ("LowCardinality(String)", S.StringType(), "text"), ("Ring", None, "polygon")],
)
def test_inferred_columns(text, kind, logical):
    f = column_field("c", parse_type(text))
    assert f.metadata["logical"] == logical and (kind is None or f.dataType == kind) and not f.nullable


def test_composites_become_text_arrays_with_a_notice():
    notices = []
    assert column_field("t", parse_type("Tuple(a String, b UInt8)"), notices).dataType == S.ArrayType(S.StringType())
    assert column_field("m", parse_type("Map(String, UInt8)"), notices).dataType == S.ArrayType(S.ArrayType(S.StringType()))
    assert column_field("a", parse_type("Array(Tuple(UInt8, UInt8))"), notices).metadata["logical"] == "text[][]"
    assert len(notices) == 3 and "converted to text[]" in notices[0]


def test_unsupported_types_are_named():
    with pytest.raises(ValueError, match=r'unsupported column type "Dynamic" \(column "d"\)'):
        column_field("d", parse_type("Dynamic"))
    assert wire_type(parse_type("Nullable(Tuple(a Int8))")).simpleString() == "struct<a:smallint>"


def test_structure_of_tables():
    schema = parse_columns("id integer NOT NULL, name text, at timestamp(3), tags text[], n numeric, u uuid, t time")
    got = render_structure(structure_of(schema))
    assert got == "id Int32, name Nullable(String), at Nullable(DateTime64(6, 'UTC')), tags Array(Nullable(String)), n Nullable(Decimal(38, 18)), u Nullable(UUID), t Nullable(Time64(6))"
    assert "UUID" not in render_structure(structure_of(schema, "ORC"))
    assert render_structure(structure_of(schema, "parquet")).endswith("u Nullable(UUID), t Nullable(String)")


def test_column_definitions():
    fields = parse_columns('id bigint NOT NULL, "odd ""name" char(3), g integer GENERATED ALWAYS AS (id * 2) STORED, d text DEFAULT upper(\'x\') NOT NULL, c int CHECK (c > 0)').fields
    assert [f.name for f in fields] == ["id", 'odd "name', "g", "d", "c"]
    assert fields[2].metadata["generated"] == "id * 2" and fields[3].metadata["default"] == "upper('x')" and fields[4].metadata["check"] == "c > 0"
    assert column_type("numeric(50,2)")[1] == S.StringType()
