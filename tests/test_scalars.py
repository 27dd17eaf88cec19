"""Golden rows of the scalar functions and transforms."""

import pytest
from pyspark.sql import functions as F

from tablesync.functions import identity, render, text
from tablesync.functions import transforms as tr
from tablesync.operators import catalog
from tablesync.operators.events import entity_type, operation
from tablesync.profiles import A2B, B2A


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def apply(spark, inputs, conf, way, kind="string"):
    ctx = tr.Context(conf, way, {}, {"x": kind}, "x")
    return values(spark, inputs, lambda c: tr.apply_transform(c, ctx), kind)


def test_phone(spark):
    inputs = [
        "+44 2000 000 001", "call: 0044-2000000002", "442000000003", "2000000004",
        "(20) 0000-0005", "+2000000006", "2000", "", None, "٣٣٣٣٣٣٣٣٣٣",
    ]
    assert values(spark, inputs, identity.normalize_phone) == [
        "2000000001", "2000000002", "2000000003", "2000000004",
        "2000000005", "2000000006", None, None, None, "٣٣٣٣٣٣٣٣٣٣",
    ]


def test_operation_words(spark):
    inputs = ["after_insert", "after_update", "after_delete", "INSERT", "UPDATE", "DELETE", "x", None]
    assert values(spark, inputs, operation) == [
        "create", "update", "delete", "create", "update", "delete", "update", "update",
    ]


def test_entity_by_prefix(spark):
    inputs = ["TASK-1", "HR-EMP-2", "PROJ-3", "x", ""]
    got = values(spark, inputs, lambda c: entity_type(F.lit(None).cast("string"), c))
    assert got == ["Task", "Employee", "Project", "Employee", "Employee"]


def test_generic_boolean(spark):
    conf = {"type": "boolean"}
    words = ["Active", "Inactive", "1", "0", "later", "", None]
    assert apply(spark, words, conf, A2B) == [True, False, True, False, True, False, False]
    assert apply(spark, [1, 0, None], conf, A2B, "int") == [True, False, False]
    assert apply(spark, [True, False, None], conf, B2A, "boolean") == [1, 0, 0]
    milestone = {"type": "is_milestone_to_needs_submission"}
    assert apply(spark, [1, 0, None], milestone, A2B, "int") == [True, False, False]


def test_status(spark):
    conf = {"type": "status_mapping", "active_status": "Active", "inactive_status": "Inactive"}
    assert apply(spark, ["Active", "Left", None], conf, A2B) == [True, False, False]
    assert apply(spark, [True, False, None], conf, B2A, "boolean") == ["Active", "Inactive", "Inactive"]


def test_project_and_task_codes(spark):
    conf = {"type": "string_to_int"}
    assert apply(spark, ["PROJ-0001", "PROJ-x", "", "ABC"], conf, A2B) == ["1", None, None, "ABC"]
    assert apply(spark, [7, 12345, 0], conf, B2A, "bigint") == ["PROJ-0007", "PROJ-12345", None]
    assert values(spark, ["PROJ-001", "PROJ-x"], tr.decode_project_id) == ["1", "PROJ-x"]
    assert values(spark, ["7", "x"], tr.encode_project_id) == ["PROJ-007", "x"]
    assert values(spark, ["TASK-2025-0001", "TASK-1", "x"], tr.decode_task_id) == ["1", "TASK-1", "x"]
    assert values(spark, ["1"], lambda c: tr.encode_task_id(c, 2025)) == ["TASK-2025-0001"]


def test_codes_round_trip(spark):
    numbers = list(range(1, 12000, 377))
    encoded = values(spark, numbers, lambda c: tr.encode_task_id(c, 2025), "bigint")
    assert values(spark, encoded, tr.decode_task_id) == [str(n) for n in numbers]


def test_prefix_is_no_round_trip(spark):
    conf = {"type": "prefix_transform", "prefix": "TASK", "year": 2025}
    assert apply(spark, ["TASK-2025-0001", "TASK-x", "y"], conf, A2B) == ["20250001", "TASK-x", "y"]
    assert apply(spark, ["12", "x"], conf, B2A) == ["TASK-2025-0012", "x"]


def test_names(spark):
    first = values(spark, ["John Doe", "A B C", "john.doe", ""], lambda c: tr.split_name(c)[0])
    last = values(spark, ["John Doe", "A B C", "john.doe", ""], lambda c: tr.split_name(c)[1])
    assert list(zip(first, last)) == [("John", "Doe"), ("A", "B C"), ("john.doe", ""), ("", "")]
    assert values(spark, ["Doe", None], lambda c: tr.combine_name(F.lit(" Jo"), c)) == ["Jo Doe", "Jo"]


def test_iso_to_date(spark):
    conf = {"type": "date_format_conversion", "input_format": "iso_datetime", "output_format": "date_string"}
    assert apply(spark, ["2025-01-27T00:00:00Z", "2025-01-27"], conf, B2A) == ["2025-01-27"] * 2


def test_timestamps(spark):
    inputs = ["2025-01-27 10:00:00", "2025-01-27T10:00:00Z", "2025-01-27T10:00", "2025-01-27", "soon", "",
              "2025-02-30 10:00:00", "2025-01-27T10:00:00.5+05:30", "2025-01-27 10:00:00.000000", None]
    assert values(spark, inputs, lambda c: render.render_timestamp(c, True)) == [
        "2025-01-27T10:00:00", "2025-01-27T10:00:00+00:00", "2025-01-27T10:00:00", "2025-01-27T00:00:00",
        "soon", "", "2025-02-30 10:00:00", "2025-01-27T10:00:00.500000+05:30", "2025-01-27T10:00:00", None,
    ]
    assert values(spark, inputs, lambda c: render.render_timestamp(c, False)) == [
        "2025-01-27 10:00:00", "2025-01-27 10:00:00", "2025-01-27 10:00:00", "2025-01-27 00:00:00",
        "soon", "", "2025-02-30 10:00:00", "2025-01-27 10:00:00", "2025-01-27 10:00:00", None,
    ]


def test_snippet(spark):
    inputs = ["Priority\n1", "   x ", "é" * 60, None, "\n" * 80]
    assert values(spark, inputs, text.snippet) == ["Priority 1", "x", "é" * 50, "", ""]


def test_title_case_is_pythons(spark):
    inputs = ["field2name", "first_name", "a-b c", "ÜBER maß", "2nd", "o'neil"]
    assert values(spark, inputs, text.field_label) == [i.replace("_", " ").title() for i in inputs]


def test_snake_case():
    assert render.snake_case("employeeName") == "employee_name"
    with pytest.raises(ValueError):
        render.snake_case_all(["fooBar", "foo_bar"])


def test_arrays(spark):
    conf = {"type": "array_to_uuid_array"}
    assert apply(spark, ["['a', \"b\"]", "[]", "no"], conf, A2B) == [["a", "b"], [], None]


def test_type_score(spark):
    pairs = [("Data", "varchar", 1.0), ("Datetime", "timestamp without time zone", 0.8),
             ("Int", "text", 0.0), (None, "text", 0.0), ("Data", None, 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r.s for r in df.select(catalog.type_score(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [s for _, _, s in pairs]


def test_own_transform_types_can_be_added(spark):
    tr.register_transform("shout", lambda value, ctx: F.upper(value))
    assert apply(spark, ["a"], {"type": "shout"}, A2B) == ["A"]
    assert apply(spark, ["a"], {"type": "no such type"}, A2B) == ["a"]


def test_email_priority(spark):
    row = {"preferred": F.lit(""), "personal": F.lit("p@x"), "company": F.lit("c@x")}
    conf = {"type": "email_priority", "email_priority": ["preferred", "personal", "company"]}
    ctx = tr.Context(conf, A2B, row, {}, "email")
    assert values(spark, ["?"], lambda c: tr.apply_transform(c, ctx)) == ["p@x"]
