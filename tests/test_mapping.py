"""Record mapping: golden records, absent and null, flags, specs."""

import json

import pytest
from pyspark.sql import functions as F

from tablesync import presets
from tablesync.operators import mapping as m
from tablesync.operators.events import typed_record
from tablesync.profiles import A2B, B2A, MappingSpec, find_mapping, sides

A_TASK = {
    "name": "TASK-2024-0417", "subject": "Paint the north fence", "status": "Open", "project": "PROJ-0001",
    "type": "Upkeep", "description": "Two coats, green", "owner": "x@y",
    "act_start_date": "2024-03-11", "act_end_date": "2024-03-19", "progress": 40, "is_milestone": False,
    "_assign": ["a"], "creation": "2024-03-11 10:00:00", "modified": "2024-03-11 10:00:00",
}
A_TASK_SCHEMA = (
    "name string, subject string, status string, project string, type string, description string, owner string, "
    "act_start_date string, act_end_date string, exp_start_date string, progress int, is_milestone boolean, "
    "_assign array<string>, creation string, modified string, organization_id string"
)
PERSON_SCHEMA = (
    "name string, first_name string, last_name string, cell_number string, personal_email string, "
    "prefered_email string, company string, status string"
)


def mapped(spark, record, schema, spec, way, **options):
    df = spark.createDataFrame([(json.dumps(record),)], "data string")
    out = m.map_records(typed_record(df, schema, []), spec, way, **options).collect()[0].asDict()
    present = out.pop(m.PRESENT)
    out.pop(m.ERRORS)
    return {k: v for k, v in out.items() if k in present}


def test_task_to_b(spark):
    assert mapped(spark, A_TASK, A_TASK_SCHEMA, presets.TASK, A2B) == {
        "task_name": "Paint the north fence", "status": "Open", "start_date": "2024-03-11",
        "end_date": "2024-03-19", "needs_submission": False, "created_at": "2024-03-11T10:00:00",
        "updated_at": "2024-03-11T10:00:00", "page_content": "Two coats, green",
        "organization_id": presets.ORGANIZATION_ID,
    }


def test_start_date_falls_back(spark):
    record = {**A_TASK, "act_start_date": None, "exp_start_date": "2025-02-01"}
    assert mapped(spark, record, A_TASK_SCHEMA, presets.TASK, A2B)["start_date"] == "2025-02-01"


def test_absent_fields_stay_absent_and_null_ones_are_written(spark):
    got = mapped(spark, {"subject": "S", "description": None}, A_TASK_SCHEMA, presets.TASK, A2B)
    assert got == {"task_name": "S", "page_content": None, "organization_id": presets.ORGANIZATION_ID}


def test_person_to_b(spark):
    record = {
        "name": "HR-EMP-00001", "first_name": "Ines", "last_name": "Kovar", "cell_number": "+4420000000",
        "personal_email": "ines@home.example", "company": "Fence Works", "status": "Active",
    }
    assert mapped(spark, record, PERSON_SCHEMA, presets.PERSON, A2B) == {
        "name": "Ines Kovar", "email": "ines@home.example", "phone_number": "+4420000000",
        "_legacy_is_active": True, "organization_id": "Fence Works",
    }


def test_person_to_a(spark):
    record = {"id": "u", "first_name": "Ines", "last_name": "Kovar", "name": "ines.k",
              "phone_number": "+4420000000", "email": "ines@work.example"}
    schema = "id string, first_name string, last_name string, name string, phone_number string, email string"
    assert mapped(spark, record, schema, presets.PERSON, B2A) == {
        "first_name": "ines.k", "last_name": "", "personal_email": "ines@work.example",
        "cell_number": "+4420000000", "gender": "Male", "date_of_birth": "1990-01-01",
        "date_of_joining": "2025-01-01",
    }


def test_raw_column_of_the_target_name_wins_only_in_compat_mode(spark):
    record = {"name": "PROJ-0001", "project_name": "Apollo"}
    schema = "name string, project_name string"
    assert mapped(spark, record, schema, presets.PROJECT, A2B)["name"] == "Apollo"
    compat = mapped(spark, record, schema, presets.PROJECT, A2B, compat_precedence=True)
    assert compat["name"] == "PROJ-0001"


def test_surrogate_keys_are_stable_and_distinct(spark):
    df = spark.range(1000).select(m.surrogate_key("Task", F.col("id")).alias("k"))
    assert df.distinct().count() == 1000
    assert df.exceptAll(df.repartition(3)).count() == 0
    assert len(df.first().k) == 36


def test_internal_fields_are_stripped(spark):
    df = spark.createDataFrame([("x", "y", ["a", "_assign"])], "a string, _assign string, _present array<string>")
    out = m.strip_internal(df, "a")
    assert out.columns == ["a", m.PRESENT] and out.first()[m.PRESENT] == ["a"]


def test_company_table_maps_both_ways(spark):
    spec = presets.with_companies(presets.PERSON, {"Acme": "u-1"})
    assert mapped(spark, {"company": "Acme"}, "company string", spec, A2B)["organization_id"] == "u-1"
    got = mapped(spark, {"organization_id": "u-1", "name": "A"}, "organization_id string, name string", spec, B2A)
    assert got["company"] == "Acme"


def test_spec_from_configuration():
    conf = {
        "erp_doctype": "Task", "store_table": "tasks", "field_mappings": {"a": "b"},
        "reverse_mappings": {"b": "a"}, "sync_fields": ["a"], "conflict_resolution": "erp_wins",
        "direction": "erp_to_store",
    }
    spec = MappingSpec.from_dict("t", conf)
    assert (spec.a_type, spec.b_table, spec.strategy, spec.direction) == ("Task", "tasks", "a_wins", "a2b")
    assert spec.allows("a2b") and not spec.allows("b2a")
    with pytest.raises(ValueError):
        MappingSpec.from_dict("t", {**conf, "conflict_resolution": "coin"})
    with pytest.raises(ValueError):
        MappingSpec.from_dict("t", {"erp_doctype": "Task"})


def test_mapping_lookup_prefers_the_given_specs():
    other = presets.TASK.with_(name="default")
    assert find_mapping([presets.TASK], a_type="Task", defaults=[other]).name == "tasks_Task"
    assert find_mapping([], b_table="tasks", defaults=[other]).name == "default"
    assert find_mapping([presets.TASK], a_type="None") is None


def test_bad_direction():
    with pytest.raises(ValueError):
        sides("a2a")


def test_a_mapping_with_an_unknown_transform_is_refused(spark):
    spec = MappingSpec("m", "A", "b", {"x": "y"}, derive_a2b={"x": {"type": "no such type"}})
    with pytest.raises(ValueError, match="unknown transform"):
        m.compile_mapping(spark.createDataFrame([("1",)], "x string"), spec, A2B)


def test_lookups_keep_what_they_do_not_find(spark):
    from tablesync.operators.lookups import map_with_lookups

    conf = {"type": "lookup", "b_table": "dim", "a_field": "k", "b_field": "v"}
    items = {**conf, "type": "array_to_uuid_array"}
    spec = MappingSpec("m", "A", "b", {"x": "y", "items": "items"}, derive_a2b={"x": conf, "items": items})
    df = spark.createDataFrame(
        [("1", "p", "['p', 'q', 'p']"), ("2", "?", "[]"), ("3", None, "no list"), ("4", "q", None)], "name string, x string, items string"
    )
    # two rows for one key: the smaller value; a key without a value is no hit
    dim = spark.createDataFrame([("p", "P2"), ("p", "P1"), ("q", None)], "k string, v string")
    rows = map_with_lookups(df, spec, A2B, {"dim": dim}, "name", keep=("name",)).sort("_name").collect()
    assert [(r.y, r["items"]) for r in rows] == [("P1", ["P1", "q", "P1"]), ("?", []), (None, None), ("q", None)]
    with pytest.raises(ValueError, match="not given"):
        map_with_lookups(df, spec, A2B, {}, "name")
