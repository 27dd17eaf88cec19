"""The four entity mappings shipped with the engine, and their match keys."""

from __future__ import annotations

from tablesync.profiles import MappingSpec, MatchKey

# Constants the shipped mappings write.
ORGANIZATION_ID = "466a07d9-6f3d-462a-be75-f4cd8691b9bf"
DEFAULT_GENDER = "Male"
DEFAULT_BIRTH = "1990-01-01"
DEFAULT_JOINING = "2025-01-01"

_DAY_OF_STAMP = {
    "type": "date_format_conversion",
    "input_format": "iso_datetime",
    "output_format": "date_string",
}
_STATUS = {"type": "status_mapping", "active_status": "Active", "inactive_status": "Inactive"}


def _fallback(primary: str, fallback: str) -> dict:
    return {"type": "date_fallback", "primary_field": primary, "fallback_field": fallback}


def _constant(value: str, mode: str = "overwrite") -> dict:
    return {"type": "default_value", "value": value, "mode": mode}


# Field pairs, derived fields and synced fields of each entity.
TASK = MappingSpec(
    name="tasks_Task",
    a_type="Task",
    b_table="tasks",
    fields_a2b={
        "subject": "task_name",
        "status": "status",
        "act_start_date": "start_date",
        "act_end_date": "end_date",
        "is_milestone": "needs_submission",
        "creation": "created_at",
        "modified": "updated_at",
        "description": "page_content",
        "organization_id": "organization_id",
    },
    fields_b2a={
        "task_name": "subject",
        "status": "status",
        "start_date": "act_start_date",
        "end_date": "act_end_date",
        "needs_submission": "is_milestone",
        "created_at": "creation",
        "updated_at": "modified",
        "page_content": "description",
    },
    derive_a2b={
        "act_start_date": _fallback("act_start_date", "exp_start_date"),
        "act_end_date": _fallback("act_end_date", "exp_end_date"),
        "organization_id": _constant(ORGANIZATION_ID, "if_absent"),
    },
    derive_b2a={"start_date": _DAY_OF_STAMP, "end_date": _DAY_OF_STAMP},
    sync_fields=(
        "subject",
        "status",
        "act_start_date",
        "act_end_date",
        "exp_start_date",
        "exp_end_date",
        "is_milestone",
        "creation",
        "modified",
        "priority",
        "description",
        "organization_id",
    ),
    match_keys=(MatchKey("subject", "task_name", "subject", "page_content", "description"),),
)

PERSON = MappingSpec(
    name="users_Employee",
    a_type="Employee",
    b_table="users",
    fields_a2b={
        "name": "name",
        "personal_email": "email",
        "cell_number": "phone_number",
        "status": "_legacy_is_active",
        "company": "organization_id",
    },
    fields_b2a={
        "name": "first_name",
        "email": "personal_email",
        "phone_number": "cell_number",
        "_legacy_is_active": "status",
        "organization_id": "company",
        "last_name": "last_name",
        "gender": "gender",
        "date_of_birth": "date_of_birth",
        "date_of_joining": "date_of_joining",
    },
    derive_a2b={
        "name": {"type": "name_combination"},
        "email": {"type": "email_priority", "email_priority": ["personal_email", "prefered_email"]},
        "status": _STATUS,
        "company": {"type": "company_to_org_mapping", "mappings": {}},
    },
    derive_b2a={
        "first_name": {"type": "reverse_name_combination"},
        "_legacy_is_active": _STATUS,
        "organization_id": {"type": "company_to_org_mapping", "mappings": {}, "into": "company"},
        "gender": _constant(DEFAULT_GENDER),
        "date_of_birth": _constant(DEFAULT_BIRTH),
        "date_of_joining": _constant(DEFAULT_JOINING),
    },
    sync_fields=("first_name", "last_name", "personal_email", "cell_number", "status", "company"),
    match_keys=(MatchKey("email", "email", "personal_email"),),
)

PROJECT = MappingSpec(
    name="projects_Project",
    a_type="Project",
    b_table="projects",
    fields_a2b={
        "name": "id",
        "project_name": "name",
        "status": "status",
        "is_active": "is_active",
        "company": "organization_id",
        "priority": "priority",
        "percent_complete": "progress",
    },
    fields_b2a={
        "id": "name",
        "name": "project_name",
        "status": "status",
        "is_active": "is_active",
        "organization_id": "company",
        "priority": "priority",
        "progress": "percent_complete",
    },
    derive_a2b={"company": {"type": "company_to_org_mapping", "mappings": {}}},
    sync_fields=(
        "name",
        "project_name",
        "status",
        "is_active",
        "company",
        "priority",
        "percent_complete",
    ),
    match_keys=(MatchKey("subject", "name", "project_name"),),
)

TRAINING = MappingSpec(
    name="training_events_Training_Event",
    a_type="Training Event",
    b_table="training_events",
    fields_a2b={
        "name": "id",
        "event_name": "event_title",
        "event_type": "event_type",
        "start_time": "start_date",
        "end_time": "end_date",
        "status": "status",
        "description": "description",
        "location": "location",
        "instructor": "instructor",
        "max_participants": "max_participants",
        "participants": "participants",
        "company": "organization_id",
        "creation": "created_at",
        "modified": "updated_at",
        "owner": "created_by",
    },
    fields_b2a={
        "id": "name",
        "event_title": "event_name",
        "event_type": "event_type",
        "start_date": "start_time",
        "end_date": "end_time",
        "status": "status",
        "description": "description",
        "location": "location",
        "instructor": "instructor",
        "max_participants": "max_participants",
        "participants": "participants",
        "organization_id": "company",
        "created_at": "creation",
        "updated_at": "modified",
        "created_by": "owner",
    },
    derive_a2b={
        "participants": {"type": "array_mapping"},
        "instructor": {"type": "lookup"},
        "company": {"type": "lookup"},
    },
    sync_fields=(
        "name",
        "event_name",
        "event_type",
        "start_time",
        "end_time",
        "status",
        "description",
        "location",
        "instructor",
        "max_participants",
        "participants",
        "company",
        "creation",
        "modified",
        "owner",
    ),
    match_keys=(MatchKey("subject", "event_title", "event_name", "description", "description"),),
)

ALL = (TASK, PERSON, PROJECT, TRAINING)


def with_companies(spec: MappingSpec, companies: dict[str, str]) -> MappingSpec:
    """The mapping with a company -> organisation table, and its inverse going back."""
    back = {v: k for k, v in companies.items()}

    def fill(rules, values):
        return {
            f: {**c, "mappings": values} if c.get("type") == "company_to_org_mapping" else c
            for f, c in rules.items()
        }

    return spec.with_(
        derive_a2b=fill(spec.derive_a2b, companies), derive_b2a=fill(spec.derive_b2a, back)
    )
