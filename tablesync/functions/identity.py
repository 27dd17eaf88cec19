"""Record identities: the keys that deduplication and matching work on."""

from __future__ import annotations

import re
from typing import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesync.functions.text import first_non_empty, non_empty, snippet

# Lookup field lists per direction ("any" when the target is open).
PHONE_FIELDS = {
    "a2b": ("cell_number", "mobile_no", "phone", "contact_number"),
    "b2a": ("phone_number", "mobile", "phone", "contact_number"),
    "any": ("phone_number", "cell_number", "mobile_no", "phone", "contact_number"),
}
EMAIL_FIELDS = {
    "a2b": ("personal_email", "company_email", "preferred_contact_email", "email"),
    "b2a": ("email", "personal_email", "company_email"),
    "any": ("email", "personal_email", "company_email", "preferred_contact_email"),
}
PERSON_TYPES = ("employee", "users", "person")
TASK_TYPES = ("task", "tasks")
TASK_LIKE_FIELDS = (
    "subject",
    "task_name",
    "description",
    "page_content",
    "progress",
    "is_milestone",
)


def normalize_phone(phone: Column) -> Column:
    """Last ten digits; null when there are fewer. Digits of any script count."""
    digits = F.regexp_replace(phone, r"[^\p{Nd}]", "")
    return F.get(F.regexp_extract_all(digits, F.lit(".{10}$"), F.lit(0)), F.lit(0))


Getter = Callable[[str], Column]


def _having(fields: Sequence[str], columns: Iterable[str], get: Getter) -> list[Column]:
    present = set(columns)
    return [get(f).cast("string") for f in fields if f in present]


def _first(values: list[Column]) -> Column:
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def first_phone(columns: Iterable[str], which: str = "any", get: Getter = F.col) -> Column:
    return _first([normalize_phone(c) for c in _having(PHONE_FIELDS[which], columns, get)])


def first_email(columns: Iterable[str], which: str = "any", get: Getter = F.col) -> Column:
    return _first([non_empty(c) for c in _having(EMAIL_FIELDS[which], columns, get)])


def _first_text(fields: Sequence[str], columns: Iterable[str], get: Getter = F.col) -> Column:
    return _first([non_empty(c) for c in _having(fields, columns, get)])


def _unless_bare(prefix: str, tail: Column) -> Column:
    """prefix + tail, or '' for an empty tail; names the tail only once."""
    return F.regexp_replace(F.concat(F.lit(prefix), tail), f"^{re.escape(prefix)}$", "")


def person_identity(columns: Iterable[str], get: Getter = F.col) -> Column:
    columns = list(columns)
    return F.coalesce(
        F.concat(F.lit("phone:"), first_phone(columns, get=get)),
        F.concat(F.lit("email:"), first_email(columns, get=get)),
    )


def task_identity(columns: Iterable[str], get: Getter = F.col) -> Column:
    columns = list(columns)
    subject = _first_text(("subject", "task_name", "name"), columns, get)
    tail = snippet(_first_text(("description", "page_content"), columns, get))
    return F.concat(F.lit("subject:"), subject, _unless_bare("_desc:", tail))


def dedup_identity(entity: Column, columns: Iterable[str], get: Getter = F.col) -> Column:
    """Identity an event is throttled on, chosen by its entity type; null: never throttled."""
    columns = list(columns)
    kind = F.lower(entity)
    name = _first_text(("name", "title", "subject"), columns, get)
    return (
        F.when(kind.isin(*PERSON_TYPES), person_identity(columns, get))
        .when(kind.isin(*TASK_TYPES), task_identity(columns, get))
        .otherwise(F.concat(F.lit("name:"), name))
    )


def match_identity(
    columns: Iterable[str], direction: str, present: Column | None = None
) -> tuple[Column, Column]:
    """(type, value) a mapped record is looked up by in the target system.

    Task-like means that any task field is *present*; with a per-row mask the test is
    made per row, without one the column list decides.
    """
    columns = list(columns)
    subject = _first_text(("subject", "task_name", "name"), columns)
    tail = snippet(_first_text(("description", "page_content"), columns))
    subject_value = F.concat(subject, _unless_bare("|", tail))
    task_like = (
        F.lit(any(c in TASK_LIKE_FIELDS for c in columns))
        if present is None
        else F.arrays_overlap(present, F.array(*[F.lit(f) for f in TASK_LIKE_FIELDS]))
    )
    task = F.when(task_like, subject_value)
    phone, email = first_phone(columns, direction), first_email(columns, direction)
    kind = (
        F.when(task.isNotNull(), "task_subject")
        .when(phone.isNotNull(), "phone")
        .when(email.isNotNull(), "email")
    )
    return kind, F.coalesce(task, phone, email)


def person_key(columns: Iterable[str], which: str = "any") -> Column:
    return first_non_empty(first_phone(columns, which), first_email(columns, which))
