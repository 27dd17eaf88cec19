"""Driver-side metadata: the two systems and the entity mappings between them.

A mapping is plan metadata, not data: it is read once on the driver and compiled
into Column expressions (`operators.mapping`).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any, Iterable, Mapping

A2B = "a2b"
B2A = "b2a"
DIRECTIONS = (A2B, B2A)
STRATEGIES = ("last_modified_wins", "a_wins", "b_wins", "manual")


@dataclass(frozen=True)
class SystemProfile:
    """One side of the sync."""

    name: str
    id_col: str
    modified_col: str
    drop_cols: tuple[str, ...] = ()
    empty_is_null: bool = True  # side b stores null for "", side a stores "" for null
    iso_timestamps: bool = True  # side b keeps ISO text, side a "yyyy-MM-dd HH:mm:ss"


# Bookkeeping fields of side a that never leave it.
A_INTERNAL_FIELDS = (
    "_assign",
    "__islocal",
    "__unsaved",
    "__user_tags",
    "__comments",
    "_user_tags",
    "_comments",
)

SYSTEM_A = SystemProfile("a", "name", "modified", A_INTERNAL_FIELDS, False, False)
SYSTEM_B = SystemProfile("b", "id", "updated_at")


def profile_of(side: str) -> SystemProfile:
    return {"a": SYSTEM_A, "b": SYSTEM_B}[side]


def sides(direction: str) -> tuple[str, str]:
    """(source side, target side) of a direction."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, got {direction!r}")
    return (direction[0], direction[2])


@dataclass(frozen=True)
class MatchKey:
    """How a mapped record finds its row in the target table, one column per direction."""

    kind: str  # "email" | "phone" | "subject"
    b_col: str
    a_col: str
    b_text: str | None = None  # long text whose snippet must be contained, for "subject"
    a_text: str | None = None

    def column(self, direction: str) -> str:
        return self.b_col if direction == A2B else self.a_col

    def text(self, direction: str) -> str | None:
        return self.b_text if direction == A2B else self.a_text


@dataclass(frozen=True)
class MappingSpec:
    name: str
    a_type: str
    b_table: str
    fields_a2b: Mapping[str, str]
    fields_b2a: Mapping[str, str] = field(default_factory=dict)
    derive_a2b: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    derive_b2a: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    sync_fields: tuple[str, ...] = ()
    strategy: str = "last_modified_wins"
    direction: str = "bidirectional"
    enabled: bool = True
    filters: Mapping[str, Any] = field(default_factory=dict)
    match_keys: tuple[MatchKey, ...] = ()

    def fields(self, direction: str) -> Mapping[str, str]:
        return self.fields_a2b if direction == A2B else self.fields_b2a

    def derive(self, direction: str) -> Mapping[str, Mapping[str, Any]]:
        return self.derive_a2b if direction == A2B else self.derive_b2a

    def allows(self, direction: str) -> bool:
        return self.enabled and self.direction in ("bidirectional", direction)

    def with_(self, **changes: Any) -> "MappingSpec":
        return replace(self, **changes)

    @staticmethod
    def simple(a_type: str, b_table: str, fields_a2b: Mapping[str, str]) -> "MappingSpec":
        return MappingSpec(
            f"{b_table}_{a_type}",
            a_type,
            b_table,
            dict(fields_a2b),
            {t: s for s, t in fields_a2b.items()},
            sync_fields=tuple(fields_a2b),
        )

    @staticmethod
    def from_dict(name: str, conf: Mapping[str, Any]) -> "MappingSpec":
        """Accepts the JSON layout `{a_type, b_table, sync_fields, field_mappings,
        reverse_mappings, complex_mappings, reverse_complex_mappings, ...}`.

        The two type keys may carry a product prefix (`<x>_doctype`, `<y>_table`), and
        a strategy may be spelled `<x>_wins` with the same prefixes.
        """
        a_key = _suffix_key(conf, ("a_type",), "_doctype")
        b_key = _suffix_key(conf, ("b_table",), "_table")
        errors = [k for k in (a_key, b_key) if k is None]
        if errors or not isinstance(conf.get("field_mappings"), Mapping):
            raise ValueError(f"mapping {name!r}: needs a source type, a table and field_mappings")
        prefixes = {a_key.rsplit("_", 1)[0]: "a", b_key.rsplit("_", 1)[0]: "b"}
        return MappingSpec(
            name=name,
            a_type=conf[a_key],
            b_table=conf[b_key],
            fields_a2b=dict(conf["field_mappings"]),
            fields_b2a=dict(conf.get("reverse_mappings", {})),
            derive_a2b=_organization_rules(conf.get("complex_mappings", {})),
            derive_b2a=_organization_rules(conf.get("reverse_complex_mappings", {})),
            sync_fields=tuple(conf.get("sync_fields", ())),
            strategy=_side_word(
                conf.get("conflict_resolution", "last_modified_wins"), "_wins", prefixes
            ),
            direction=_direction_word(conf.get("direction", "bidirectional"), prefixes),
            enabled=bool(conf.get("enabled", True)),
            filters=dict(conf.get("filters") or {}),
            match_keys=tuple(MatchKey(**k) for k in conf["match_keys"])
            if "match_keys" in conf
            else default_match_keys(conf["field_mappings"]),
        )


# The fields that identify a record, by kind, in the order they are looked up.
_EMAIL_COLUMNS = ("email", "personal_email", "company_email", "preferred_contact_email")
_PHONE_COLUMNS = ("phone_number", "cell_number", "mobile_no", "mobile", "phone", "contact_number")
_SUBJECT_COLUMNS = ("subject", "task_name", "title", "name")
_TEXT_COLUMNS = ("description", "page_content")


def default_match_keys(fields_a2b: Mapping[str, str]) -> tuple[MatchKey, ...]:
    """How records are matched if a mapping file says nothing: persons by email, then phone;
    everything else by its subject, with the long text as a check."""

    def pair(names: tuple[str, ...]) -> tuple[str, str] | None:
        """The first mapped pair of which both, else one, is among the names."""
        both = [(a, b) for a, b in fields_a2b.items() if a in names and b in names]
        one = [(a, b) for a, b in fields_a2b.items() if a in names or b in names]
        return next(iter([*both, *one]), None)

    email, phone = pair(_EMAIL_COLUMNS), pair(_PHONE_COLUMNS)
    keys = [MatchKey(kind, p[1], p[0]) for kind, p in (("email", email), ("phone", phone)) if p]
    subject, text = pair(_SUBJECT_COLUMNS), pair(_TEXT_COLUMNS)
    if not keys and subject:
        keys = [MatchKey("subject", subject[1], subject[0], *(reversed(text) if text else ()))]
    return tuple(keys)


def _organization_rules(rules: Mapping[str, Any]) -> dict[str, Any]:
    """`organization_id` is special in that layout: its default fills only a missing value,
    and its value map feeds `company`."""
    out = dict(rules)
    rule = out.get("organization_id", {})
    if rule.get("type") == "default_value":
        out["organization_id"] = {"mode": "if_absent", **rule}
    elif rule.get("type") == "company_to_org_mapping":
        out["organization_id"] = {"into": "company", **rule}
    return out


def _suffix_key(conf: Mapping[str, Any], exact: tuple[str, ...], suffix: str) -> str | None:
    for key in exact:
        if key in conf:
            return key
    return next((k for k in conf if k.endswith(suffix)), None)


def _side_word(word: str, suffix: str, prefixes: Mapping[str, str]) -> str:
    stem = word.removesuffix(suffix)
    word = f"{prefixes[stem]}{suffix}" if stem in prefixes else word
    if word not in STRATEGIES:
        raise ValueError(f"unknown conflict strategy {word!r}")
    return word


def _direction_word(word: str, prefixes: Mapping[str, str]) -> str:
    left, sep, right = word.partition("_to_")
    if sep and left in prefixes and right in prefixes:
        word = f"{prefixes[left]}2{prefixes[right]}"
    if word not in ("bidirectional", *DIRECTIONS):
        raise ValueError(f"unknown sync direction {word!r}")
    return word


def load_mappings(path: str) -> list[MappingSpec]:
    with open(path, encoding="utf-8") as handle:
        conf = json.load(handle)
    return [MappingSpec.from_dict(name, body) for name, body in conf.items()]


def find_mapping(
    specs: Iterable[MappingSpec],
    *,
    a_type: str | None = None,
    b_table: str | None = None,
    defaults: Iterable[MappingSpec] = (),
) -> MappingSpec | None:
    """First spec whose type (or table) equals the wanted one, else the defaults."""
    for pool in (specs, defaults):
        for spec in pool:
            if a_type is not None and spec.a_type == a_type:
                return spec
            if b_table is not None and spec.b_table == b_table:
                return spec
    return None
