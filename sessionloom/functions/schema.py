"""The closed records of the store: what they hold, a check that names every wrong field, and their JSON Schemas."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains of the enumerated fields (fixed values; the order of types is the scan order).
TYPES, STATUSES, CONFIDENCES = ("strategy", "gotcha", "fact"), ("staged", "approved", "rejected", "superseded", "archived"), ("low", "medium", "high")
ACTIONS = ("approve", "approve_with_edit", "merge", "reject", "skip", "staged", "gate_drop")
ROLES = ("user", "assistant", "tool")
SPEC_VERSION = "0.1.0"

#: Fields by record (fixed values). A kind is str, time, int, bool, any, a tuple (one of its values), a list (of one kind)
#: or a record; `!` marks a required field, `?` one that may be null.
EVIDENCE = {"harness!": "str", "session_id?": "str", "captured_at!": "time", "artifacts": ["str"], "commit?": "str", "excerpt_sha256?": "str"}
ENTRY = {
    "id!": "str", "type!": TYPES, "title!": "str", "status!": STATUSES, "spec_version!": "str", "scope": ["str"], "tags": ["str"], "confidence!": CONFIDENCES, "evidence!": EVIDENCE,
    "created!": "time", "updated!": "time", "supersedes": ["str"], "review?": {"approved_by?": "str", "approved_at?": "time"}, "usage": {"injected": "int", "marked_useful": "int", "marked_stale": "int"},
    "proposed_amendment_of?": "str", "proposed_supersession_of?": "str",
}
CANDIDATE = {"id!": "str", "type!": TYPES, "title!": "str", "artifacts": ["str"], "scope": ["str"], "tags": ["str"], "confidence!": CONFIDENCES, "body!": "str"}
TRACE = {
    "session_id!": "str", "harness!": "str", "started_at!": "time", "ended_at!": "time", "outcome!": "str", "commit?": "str", "errors": ["str"], "diffs": [{"file!": "str", "patch!": "str"}],
    "turns": [{"role!": ROLES, "content!": "str", "tool_calls": [{"name!": "str", "input": "object"}], "tool_results": [{"name!": "str", "output?": "any", "is_error": "bool"}]}],
}
LOG = {"ts!": "time", "candidate_id!": "str", "type!": TYPES, "title!": "str", "action!": ACTIONS, "reason?": "str", "session_id?": "str", "harness?": "str", "model?": "str", "edited_fields": ["str"]}


def _time(x: Any) -> bool:
    if isinstance(x, datetime.date):
        return True
    try:
        return isinstance(x, str) and bool(datetime.datetime.fromisoformat(x.replace("Z", "+00:00")))
    except ValueError:
        return False


_KINDS = {"str": lambda x: isinstance(x, str), "int": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(), "bool": lambda x: isinstance(x, bool), "time": _time, "object": lambda x: isinstance(x, dict), "any": lambda x: True}


def problems(value: Any, kind: Any, at: str = "") -> list[str]:
    """What is wrong with a value, as `field.path: message`; nothing if it is of the kind."""
    here = at or "<root>"
    if isinstance(kind, dict):
        if not isinstance(value, dict):
            return [f"{here}: not an object"]
        fields = {k.rstrip("!?"): (k[-1:], v) for k, v in kind.items()}
        under = lambda k: f"{at}.{k}" if at else k
        out = [f"{under(k)}: unknown field" for k in value if k not in fields]
        for k, (mark, inner) in fields.items():
            if k not in value:
                out += [f"{under(k)}: missing"] if mark == "!" else []
            elif not (mark == "?" and value[k] is None):
                out += problems(value[k], inner, under(k))
        return out
    if isinstance(kind, list):
        return [p for i, x in enumerate(value) for p in problems(x, kind[0], f"{here}.{i}")] if isinstance(value, list) else [f"{here}: not a list"]
    if isinstance(kind, tuple):
        return [] if value in kind else [f"{here}: not one of {', '.join(kind)}"]
    return [] if _KINDS[kind](value) else [f"{here}: not of kind {kind}"]


#: How a time may be written, so that both checks agree on it.
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"


def problem_list(raw: Column, kind: dict) -> Column:
    """`problems` of JSON texts, as an array, without Python workers: a record kind becomes an expression over VARIANT.

    A text that is no JSON, or has an object with a key twice, is not JSON. Unknown fields of the outer record come in
    their order, those of inner ones by name.
    """
    whole = F.try_parse_json(raw)
    none = F.array().cast("array<string>")
    say = lambda when, *text: F.when(when, F.array(F.concat(*text))).otherwise(none)
    typed = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    part = lambda v, path, as_type: F.try_variant_get(v, path, as_type)

    def wrong(v: Column, kind: Any, at: Column, keys: Column) -> Column:
        if isinstance(kind, dict):
            prefix = F.when(at == "", F.lit("")).otherwise(F.concat(at, F.lit(".")))
            fields = {k.rstrip("!?"): (k[-1:], inner) for k, inner in kind.items()}
            strange = F.array_except(F.coalesce(keys, none), F.array(*map(F.lit, fields)))
            out = [F.transform(strange, lambda k: F.concat(prefix, k, F.lit(": unknown field")))]
            for name, (mark, inner) in fields.items():
                x = part(v, f"$.{name}", "variant")
                own = wrong(x, inner, F.concat(prefix, F.lit(name)), F.json_object_keys(F.to_json(x)))
                own = F.when(F.is_variant_null(x), none).otherwise(own) if mark == "?" else own
                out.append(F.when(x.isNull(), say(F.lit(mark == "!"), prefix, F.lit(f"{name}: missing"))).otherwise(own))
            here = F.when(at == "", F.lit("<root>")).otherwise(at)
            return F.when(typed(v).startswith("OBJECT"), F.concat(*out)).otherwise(F.array(F.concat(here, F.lit(": not an object"))))
        if isinstance(kind, list):
            items = F.transform(part(v, "$", "array<variant>"), lambda x, i: wrong(x, kind[0], F.concat(at, F.lit("."), i.cast("string")), F.json_object_keys(F.to_json(x))))
            return F.when(typed(v).startswith("ARRAY"), F.flatten(items)).otherwise(F.array(F.concat(at, F.lit(": not a list"))))
        text = F.when(typed(v) == "STRING", part(v, "$", "string"))
        if isinstance(kind, tuple):
            return say(~F.coalesce(text.isin(*kind), F.lit(False)), at, F.lit(f": not one of {', '.join(kind)}"))
        ok = {"str": text.isNotNull(), "int": typed(v).rlike(r"^(?:BIGINT|DECIMAL\(\d+,0\))$"), "bool": typed(v) == "BOOLEAN", "time": text.rlike(_ISO) & F.try_to_timestamp(text).isNotNull(), "object": typed(v).startswith("OBJECT"), "any": F.lit(True)}[kind]
        return say(~F.coalesce(ok, F.lit(False)), at, F.lit(f": not of kind {kind}"))

    return F.when(whole.isNull(), F.array(F.lit("<root>: not JSON"))).otherwise(wrong(whole, kind, F.lit(""), F.array_distinct(F.json_object_keys(raw))))


def warnings(entry: dict) -> list[str]:
    """What is odd about a valid entry."""
    return [] if entry.get("scope") else ["scope: empty, so no path is ever in it"]


_JSON = {"str": {"type": "string"}, "int": {"type": "integer"}, "bool": {"type": "boolean"}, "time": {"type": "string", "format": "date-time"}, "object": {"type": "object"}, "any": {}}


def json_schema(kind: Any) -> dict:
    """The JSON Schema of a record kind."""
    if isinstance(kind, dict):
        inner = {k.rstrip("!?"): json_schema(v) for k, v in kind.items()}
        for k in kind:
            if k[-1] == "?":
                inner[k[:-1]] = {"anyOf": [inner[k[:-1]], {"type": "null"}]}
        return {"type": "object", "properties": inner, "required": [k[:-1] for k in kind if k[-1] == "!"], "additionalProperties": False}
    if isinstance(kind, list):
        return {"type": "array", "items": json_schema(kind[0])}
    return {"enum": list(kind), "type": "string"} if isinstance(kind, tuple) else dict(_JSON[kind])


def response_schema() -> dict:
    """What a model's answer must look like: an object with a list of candidates, which may be empty."""
    return {"type": "object", "properties": {"candidates": {"type": "array", "items": json_schema(CANDIDATE)}}, "required": ["candidates"], "additionalProperties": False}
