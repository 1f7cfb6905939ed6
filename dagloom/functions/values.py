"""Scalar functions on columns: JSON safety and canonical form, fingerprints, effect refs, contexts
and tagged results."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON


def is_json_safe(text: Column) -> Column:
    """True for text that parses, without repeated keys or non-finite numbers."""
    return F.try_parse_json(text).isNotNull()


def canonical_json(text: Column) -> Column:
    """Compact JSON with keys sorted at every level, arrays as they are."""
    return F.to_json(F.parse_json(text))


def fingerprint(text: Column) -> Column:
    return F.sha2(canonical_json(text).cast("binary"), 256)


def json_safe_path(value: Any, path: str = "$root") -> str | None:
    """The path of the first value that JSON can't hold, or None."""
    if value is None or isinstance(value, (str, bool, int)):
        return None
    if isinstance(value, float):
        return None if math.isfinite(value) else path
    if isinstance(value, dict):
        if len({str(k) for k in value}) < len(value):
            return path
        for k, v in value.items():
            if not isinstance(k, str):
                return f"{path}.{k}"
            found = json_safe_path(v, f"{path}.{k}")
            if found:
                return found
        return None
    if isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            found = json_safe_path(v, f"{path}[{i}]")
            if found:
                return found
        return None
    return path


def require_json_safe(value: Any) -> Any:
    bad = json_safe_path(value)
    if bad:
        raise ValueError(f"not JSON-safe at {bad}")
    return value


def dump(value: Any) -> str:
    """Canonical JSON text of a Python value."""
    return json.dumps(require_json_safe(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def load(text: str) -> Any:
    return json.loads(text)


# effects


def effect_ref(type_: Column, key: Column) -> Column:
    """type:key; a colon in either part is an error."""
    bad = F.contains(type_, F.lit(":")) | F.contains(key, F.lit(":"))
    return F.when(bad, F.raise_error(F.concat(F.lit("':' in effect ref part: "), type_, F.lit(" "), key))).otherwise(F.concat_ws(":", type_, key))


def failure_status(retriable: Column) -> Column:
    return F.when(retriable, "failed_retriable").otherwise("failed_terminal")


def snapshot_value(snapshot: Column, field: str, required: bool = False) -> Column:
    return F.element_at(snapshot, field) if required else F.try_element_at(snapshot, F.lit(field))


def error_code(error: Column) -> Column:
    """The error itself if it is a JSON scalar (string or integer), else its `code` if that is one."""
    v = F.try_parse_json(error)
    kind = F.schema_of_variant(v)
    code = F.try_variant_get(v, "$.code", "string")
    code_kind = F.schema_of_variant(F.try_variant_get(v, "$.code", "variant"))
    scalar = F.array(F.lit("STRING"), F.lit("BIGINT"))
    return F.when(F.array_contains(scalar, kind), F.try_variant_get(v, "$", "string")).when(F.array_contains(scalar, code_kind), code)


# context: map<string, string>


def context_get(context: Column, key: str) -> Column:
    return F.try_element_at(context, F.lit(key))


def context_fetch(context: Column, key: str) -> Column:
    """As context_get, but a missing key is an error."""
    return F.when(F.map_contains_key(context, key), context_get(context, key)).otherwise(F.raise_error(F.lit(f"no key: {key}")).cast("string"))


def context_entries(context: Column) -> Column:
    """(key, value) pairs by key."""
    return F.array_sort(F.map_entries(context))


def context_equal(left: Column, right: Column) -> Column:
    """Maps can't be compared, their sorted entries can."""
    return context_entries(left).eqNullSafe(context_entries(right))


def context_empty(context: Column) -> Column:
    return F.size(context) == 0


def context_keys(context: Column) -> Column:
    return F.array_sort(F.map_keys(context))


def context_has(context: Column, key: str) -> Column:
    return F.map_contains_key(context, key)


def context_size(context: Column) -> Column:
    return F.size(context)


def context_dig(text: Column, *path: str) -> Column:
    """A nested value of a JSON context, as text; keys may hold dots and brackets."""
    for p in path:
        if re.search(r"['?]", p):
            raise ValueError(f"a path can't name the key {p!r}")
    return F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path))


# tagged results: struct<kind, value, error, ...>


def on_success(result: Column, then: Callable[[Column], Column], otherwise: Callable[[Column], Column]) -> Column:
    """`then` of the value of a success, `otherwise` of the error of a failure."""
    return F.when(result["kind"] == "success", then(result["value"])).otherwise(otherwise(result["error"]))


def map_value(result: Column, f: Callable[[Column], Column]) -> Column:
    return result.withField("value", F.when(result["kind"] == "success", f(result["value"])).otherwise(result["value"]))


def recover(result: Column, f: Callable[[Column], Column]) -> Column:
    failed = result["kind"] == "failure"
    return result.withField("value", F.when(failed, f(result["error"])).otherwise(result["value"])).withField("kind", F.when(failed, F.lit("success")).otherwise(result["kind"]))


def unwrap(result: Column) -> Column:
    return F.when(result["kind"] == "success", result["value"]).otherwise(F.raise_error(F.concat(F.lit("no success: "), F.coalesce(result["error"], F.lit("")))))


def millis(seconds: Column) -> Column:
    """Epoch seconds to whole milliseconds, truncated."""
    return F.floor(seconds * 1000).cast("long")


def timestamp_millis(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 1000).cast("long")


# driver-side checks

#: kinds of values that `expect` names
KINDS: dict[str, tuple[type, ...]] = {"array": (list, tuple), "mapping": (dict,), "string": (str,), "integer": (int,), "boolean": (bool,)}


def expect(value: Any, kind: str | type, name: str, optional: bool = False, message: str | None = None) -> Any:
    """The value if it is of a kind of KINDS or of a class, or None where that is allowed. A
    boolean is no integer."""
    types = KINDS[kind] if isinstance(kind, str) else (kind,)
    if (value is None and optional) or (isinstance(value, types) and (kind != "integer" or not isinstance(value, bool))):
        return value
    what = kind if isinstance(kind, str) else kind.__name__
    raise ValueError(message or f"{name} must be a {what}{' or None' if optional else ''}")


def positive_int(value: Any, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return value


def nonneg_int(value: Any, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be a non-negative integer")
    return value


def nonempty(value: Any, name: str) -> str:
    if not isinstance(value, str) or not value:
        raise ValueError(f"{name} must be a non-empty string")
    return value


def one_of(value: Any, allowed: tuple, name: str, message: str | None = None) -> Any:
    if value not in allowed:
        raise ValueError(message or f"invalid {name}: {value!r}")
    return value


def ref_part(value: Any, name: str) -> str:
    if re.search(":", nonempty(value, name)):
        raise ValueError(f"{name} must not hold ':'")
    return value


def revision_number(value: Any) -> int:
    return positive_int(value, "revision")


def node_name(value: Any) -> str:
    return expect(value, "string", "node id")


def able_to(value: Any, methods: tuple[str, ...], name: str) -> Any:
    """A dependency that has all the methods."""
    lacks = [m for m in methods if not callable(getattr(value, m, None))]
    if lacks:
        raise ValueError(f"{name} lacks {', '.join(lacks)}")
    return value


def all_given(given: dict[str, Any], name: str) -> dict[str, Any]:
    missing = [k for k, v in given.items() if v is None]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return given
