"""Values of the kernel: definitions, results, effects, mutations, and its errors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession

from dagloom.functions import values as V
from dagloom.operators.graph import CycleError, DuplicateNodeError, Graph, GraphError, UnknownNodeError
from dagloom.operators.paths import _Local
from dagloom.schema import DURABILITIES, MUTATION_KINDS, TERMINAL_EFFECT_STATUSES


class KernelError(Exception):
    pass


class StaleRevisionError(KernelError):
    pass


class StaleStateError(KernelError):
    pass


class ConcurrentMutationError(KernelError):
    pass


class UnknownWorkflowError(KernelError):
    pass


class UnknownStepTypeError(KernelError):
    pass


class FingerprintMismatchError(KernelError):
    pass


class WorkflowRetryExhaustedError(KernelError):
    pass


class UnknownEffectError(KernelError):
    pass


class UnknownHandlerError(KernelError):
    pass


class IdempotencyConflictError(KernelError):
    pass


class StaleLeaseError(KernelError):
    pass


@dataclass(frozen=True)
class Definition:
    """A revision of a workflow: nodes with step type and config in insertion order, and edges."""

    nodes: tuple[tuple[str, str, dict], ...] = ()
    edges: tuple[tuple[str, str, dict], ...] = ()
    revision: int = 1

    def add_node(self, node_id: str, type: str, config: dict | None = None) -> Definition:
        if node_id in self.node_ids:
            raise DuplicateNodeError(f"duplicate node: {node_id}")
        V.require_json_safe(config or {})
        return replace(self, nodes=(*self.nodes, (V.nonempty(node_id, "node id"), V.nonempty(type, "type"), dict(config or {}))))

    def add_edge(self, src: str, dst: str, **metadata: Any) -> Definition:
        V.require_json_safe(metadata)
        weight = metadata.get("weight", 1)
        if isinstance(weight, bool) or not isinstance(weight, (int, float)):
            raise GraphError(f"weight is not a number: {weight!r}")
        for x in (src, dst):
            if x not in self.node_ids:
                raise UnknownNodeError(f"unknown node: {x}")
        if src == dst:
            raise CycleError(f"self loop: {src}")
        if any(e[:2] == (src, dst) for e in self.edges):
            return self
        if self._reaches(dst, src):
            raise CycleError(f"edge {src} -> {dst} closes a cycle")
        return replace(self, edges=(*self.edges, (src, dst, metadata)))

    def _reaches(self, src: str, dst: str) -> bool:
        after: dict[str, list[str]] = {}
        for a, b, _ in self.edges:
            after.setdefault(a, []).append(b)
        seen, front = {src}, [src]
        while front:
            for b in after.get(front.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    front.append(b)
        return dst in seen

    def with_revision(self, revision: int) -> Definition:
        return replace(self, revision=V.positive_int(revision, "revision"))

    @property
    def node_ids(self) -> list[str]:
        return [n[0] for n in self.nodes]

    def __repr__(self) -> str:
        return f"Definition(revision={self.revision}, nodes={len(self.nodes)}, edges={len(self.edges)})"

    def has_node(self, node_id: str) -> bool:
        return node_id in self.node_ids

    def each_node(self) -> Iterator[str]:
        return iter(self.node_ids)

    def each_edge(self) -> Iterator[tuple[str, str, dict]]:
        return iter(self.edges)

    def each_predecessor(self, node_id: str) -> Iterator[str]:
        return iter(sorted(a for a, b, _ in self.edges if b == self._known(node_id)))

    def each_successor(self, node_id: str) -> Iterator[str]:
        return iter(sorted(b for a, b, _ in self.edges if a == self._known(node_id)))

    def _known(self, node_id: str) -> str:
        if node_id not in self.node_ids:
            raise UnknownNodeError(f"unknown node: {node_id}")
        return node_id

    def step_of(self, node_id: str) -> tuple[str, dict]:
        for n, kind, config in self.nodes:
            if n == node_id:
                return kind, config
        raise UnknownNodeError(f"unknown node: {node_id}")

    def _local(self) -> _Local:
        nodes = pd.DataFrame({"node_id": self.node_ids, "ord": range(len(self.nodes))})
        weights = [e[2].get("weight", 1) for e in self.edges]
        return _Local(nodes, pd.DataFrame({"src": [e[0] for e in self.edges], "dst": [e[1] for e in self.edges], "weight": pd.Series(weights, dtype="float64")}))

    def predecessors(self) -> dict[str, list[str]]:
        """Direct predecessors of every node, sorted."""
        found: dict[str, list[str]] = {n: [] for n in self.node_ids}
        for src, dst, _ in self.edges:
            found[dst].append(src)
        return {n: sorted(p) for n, p in found.items()}

    def successors(self) -> dict[str, list[str]]:
        """Direct successors of every node, sorted."""
        found: dict[str, list[str]] = {n: [] for n in self.node_ids}
        for src, dst, _ in self.edges:
            found[src].append(dst)
        return {n: sorted(s) for n, s in found.items()}

    def topological_order(self) -> list[str]:
        g = self._local()
        return [g.names[i] for i in g.order()]

    def descendants_of(self, node_id: str, include_self: bool = True) -> set[str]:
        self._known(node_id)
        g = self._local()
        return set(g.names[g.reach([g.index[node_id]])]) - (set() if include_self else {node_id})

    def _around(self, node_id: str) -> set[str]:
        """What the roots reach without passing a node."""
        self._known(node_id)
        g = self._local()
        return set(g.names[g.reach([i for i in range(len(g.names)) if g.degree[i] == 0], closed=g.index[node_id])])

    def exclusive_descendants_of(self, node_id: str, include_self: bool = True) -> set[str]:
        return self.descendants_of(node_id, include_self) - self._around(node_id)

    def shared_descendants_of(self, node_id: str) -> set[str]:
        return self.descendants_of(node_id) & self._around(node_id)

    def to_dict(self) -> dict:
        return {
            "revision": self.revision,
            "nodes": [{"id": n, "type": t, "config": c} for n, t, c in sorted(self.nodes, key=lambda x: x[0])],
            "edges": [{"from": a, "to": b, **({"metadata": m} if m else {})} for a, b, m in sorted(self.edges, key=lambda x: x[:2])],
        }

    def to_row(self) -> dict:
        """As to_dict but in insertion order, for storage."""
        return {"revision": self.revision, "nodes": [list(n) for n in self.nodes], "edges": [list(e) for e in self.edges]}

    @classmethod
    def from_row(cls, row: dict) -> Definition:
        return cls(tuple((n, t, c) for n, t, c in row["nodes"]), tuple((a, b, m) for a, b, m in row["edges"]), row["revision"])

    def fingerprint(self) -> str:
        return hashlib.sha256(V.dump(self.to_dict()).encode()).hexdigest()

    def graph(self, spark: SparkSession, graph_id: str = "g") -> Graph:
        return Graph.literal(spark, self.node_ids, [(a, b, m.get("weight", 1)) for a, b, m in self.edges], graph_id)


@dataclass(frozen=True)
class RuntimeProfile:
    durability: str = "ephemeral"
    max_attempts_per_node: int = 3
    max_workflow_retries: int = 0
    event_bus_kind: str = "null"
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        V.one_of(self.durability, DURABILITIES, "durability")
        V.positive_int(self.max_attempts_per_node, "max_attempts_per_node")
        V.nonneg_int(self.max_workflow_retries, "max_workflow_retries")
        V.require_json_safe(self.metadata)


def sha256_of(value: Any) -> str:
    """Fingerprint of a value's canonical JSON."""
    return hashlib.sha256(V.dump(value).encode()).hexdigest()


@dataclass(frozen=True)
class Ports:
    """What a store and a runner take from outside: ids of attempts (None: workflow and number),
    fingerprints of payloads, and the text form of dynamic values. Bulk queries over stored values
    expect JSON."""

    new_id: Callable[[], str] | None = None
    fingerprint: Callable[[Any], str] = sha256_of
    dump: Callable[[Any], str] = V.dump
    load: Callable[[str], Any] = V.load

    def __post_init__(self) -> None:
        V.all_given({"fingerprint": self.fingerprint, "dump": self.dump, "load": self.load}, "Ports")


@dataclass(frozen=True)
class Intent:
    type: str
    key: str
    payload: Any = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        V.ref_part(self.type, "type")
        V.ref_part(self.key, "key")
        V.require_json_safe(self.payload)
        V.require_json_safe(self.metadata)

    @property
    def ref(self) -> str:
        return f"{self.type}:{self.key}"

    @property
    def payload_fingerprint(self) -> str:
        return sha256_of(self.payload)


@dataclass(frozen=True)
class PreparedIntent:
    """An intent with the place it came from: blocking if the attempt waits for it."""

    intent: Intent
    workflow_id: str
    revision: int
    node_id: str
    attempt_id: str
    blocking: bool
    created_at_ms: int
    payload_fingerprint: str

    def __post_init__(self) -> None:
        V.expect(self.intent, Intent, "intent")
        V.nonempty(self.workflow_id, "workflow_id")
        V.revision_number(self.revision)
        V.node_name(self.node_id)
        V.nonempty(self.attempt_id, "attempt_id")
        V.expect(self.blocking, "boolean", "blocking")
        V.nonneg_int(self.created_at_ms, "created_at_ms")
        V.nonempty(self.payload_fingerprint, "payload_fingerprint")

    @classmethod
    def of(cls, intent: Intent, result_kind: str, created_at_ms: int, ports: Ports, **place: Any) -> PreparedIntent:
        return cls(intent, blocking=result_kind == "waiting", created_at_ms=created_at_ms, payload_fingerprint=ports.fingerprint(intent.payload), **place)

    @property
    def place(self) -> dict:
        return {"workflow_id": self.workflow_id, "revision": self.revision, "node_id": self.node_id, "attempt_id": self.attempt_id}

    def record(self, id: str, effect_seq: int, ports: Ports) -> dict:
        """The row of a newly reserved effect."""
        i, at = self.intent, self.created_at_ms
        return {
            "id": id, "effect_seq": effect_seq, "ref": i.ref, **self.place, "type": i.type, "key": i.key, "payload": ports.dump(i.payload),
            "payload_fingerprint": self.payload_fingerprint, "blocking": self.blocking, "status": "reserved", "result": None, "error": None, "external_ref": None,
            "not_before_ms": None, "lease_owner": None, "lease_until_ms": None, "created_at_ms": at, "updated_at_ms": at, "metadata": ports.dump(i.metadata),
        }


@dataclass(frozen=True)
class Mutation:
    kind: str
    target: str
    replacement: Definition | None = None
    entries: tuple[str, ...] = ()
    exits: tuple[str, ...] = ()
    rationale: str | None = None

    def __post_init__(self) -> None:
        V.one_of(self.kind, MUTATION_KINDS, "mutation kind")
        if (self.kind == "replace_subtree") != (self.replacement is not None):
            raise ValueError(f"{self.kind} {'needs a' if self.replacement is None else 'takes no'} replacement")
        if self.replacement is not None:
            for x in (*self.entries, *self.exits):
                if x not in self.replacement.node_ids:
                    raise ValueError(f"unknown node: {x}")
            if not self.entries or not self.exits:
                raise ValueError("a replacement needs entry and exit nodes")


def _all_of(values: Any, kind: type, name: str) -> None:
    for x in V.expect(values, "array", name):
        V.expect(x, kind, f"each of {name}")


@dataclass(frozen=True)
class Success:
    value: Any = None
    context_patch: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    effects: tuple[Intent, ...] = ()
    mutations: tuple[Mutation, ...] = ()
    kind = "success"

    def __post_init__(self) -> None:
        V.expect(self.context_patch, "mapping", "context_patch")
        _all_of(self.effects, Intent, "effects")
        _all_of(self.mutations, Mutation, "mutations")

    def and_then(self, f: Callable[[Any], Result]) -> Result:
        return checked(f(self.value))

    def map(self, f: Callable[[Any], Any]) -> Success:
        return replace(self, value=f(self.value))

    def recover(self, f: Callable[[Any], Result]) -> Result:
        return self

    def unwrap(self) -> Any:
        return self.value


@dataclass(frozen=True)
class Waiting:
    reason: str = "waiting"
    resume_token: str | None = None
    not_before_ms: int | None = None
    effects: tuple[Intent, ...] = ()
    metadata: dict = field(default_factory=dict)
    kind = "waiting"

    def __post_init__(self) -> None:
        V.expect(self.reason, "string", "reason")
        V.expect(self.resume_token, "string", "resume_token", optional=True)
        V.expect(self.not_before_ms, "integer", "not_before_ms", optional=True)
        _all_of(self.effects, Intent, "effects")

    @classmethod
    def at(cls, seconds: float, **rest: Any) -> Waiting:
        return cls(not_before_ms=int(seconds * 1000), **rest)


@dataclass(frozen=True)
class Failure:
    error: Any
    retriable: bool = False
    metadata: dict = field(default_factory=dict)
    kind = "failure"

    def and_then(self, f: Callable[[Any], Result]) -> Result:
        return self

    def map(self, f: Callable[[Any], Any]) -> Failure:
        return self

    def recover(self, f: Callable[[Any], Result]) -> Result:
        return checked(f(self.error))

    def unwrap(self) -> Any:
        raise ValueError(f"no success: {self.error!r}")


Result = Success | Waiting | Failure


def checked(value: Any) -> Result:
    if not isinstance(value, Success | Waiting | Failure):
        raise TypeError(f"not a result: {type(value).__name__}")
    return value


def attempt(f: Callable[[], Any], code: str = "exception") -> Result:
    """Success of f(), or a Failure that tells the exception."""
    try:
        return Success(f())
    except Exception as e:
        return Failure({"code": code, "message": str(e), "error_class": type(e).__name__})


def result_row(r: Result, dump: Callable[[Any], str] = V.dump) -> dict:
    """The stored form of a result; dynamic leaves are text, canonical JSON by default."""
    return {
        "kind": r.kind,
        "value": dump(r.value) if isinstance(r, Success) else None,
        "context_patch": {str(k): dump(v) for k, v in r.context_patch.items()} if isinstance(r, Success) else None,
        "metadata": dump(r.metadata),
        "error": dump(r.error) if isinstance(r, Failure) else None,
        "retriable": r.retriable if isinstance(r, Failure) else None,
        "reason": r.reason if isinstance(r, Waiting) else None,
        "resume_token": r.resume_token if isinstance(r, Waiting) else None,
        "not_before_ms": r.not_before_ms if isinstance(r, Waiting) else None,
    }


@dataclass(frozen=True)
class StepInput:
    context: dict
    node_id: str
    attempt_number: int
    metadata: dict

    @property
    def runtime_snapshot(self) -> RuntimeSnapshot:
        """What a step may read of the run around it."""
        own = ("workflow_id", "revision", "attempt_id", "predecessors", "effects")
        rest = {k: v for k, v in self.metadata.items() if k not in own}
        return RuntimeSnapshot(**{k: self.metadata[k] for k in own}, node_id=self.node_id, attempt_number=self.attempt_number, metadata=rest)


@dataclass(frozen=True)
class RuntimeSnapshot:
    workflow_id: str
    revision: int
    node_id: str
    attempt_id: str
    attempt_number: int
    predecessors: dict = field(default_factory=dict)
    effects: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        V.nonempty(self.workflow_id, "workflow_id")
        V.revision_number(self.revision)
        V.node_name(self.node_id)
        V.nonempty(self.attempt_id, "attempt_id")
        V.positive_int(self.attempt_number, "attempt_number")
        for name in ("predecessors", "effects", "metadata"):
            V.require_json_safe(V.expect(getattr(self, name), "mapping", name))

    @property
    def plan_version(self) -> tuple[str, int]:
        """(workflow, revision): what the attempt was planned under."""
        return self.workflow_id, self.revision


@dataclass(frozen=True)
class HandlerResult:
    status: str  # succeeded, failed_retriable, failed_terminal
    result: Any = None
    external_ref: str | None = None
    error: Any = None
    not_before_ms: int | None = None

    @classmethod
    def succeeded(cls, result: Any = None, external_ref: str | None = None) -> HandlerResult:
        return cls("succeeded", V.require_json_safe(result), external_ref)

    @classmethod
    def failed(cls, error: Any, retriable: bool = False, not_before_ms: int | None = None) -> HandlerResult:
        if not_before_ms is not None and not retriable:
            raise ValueError("only a retriable failure has a not_before_ms")
        return cls("failed_retriable" if retriable else "failed_terminal", error=V.require_json_safe(error), not_before_ms=not_before_ms)

    @property
    def terminal(self) -> bool:
        return self.status in TERMINAL_EFFECT_STATUSES


def await_effect(step: StepInput, intent: Intent, then: Callable[[Any], Result], not_before_ms: int | None = None) -> Result:
    """Wait for an effect: its result goes to `then`; a terminal failure fails the step."""
    seen = step.metadata["effects"].get(intent.ref)
    if seen and seen["status"] == "succeeded":
        return checked(then(seen["result"]))
    if seen and seen["status"] == "failed_terminal":
        return Failure({"code": "effect_failed", "ref": intent.ref, "error": seen["error"]})
    return Waiting(reason="effect_pending", not_before_ms=not_before_ms, effects=(intent,))
