"""Expressions as JSON text: structure only, no parameter values. Ranges and orders count from 1 on the wire."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from ..operators import leaves as L
from ..operators import nodes as N
from ..operators.base import Operator, OperatorError

# Names of element types and operators on the wire.
TYPE_TAGS = {"f16": "Float16", "f32": "Float32", "f64": "Float64", "c16": "ComplexF16", "c32": "ComplexF32", "c64": "ComplexF64"}
ADJOINT, COMPOSE, FOURIER, DIAGONAL, IDENTITY, KRON, MATRIX, RESTRICTION, TENSOR = "ParAdjoint", "ParCompose", "ParDFT", "ParDiagonal", "ParIdentity", "ParKron", "ParMatrix", "ParRestriction", "ParTensor"

_TYPES_BY_TAG = {v: k for k, v in TYPE_TAGS.items()}


def _uuid(op_id: str) -> bool:
    try:
        return str(uuid.UUID(op_id)) == op_id
    except ValueError:
        return False


def encode(op: Operator) -> dict:
    """``op`` as nested dictionaries. Bound values and physical wrappers have no form on the wire."""
    typed = {"T": TYPE_TAGS[op.ddt]} if not op.children else {}
    if hasattr(op, "op_id"):
        typed["id"] = f"UUID:{op.op_id}" if _uuid(op.op_id) else op.op_id
    match op:
        case L.Identity():
            return {"type": IDENTITY, "n": op.n, **typed}
        case L.Diagonal():
            return {"type": DIAGONAL, "n": op.n, **typed}
        case L.Matrix():
            return {"type": MATRIX, "m": op.m, "n": op.n, **typed}
        case L.Fourier():
            return {"type": FOURIER, "n": op.n, "m": op.range, **typed, **({"norm": op.norm} if op.norm != "backward" else {})}
        case L.Restriction():
            return {"type": RESTRICTION, "n": op.n, "ranges": [[a + 1, b] for a, b in op.ranges], **typed, **({"accumulate": True} if op.accumulate else {})}
        case L.Tensor():
            return {"type": TENSOR, "wo": list(op.weight_axes), "ws": list(op.weight_shape), "io": list(op.input_axes), "is": list(op.input_shape), "to": list(op.target_axes), "ts": list(op.target_shape), **typed}
        case N.Adjoint():
            return {"type": ADJOINT, "of": encode(op.op)}
        case N.Compose():
            return {"type": COMPOSE, "of": [encode(o) for o in op.ops]}
        case N.Kron():
            return {"type": KRON, "of": [encode(o) for o in op.ops], "order": [k + 1 for k in op.order]}
    raise OperatorError(f"{type(op).__name__} has no JSON form")


def _dtype(d: dict) -> str:
    tag = d.get("T")
    if tag not in _TYPES_BY_TAG:
        raise OperatorError(f"unknown element type {tag!r}")
    return _TYPES_BY_TAG[tag]


def _id(d: dict) -> str:
    return str(d["id"]).removeprefix("UUID:")


def _fourier(d: dict) -> Operator:
    op = L.Fourier(d["n"], _dtype(d), d.get("norm", "backward"))
    if "m" in d and d["m"] != op.range:
        raise OperatorError(f"the output length is {op.range}, not {d['m']}")
    return op


def _tensor(d: dict) -> Operator:
    axes = lambda k: tuple(map(str, d[k]))
    return L.Tensor(axes("wo"), tuple(d["ws"]), axes("io"), tuple(d["is"]), axes("to"), tuple(d["ts"]), _id(d), _dtype(d))


_DECODERS: dict[str, Callable[[dict], Operator]] = {
    IDENTITY: lambda d: L.Identity(d["n"], _dtype(d)),
    DIAGONAL: lambda d: L.Diagonal(d["n"], _id(d), _dtype(d)),
    MATRIX: lambda d: L.Matrix(d["m"], d["n"], _id(d), _dtype(d)),
    FOURIER: _fourier,
    RESTRICTION: lambda d: L.Restriction(d["n"], tuple((a - 1, b) for a, b in d["ranges"]), _dtype(d), d.get("accumulate", False)),
    TENSOR: _tensor,
    ADJOINT: lambda d: N.Adjoint(decode(d["of"])),
    COMPOSE: lambda d: N.composed(map(decode, d["of"])),
    KRON: lambda d: N.Kron(tuple(map(decode, d["of"])), tuple(k - 1 for k in d["order"])),
}


def decode(d: dict) -> Operator:
    if "type" not in d:
        raise OperatorError("an operator needs the key 'type'")
    if d["type"] not in _DECODERS:
        raise OperatorError(f"unknown operator {d['type']!r}")
    return _DECODERS[d["type"]](d)


def to_json(op: Operator) -> str:
    return json.dumps(encode(op))


def from_json(text: str) -> Operator:
    return decode(json.loads(text))


__all__ = ["decode", "encode", "from_json", "to_json"]
