"""Expressions as pictures and formulas."""

from __future__ import annotations

import shutil
import subprocess
from collections import Counter
from collections.abc import Callable

from ..operators import nodes as N
from ..operators.base import Operator, OperatorError


def _numbered(op: Operator) -> list[tuple[Operator, str, int, int]]:
    """Nodes from left to right, a node before its children: node, kind, number among its kind, place of its parent (-1)."""
    out, counts, todo = [], Counter(), [(op, -1)]
    while todo:
        node, parent = todo.pop()
        kind = type(node).__name__
        counts[kind] += 1
        out.append((node, kind, counts[kind], parent))
        todo += [(c, len(out) - 1) for c in reversed(node.children)]
    return out


def _labelled(node: Operator, text: str, labels: dict[str, Callable[[Operator], object]]) -> str:
    for key, f in labels.items():
        try:
            text += f"\\n{key} = {f(node)}"
        except Exception:  # noqa: BLE001, S112  labels are decoration
            continue
    return text


def dot_string(op: Operator, labels: dict[str, Callable[[Operator], object]] | None = None) -> str:
    """Graphviz text; nodes are numbered by kind. A label function that fails for a node is left out there.
    A node's line stands before its subtree, the edge to it behind."""
    nodes = _numbered(op)
    name = [f"{kind}_{n}" for _, kind, n, _ in nodes]
    lines, open_ = [], []  # open_: nodes whose subtree is not through, outermost first
    for k, (node, kind, n, parent) in enumerate([*nodes, (None, "", 0, -2)]):
        while open_ and open_[-1] != parent:
            done = open_.pop()
            if open_:
                lines.append(f"{name[open_[-1]]} -> {name[done]};")
        if node is not None:
            lines.append(f'{name[k]} [label="{_labelled(node, f"{kind} #{n}", labels or {})}"];')
            open_.append(k)
    return "digraph g {\n" + "".join(f"\t{line}\n" for line in lines) + "}"


def plot_operator_graph(op: Operator, name: str | None = None, ext: str = "svg", program: str = "dot", **options) -> str:
    """Draw with the program ``dot``, if there is one; the name of the file written."""
    if not shutil.which(program):
        raise OperatorError(f"drawing needs the program {program!r}")
    path = f"{name or type(op).__name__}.{ext}"
    subprocess.run([program, "-T", ext, "-o", path], input=dot_string(op, **options).encode(), check=True)  # noqa: S603, S607
    return path


def latex_string(op: Operator) -> str:
    if isinstance(op, N.Adjoint):
        inner = latex_string(op.op)
        return rf"({inner})^\top" if op.op.location == "internal" else rf"{inner}^\top"
    if isinstance(op, (N.Compose, N.Kron)):
        sign = r"\otimes" if isinstance(op, N.Kron) else r"\ast" if op.linearity == "linear" else r"\circ"
        parts = [f"({latex_string(c)})" if c.location == "internal" else latex_string(c) for c in op.children]
        return parts[0] + "".join(sign + ("" if p[0] == "(" else " ") + p for p in parts[1:])
    return rf"\mathrm{{{type(op).__name__}}}({op.domain} \rightarrow {op.range})"
