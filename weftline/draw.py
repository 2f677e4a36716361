"""Workflows as pictures: a table of shapes and a table of arrows, written in Graphviz's language.

A step is a frame that holds a card with its name and inputs, and a pill for each value it makes. Values
that were given stand outside as notes. Arrows run from a value to the card that reads it. A value that
stands for another one points at it with a dashed line.
"""

from __future__ import annotations

import html
from collections.abc import Iterable
from dataclasses import dataclass, field

from weftline.flow import Flow
from weftline.model import ArtefactStatus, How

#: Fill and border by what is known of a value.
PAINT = {
    ArtefactStatus.done: ("#e3f4e1", "#3a7d34"),
    ArtefactStatus.const: ("#eef1f6", "#5b6b85"),
    ArtefactStatus.error: ("#fbe3e1", "#b3372c"),
    ArtefactStatus.linked: ("#efe6f7", "#7a4ea3"),
}
UNKNOWN = ("#ffffff", "#9a9a9a")
#: Characters of a hash, and of a name, that are shown.
HASH, NAME = 6, 60


@dataclass(frozen=True)
class Shape:
    """A value or a step. owner: the step that makes the value, or None for one that was given."""

    id: str
    text: str
    owner: str | None = None
    status: ArtefactStatus | None = None
    reads: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()


@dataclass
class Outline:
    steps: dict[str, Shape] = field(default_factory=dict)
    values: dict[str, Shape] = field(default_factory=dict)
    #: (value, step, name of the input)
    reads: list[tuple[str, str, str]] = field(default_factory=list)
    #: (value, the value it stands for)
    aliases: list[tuple[str, str]] = field(default_factory=list)


def _add_value(out: Outline, flow: Flow, hash: str, name: str, owner: str | None) -> None:
    if hash not in out.values:
        out.values[hash] = Shape(hash, name, owner, flow.status(hash, resolve=False))
        if out.values[hash].status is ArtefactStatus.linked:
            out.aliases.append((hash, flow.resolve(hash)))


def outline(flow: Flow, targets: Iterable[str]) -> Outline:
    """What the targets need, with the steps that unfolded at run time."""
    starts = [n for t in targets if (n := flow.nearest(t)) is not None]
    out = Outline()
    for n in sorted({*starts, *flow.ancestors(*starts, subdags=True)}):
        op = flow.operation(n)
        function = flow.function_of(op)
        notes = ["lax"] if function.error_tolerant else []
        notes += ["unfolds"] if function.how is How.subdag else []
        out.steps[n] = Shape(n, function.what, reads=tuple(op.inp), notes=tuple(notes))
        for name, h in op.out.items():
            _add_value(out, flow, h, name, n)
        for name, h in op.inp.items():
            out.reads.append((h, n, name))
    for h, _, name in out.reads:
        _add_value(out, flow, h, name, flow.nearest(h))
    for _, h in list(out.aliases):
        _add_value(out, flow, h, "value", flow.nearest(h))
    return out


def _short(name: str) -> str:
    """A name as text of a label: without the scope of a nested function, and not too long."""
    name = name.replace("<locals>.", "")
    return html.escape(name if len(name) <= NAME else name[: NAME - 1] + "…")


def _attributes(**pairs: str) -> str:
    return " ".join(f"{k}={v}" if v.startswith("<") else f'{k}="{v}"' for k, v in pairs.items())


def _value(shape: Shape) -> str:
    fill, line = PAINT.get(shape.status, UNKNOWN)
    text = f"<<b>{_short(shape.text)}</b><br/>{shape.id[:HASH]}>"
    form = {"shape": "note", "style": "filled"} if shape.owner is None else {"shape": "box", "style": "rounded,filled"}
    return f'"v{shape.id}" [{_attributes(label=text, fillcolor=fill, color=line, **form)}];'


def _card(step: Shape) -> str:
    rows = [f'<tr><td bgcolor="#f7f3e8"><b>{_short(step.text)}</b></td></tr>', f"<tr><td>{step.id[:HASH]}{''.join(f', {x}' for x in step.notes)}</td></tr>"]
    rows += [f'<tr><td align="left" port="i{i}">{_short(name)}</td></tr>' for i, name in enumerate(step.reads)]
    return f'"s{step.id}" [{_attributes(shape="plain", label=f"<<table border={chr(34)}0{chr(34)} cellborder={chr(34)}1{chr(34)} cellspacing={chr(34)}0{chr(34)}>{chr(32).join(rows)}</table>>")}];'


def to_dot(drawing: Outline, given: bool = True) -> str:
    """The drawing as a digraph; without ``given``, values that no step makes are left out."""
    shown = {h for h, v in drawing.values.items() if given or v.owner is not None}
    lines = ["digraph workflow {", '  graph [rankdir="TB" fontname="sans-serif" compound="true"];', '  node [fontname="sans-serif" fontsize="11"];', '  edge [fontname="sans-serif" fontsize="9" color="#5f5f5f"];']
    for n, step in drawing.steps.items():
        made = [v for v in drawing.values.values() if v.owner == n]
        lines += [f'  subgraph "cluster_{n}" {{', '    style="rounded"; color="#c9c2ae";', f"    {_card(step)}"]
        lines += [f"    {_value(v)}" for v in made]
        lines += [f'    "s{n}" -> "v{v.id}" [arrowhead="none"];' for v in made]
        lines.append("  }")
    lines += [f"  {_value(v)}" for v in drawing.values.values() if v.id in shown and v.owner not in drawing.steps]
    for h, n, name in drawing.reads:
        if h in shown:
            lines.append(f'  "v{h}" -> "s{n}":"i{drawing.steps[n].reads.index(name)}";')
    lines += [f'  "v{h}" -> "v{to}" [style="dashed" label="is"];' for h, to in drawing.aliases if h in shown and to in shown]
    return "\n".join([*lines, "}"])
