"""Nodes of a parsed text, and their rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from vellum.functions import latex


@dataclass
class Node:
    node_type: str
    title: str | None = None
    label: str | None = None
    content: str | None = None
    children: list[Node] = field(default_factory=list)

    def add(self, node_type: str, **values: str | None) -> Node:
        self.children.append(Node(node_type, **values))
        return self.children[-1]

    def add_sentences(self, text: str) -> None:
        for s in latex.sentences(text):
            self.add("sentence", content=s)


def pad_headings(node: Node) -> None:
    """Headings without content get an empty sentence; by the original rule not sections and appendices."""
    todo = [node]
    while todo:
        at = todo.pop()
        if at.node_type in ("part", "chapter", "subsection", "subsubsection") and not at.children:
            at.add("sentence", content="")
        todo += at.children


def node_rows(root: Node) -> list[tuple]:
    """(preorder, parent_preorder, depth, subtree_end, node_type, title, label, content) of all nodes; a subtree ends where
    the next node begins that is no deeper than its root."""
    rows, todo = [], [(root, None, 0)]
    while todo:
        node, parent, depth = todo.pop()
        rows.append((len(rows), parent, depth, node))
        todo += [(c, len(rows) - 1, depth + 1) for c in reversed(node.children)]
    ends, open_rows = [len(rows)] * len(rows), []
    for at, _, depth, _ in rows:
        while open_rows and rows[open_rows[-1]][2] >= depth:
            ends[open_rows.pop()] = at
        open_rows.append(at)
    return [(at, parent, depth, ends[at], n.node_type, n.title, n.label, n.content) for at, parent, depth, n in rows]
