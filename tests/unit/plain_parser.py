"""A plain line machine, to hold the folds against."""

from __future__ import annotations

import re

from tests.unit import plain_latex as latex
from vellum.functions.rules import DEPTHS, INCLUDE, LEVELS
from vellum.operators.latex_lines import BLOCKS, FLUSH_LINES, LISTS, MATH
from vellum.operators.latex_tree import Node, pad_headings


class _Math:
    """Where display math begins and ends in a line."""

    @staticmethod
    def closes(kind: str, line: str) -> int | None:
        """Where the text behind the math begins, if it ends here."""
        if kind == "$$":
            n = line.count("$$")
            return line.rfind("$$") + 2 if n and (n % 2 or line.rstrip().endswith("$$")) else None
        if kind == "\\[":
            return line.rfind("\\]") + 2 if "\\]" in line else None
        end = re.search(rf"\\end\{{{re.escape(kind)}\}}", line)
        return end.end() if end else None


class LatexParser:
    """Reads the lines of texts made ready by functions.tex, in order; what is tried first decides. level_aware gives headings
    their nearest higher heading as parent, instead of the original rule, which cuts the stack of open headings to a length."""

    def __init__(self, files: dict[str, str], main: str, title: str | None = None, level_aware: bool = False):
        self.files, self.main, self.level_aware = files, main, level_aware
        self.root, self.done = Node("document", title=title), set()
        self.stack: list[tuple[int, Node]] = [(0, self.root)]

    def parse(self) -> Node:
        self._file(self.main, False, ())
        for name in self.files:
            if name not in self.done:
                self._file(name, True, ())
        pad_headings(self.root)
        return self.root

    @property
    def top(self) -> Node:
        return self.stack[-1][1]

    def _open(self, level: str, title: str) -> None:
        if self.level_aware:
            while len(self.stack) > 1 and self.stack[-1][0] >= LEVELS[level]:
                self.stack.pop()
        else:
            del self.stack[DEPTHS[level] :]
        self.stack.append((LEVELS[level], self.top.add(level, title=title)))

    def _flush(self, text: list[str]) -> None:
        for i in range(0, len(text), FLUSH_LINES):
            self.top.add_sentences(" ".join(text[i : i + FLUSH_LINES]))
        text.clear()

    def _included(self, name: str) -> str | None:
        name = latex.file_name(name)
        if name not in self.files:
            name = re.split(r"\\", name)[-1] if "\\" in name else name.rsplit("/", 1)[-1]
        return name if name in self.files else None

    def _file(self, name: str, inside: bool, chain: tuple[str, ...]) -> None:
        if name in chain or name not in self.files:
            return
        self.done.add(name)
        text: list[str] = []
        block: list[str] = []
        env: str | None = None  # list or listing
        math: str | None = None
        area: str | None = None  # figure or table
        for line in map(str.strip, self.files[name].splitlines()):
            if not line:
                self._flush(text)
                continue
            if name == self.main and not inside:
                inside = bool(re.search(r"\\begin\{document\}", line))
                continue
            if name == self.main and re.search(r"\\end\{document\}", line):
                break
            if found := latex.heading(line):
                self._flush(text)
                self._open(found[0], found[1])
                self.top.add_sentences(found[2])
                continue
            if names := re.findall(INCLUDE, line):
                self._flush(text)
                for inner in filter(None, map(self._included, names)):
                    self._file(inner, inside, (*chain, name))
                continue
            if env:
                block.append(line)
                if re.search(rf"\\end\{{{env}\}}", line):
                    self._block(env, block)
                    block, env = [], None
                continue
            if m := re.search(BLOCKS, line):
                self._flush(text)
                if re.search(rf"\\end\{{{m[1]}\}}", line):
                    self.top.add(self._type(m[1]), content=line)
                else:
                    env, block = m[1], [line]
                continue
            if math:
                block.append(line)
                if (end := _Math.closes(math, line)) is not None:
                    self.top.add("math", content="\n".join(block))
                    self.top.add_sentences(line[end:].strip())
                    block, math = [], None
                continue
            if line.count("$$") >= 2:
                self._flush(text)
                _, inner, rest = line.split("$$", 2)
                self.top.add("math", content=f"$${inner}$$")
                self.top.add_sentences(rest.strip())
                continue
            begin = "$$" if "$$" in line else "\\[" if line.startswith("\\[") else m[1] if (m := re.search(rf"\\begin\{{((?:{MATH})\*?)\}}", line)) else None
            if begin:
                self._flush(text)
                end = None if begin == "$$" else _Math.closes(begin, line)
                if end is None:
                    math, block = begin, [line]
                else:
                    self.top.add("math", content=line)
                    self.top.add_sentences(line[end:].strip())
                continue
            if area is None and (m := re.search(r"\\begin\{(figure|table)\*?\}", line)):
                self._flush(text)
                area, block = m[1], []
            if area:
                block.append(line)
                if re.search(rf"\\end\{{{area}\*?\}}", line):
                    self.top.add(area, content="\n".join(block))
                    area, block = None, []
                continue
            text.append(line)
        self._flush(text)

    @staticmethod
    def _type(env: str) -> str:
        return env if env in LISTS else "listing"

    def _block(self, env: str, block: list[str]) -> None:
        if env not in LISTS:
            self.top.add("listing", content="\n".join(block))
            return
        items = "\n".join(block).split("\\item")[1:]
        if not items:
            raise ValueError(f"{env} without items")
        items[-1] = items[-1].split(f"\\end{{{env}}}")[0]
        node, text, math, held = Node(env), [], None, []

        def flush() -> None:
            node.add_sentences(" ".join(text).strip())
            text.clear()

        for line in (x.strip() for item in items for x in item.splitlines()):
            if math:
                held.append(line)
                if (end := _Math.closes(math, line)) is not None:
                    node.add("math", content="\n".join(held))
                    node.add_sentences(line[end:].strip())
                    math, held = None, []
                continue
            if line.count("$$") >= 2:
                flush()
                _, inner, rest = line.split("$$", 2)
                node.add("math", content=f"$${inner}$$")
                node.add_sentences(rest.strip())
                continue
            begin = "$$" if "$$" in line else "\\[" if line.startswith("\\[") else m[1] if (m := re.search(rf"\\begin\{{((?:{MATH})\*?)\}}", line)) else None
            if begin is None:
                text.append(line)
                continue
            flush()
            if begin != "$$" and (end := _Math.closes(begin, line)) is not None:
                node.add("math", content=line)
                node.add_sentences(line[end:].strip())
            else:
                math, held = begin, [line]
        flush()
        self.top.children.append(node)
