"""Plain versions of the rules on whole texts, to hold the Columns against."""

from __future__ import annotations

import re
from collections.abc import Iterator

from vellum.functions.rules import ABBREVIATIONS, DECLARATIONS, DEFINERS, INCLUDE, TITLES, WRAPPERS, applied

_COMMAND = re.compile(r"\\([A-Za-z@]+)")
_PROTECT = tuple((rf"(?i)\b{words}\.\s", r"\1<DOT> ") for words in ABBREVIATIONS)


def balanced(text: str, start: int) -> int | None:
    """Where the brace that opens at `start` closes; a backslash hides the letter behind it."""
    if text[start : start + 1] != "{":
        return None
    depth, at = 0, start
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at
        at += 1
    return None


class Reader:
    """A place in a text, moved over what TeX reads as one thing. What isn't there moves nothing and gives None."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def spaces(self) -> Reader:
        while self.text[self.at : self.at + 1].isspace():
            self.at += 1
        return self

    def option(self) -> str | None:
        """What stands in brackets, up to the first closing one."""
        end = self.text.find("]", self.at) if self.text.startswith("[", self.spaces().at) else -1
        if end < 0:
            return None
        found, self.at = self.text[self.at + 1 : end], end + 1
        return found

    def group(self) -> str | None:
        end = balanced(self.text, self.spaces().at)
        if end is None:
            return None
        found, self.at = self.text[self.at + 1 : end], end + 1
        return found

    def name(self) -> str | None:
        found = _COMMAND.match(self.text, self.spaces().at)
        if not found:
            return None
        self.at = found.end()
        return found[1]


def commands(tex: str, names: tuple[str, ...] | frozenset[str]) -> Iterator[Reader]:
    """A reader behind each command of these names."""
    return (Reader(tex, m.end()) for m in _COMMAND.finditer(tex) if m[1] in names)


def strip_comments(text: str) -> str:
    """The rules of functions.text.strip_comments, for texts that are parsed here anyway."""
    return "".join(map(_without_comment, text.splitlines(keepends=True)))


def _without_comment(line: str) -> str:
    if "%" not in line:
        return line
    if line[0] == "%":
        return ""
    feed, at = "\n" if line.endswith("\n") else "", line.find("%")
    while at > 0:
        slashes = 2 if line[max(0, at - 2) : at] == "\\\\" else 1 if line[at - 1] == "\\" else 0
        if slashes != 1:
            return line[: at - slashes // 2] + feed  # of two backslashes one is lost
        at = line.find("%", at + 1)
    return line + feed


def find_title(tex: str) -> str | None:
    """The argument of the first title command that has one, on one line, without conditionals and spacing."""
    for reader in commands(strip_comments(tex), TITLES):
        reader.option()
        if reader.spaces().text.startswith("{", reader.at):
            title = reader.group()
            tidy = applied((title or "").replace("\\\\", " ").replace("\n", " "), ((r"\s{2,}", " "), (r"\\(?:if|fi|vspace)[A-Za-z]*\{*[\w\-.]*\}*", "")))
            return tidy.strip() or None
    return None


def _definition(reader: Reader, braced: bool) -> tuple[str, str] | None:
    """Name and body behind a definer, if the macro takes no argument and its body isn't empty."""
    if braced:
        inner = Reader(reader.group() or "")
        name, count = inner.name(), None
        if inner.at != len(inner.text) or inner.text[:1] != "\\":
            return None
        count = reader.option()
    else:
        name, count = reader.name(), None
    body = (reader.group() or "").strip()
    return ("\\" + name, body) if name and body and count in (None, "0") else None


def zero_argument_macros(tex: str) -> dict[str, str]:
    """Bodies of macros without arguments; those by \\def and its kin come after, and so win over, those by \\newcommand and its."""
    clean = strip_comments(tex)
    return dict(found for names in DEFINERS for reader in commands(clean, names) if (found := _definition(reader, names is DEFINERS[0])))


def expand(tex: str, macros: dict[str, str], passes: int = 10) -> str:
    """Macros replaced by their bodies, longest names first, until nothing changes or `passes` are done."""
    if not macros:
        return tex
    names = sorted(macros, key=len, reverse=True)
    for _ in range(passes):
        before = tex
        for name in names:
            if name in tex:
                tex = re.sub(re.escape(name) + r"(?![A-Za-z@])", lambda _, body=macros[name]: body, tex)
        if tex == before:
            break
    return tex


def macro_map(texts: list[str]) -> dict[str, str]:
    """The macros of all texts, later ones winning, their bodies expanded by each other."""
    found = {name: body for text in texts for name, body in zero_argument_macros(text).items()}
    return dict(zip(found, (expand(body, found, 5) for body in found.values()), strict=True))


def remove_styles(tex: str) -> str:
    out, at = [], 0
    for m in re.finditer(r"\\([A-Za-z@]+)[ \t]*", tex):
        if m.start() < at:
            continue
        if m[1] in DECLARATIONS:
            out.append(tex[at : m.start()])
            at = m.end()
        elif m[1] in WRAPPERS and (end := balanced(tex, m.end())) is not None:
            out += (tex[at : m.start()], remove_styles(tex[m.end() + 1 : end]))
            at = end + 1
    return "".join(out) + tex[at:]


def reflow_headings(tex: str, fixed: bool = False) -> str:
    """Headings over several lines joined into one. As in the original rules nothing is done unless `fixed`."""
    if not fixed:
        return tex
    out, at = [], 0
    for m in re.finditer(r"\\(?:section|subsection|subsubsection|paragraph|appendix|chapter|part)\*?\s*\{", tex):
        end = balanced(tex, m.end() - 1)
        if end is not None and m.start() >= at:
            out += (tex[at : m.start()], re.sub(r"\s*\n\s*", " ", tex[m.start() : end + 1]))
            at = end + 1
    return "".join(out) + tex[at:]


def heading(line: str) -> tuple[str, str, str] | None:
    """(level, title, trailing text) of a line that begins with a heading."""
    line = line.lstrip()
    head = re.match(r"\\(section|subsection|subsubsection|paragraph|appendix|chapter|part)\*{0,2}\s*", line)
    if not head:
        return None
    at = head.end()
    if line[at : at + 1] == "[":
        depth = 0
        while at < len(line):
            depth += {"[": 1, "]": -1}.get(line[at], 0)
            at += 2 if line[at] == "\\" else 1
            if not depth:
                break
        while line[at : at + 1].isspace():
            at += 1
    end = balanced(line, at)
    return (head[1], line[at + 1 : end], line[end + 1 :].strip()) if end is not None else None


def file_name(name: str) -> str:
    name = name.strip()
    return name if name.endswith(".tex") else name + ".tex"


def includes(tex: str) -> list[str]:
    return [file_name(n) for n in re.findall(INCLUDE, strip_comments(tex))]


def _sets_up(line: str) -> bool:
    """Whether a line defines a macro, is a whole conditional or begins with a title."""
    head = re.match(r"\s*\\(\w+)", line)
    defines = head is not None and any(head[1] in names for names in DEFINERS)
    return defines or (line.startswith("\\if") and "\\fi" in line[3:]) or line.startswith(tuple("\\" + t for t in TITLES))


def prepared_lines(tex: str, macros: dict[str, str], fixed_headings: bool = False) -> list[str]:
    """Lines without comments, definitions and titles (empty lines in their place), macros expanded, styles unwrapped."""
    lines = strip_comments(re.sub(r"\\noindent\b", "", tex)).splitlines(keepends=True)
    body = "".join("\n" * line.endswith("\n") if _sets_up(line) else line for line in lines)
    return reflow_headings(remove_styles(expand(body, macros, 2)), fixed_headings).splitlines()


def sentences(text: str) -> list[str]:
    pieces = (s.strip().replace("<DOT>", ".") for s in re.split(r"(?<=[.!?])\s+", applied(text, _PROTECT)))
    return [s for s in pieces if len(s) > 1]
