"""Parsers that find the definitions of a source file.

Python files are read with the standard parser. Languages with braces are scanned for declarations at the top level of
the file, whose extent ends with their bracket or statement. Whatever is between definitions becomes ``block`` chunks;
small neighbours are merged; imports are put before each chunk for context.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from .chunking import Chunk, estimate


@dataclass(frozen=True)
class Part:
    """Lines first .. last (from 0) of a file; kind and name of a definition, or ``block``."""

    first: int
    last: int
    kind: str
    name: str | None = None
    inside: tuple[Part, ...] = ()


def assemble(content: str, parts: list[Part], imports: list[tuple[int, int]], most: int) -> list[Chunk]:
    """Chunks of the parts in order, with the import lines before each that fits and does not begin with them."""
    lines = content.split("\n")
    head = "\n".join("\n".join(lines[a : b + 1]) for a, b in imports)
    taken = {i for a, b in imports for i in range(a, b + 1)}
    out: list[Chunk] = []
    for p in _filled(parts, taken, lines):
        out += _cut(p, lines, most)
    out = _merged(out, most)
    if head:
        out = [c if re.match(r"import\b|from\b|package\b|using\b", c.content) else Chunk(f"{head}\n\n{c.content}", c.start_line, c.end_line, c.kind, c.name) for c in out]
    return out or ([Chunk(content, 1, len(lines), "module")] if content.strip() else [])


def _filled(parts: list[Part], taken: set[int], lines: list[str]) -> list[Part]:
    """Parts with blocks of the lines between them that aren't blank or imports."""
    out, at = [], 0
    for p in [*sorted(parts, key=lambda x: x.first), None]:
        until = p.first if p else len(lines)
        run: list[int] = []
        for i in [*range(at, until), None]:
            if i is not None and i not in taken:
                run.append(i)
            elif run:
                out += _block(run, lines)
                run = []
        if p:
            out.append(p)
            at = p.last + 1
    return out


def _block(run: list[int], lines: list[str]) -> list[Part]:
    full = [i for i in run if lines[i].strip()]
    return [Part(full[0], full[-1], "block")] if full else []


def _cut(p: Part, lines: list[str], most: int) -> list[Chunk]:
    text = "\n".join(lines[p.first : p.last + 1])
    if estimate(text) <= most:
        return [Chunk(text, p.first + 1, p.last + 1, p.kind, p.name)] if text.strip() else []
    if p.inside:
        return [c for q in _within(p, lines) for c in _cut(q, lines, most)]
    out, at, used = [], p.first, 0
    for i in range(p.first, p.last + 2):
        cost = estimate(lines[i]) + 1 if i <= p.last else most + 1
        if used + cost > most and i > at:
            text = "\n".join(lines[at:i])
            if text.strip():
                out.append(Chunk(text, at + 1, i, p.kind, p.name))
            at, used = i, 0
        used += cost
    return out


def _within(p: Part, lines: list[str]) -> list[Part]:
    out, at = [], p.first
    for q in (*p.inside, None):
        until = q.first if q else p.last + 1
        if any(x.strip() for x in lines[at:until]):
            out.append(Part(at, until - 1, p.kind if at == p.first else "block", p.name if at == p.first else None))
        if q:
            out.append(q)
            at = q.last + 1
    return out


def _merged(chunks: list[Chunk], most: int) -> list[Chunk]:
    """Neighbouring blocks at most two lines apart joined while they fit."""
    out: list[Chunk] = []
    for c in chunks:
        last = out[-1] if out else None
        if last and last.kind == c.kind == "block" and c.start_line - last.end_line <= 2 and estimate(last.content) + estimate(c.content) <= most:
            out[-1] = Chunk(f"{last.content}\n{c.content}", last.start_line, c.end_line, "block", last.name)
        else:
            out.append(c)
    return out


def python_parser(content: str, most: int) -> list[Chunk]:
    tree = ast.parse(content)

    def part(node: ast.stmt) -> Part:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        inside = tuple(part(n) for n in node.body if isinstance(n, definitions)) if isinstance(node, ast.ClassDef) else ()
        return Part(first, node.end_lineno - 1, kind, node.name, inside)

    definitions = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    imports = [(n.lineno - 1, n.end_lineno - 1) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    return assemble(content, [part(n) for n in tree.body if isinstance(n, definitions)], imports, most)


#: Modifiers that may come before a declaration.
_BEFORE = r"^[ \t]*(?:(?:@\w[\w.]*(?:\([^)]*\))?|export|default|declare|public|private|protected|internal|open|final|abstract|static|async|override|data|sealed|inline|suspend|fileprivate|mutating|external|const)\s+)*"
_DECLARATIONS = {
    "brace": [
        ("function", r"(?:async\s+)?function\s*\*?\s*(\w+)"),
        ("class", r"class\s+(\w+)"),
        ("interface", r"interface\s+(\w+)"),
        ("enum", r"enum\s+(?:class\s+)?(\w+)"),
        ("type", r"type\s+(\w+)"),
        ("block", r"(?:const|let|var)\s+(\w+)"),
    ],
    "go": [("function", r"func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", r"type\s+(\w+)"), ("block", r"(?:var|const)\s+(\w+|\()")],
    "kotlin": [("function", r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("interface", r"interface\s+(\w+)"), ("class", r"(?:enum\s+)?class\s+(\w+)"), ("block", r"(?:companion\s+)?object\s*(\w*)"), ("block", r"va[lr]\s+(\w+)")],
    "swift": [("function", r"(?:func\s+(\w+)|init\b)"), ("class", r"class\s+(\w+)"), ("struct", r"struct\s+(\w+)"), ("enum", r"enum\s+(\w+)"), ("protocol", r"protocol\s+(\w+)"), ("extension", r"extension\s+(\w+)"), ("block", r"(?:let|var)\s+(\w+)")],
    "dart": [("class", r"(?:class|mixin)\s+(\w+)"), ("enum", r"enum\s+(\w+)"), ("extension", r"extension\s+(\w+)"), ("function", r"(?:[\w<>?,\[\]]+\s+)+(\w+)\s*(?=\()")],
}
_IMPORT = re.compile(r"^(?:import\b|from\s+\S+\s+import\b|export\s+.*\bfrom\s+['\"])")
_MASK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def _masked(content: str) -> str:
    """The text with comments and strings blanked, line breaks kept."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)


def _end(text: str, at: int) -> int:
    """Where the declaration at ``at`` ends: after its bracket if one opens, else with its statement."""
    depth = 0
    for m in re.compile(r"[(){}\[\];\n]").finditer(text, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return m.start()
            if depth == 0 and c == "}":
                return m.end()
        elif depth == 0 and (c == ";" or c == "\n" and not re.match(r"\s*(?:[{=.:?&|+,]|->|=>|where\b|extends\b|implements\b)", text[m.end() : m.end() + 80]) and not text[: m.start()].rstrip().endswith(("=", ",", "=>", "&&", "||", "+", ":", "("))):
            return m.start()
    return len(text)


def brace_parser(family: str) -> Callable[[str, int], list[Chunk]]:
    rules = [(kind, re.compile(_BEFORE + pattern, re.M)) for kind, pattern in _DECLARATIONS[family]]

    def parse(content: str, most: int) -> list[Chunk]:
        text = _masked(content)
        starts = [0]
        for m in re.finditer("\n", text):
            starts.append(m.end())
        depth, depths = 0, []
        for a, b in zip(starts, [*starts[1:], len(text) + 1], strict=True):
            depths.append(depth)
            depth += sum(text.count(c, a, b) for c in "([{") - sum(text.count(c, a, b) for c in ")]}")
        if depth:
            raise ValueError("brackets don't match")

        def found(first: int, last: int, level: int) -> list[Part]:
            out, i = [], first
            while i <= last:
                if depths[i] == level and not _IMPORT.match(text[starts[i] :].lstrip()[:200]):
                    for kind, pattern in rules:
                        m = pattern.match(text, starts[i])
                        if m:
                            end = _end(text, m.end())
                            stop = max(i, text.count("\n", 0, max(starts[i], end - 1 if text[end - 1 : end] == "\n" else end)))
                            stop = min(stop, last)
                            inside = tuple(p for p in found(i + 1, stop - 1, level + 1) if p.kind == "function") if kind in ("class", "interface", "struct", "extension", "protocol") else ()
                            arrow = kind == "block" and re.search(r"=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", text[m.end() : m.end() + 200].split("\n")[0])
                            out.append(Part(i, stop, "function" if arrow else kind, next((g for g in m.groups() if g and g != "("), None), inside))
                            i = stop
                            break
                i += 1
            return out

        imports, i = [], 0
        while i < len(starts):
            if depths[i] == 0 and _IMPORT.match(content[starts[i] : starts[i] + 200]):
                j = i
                while j + 1 < len(starts) and depths[j + 1] > 0:
                    j += 1
                imports.append((i, j))
                i = j
            i += 1
        return assemble(content, found(0, len(starts) - 1, 0), imports, most)

    return parse


PARSERS: dict[str, Callable[[str, int], list[Chunk]]] = {
    **dict.fromkeys((".ts", ".js", ".tsx", ".jsx"), brace_parser("brace")),
    ".py": python_parser,
    ".go": brace_parser("go"),
    ".dart": brace_parser("dart"),
    **dict.fromkeys((".kt", ".kts"), brace_parser("kotlin")),
    ".swift": brace_parser("swift"),
}
