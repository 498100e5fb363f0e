"""Structural chunkers: Markdown, plain and marked-up text, configuration, code.

A chunker turns one file into chunks with exact line ranges. Each is a generator over the
lines of a file; they run in Arrow batches, a file at a time, since a file's structure is a
state carried from line to line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

TARGET, CEILING = 700, 1000
SCHEMA = "path string, address string, parent string, heading string, text string, line_start int, line_end int, symbol string, kind string, ord int"


def estimated(text: str) -> int:
    return -(-len(text) // 4)


def lines_of(text: str) -> list[str]:
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


@dataclass
class Unit:
    kind: str
    start: int  # lines from 1, end inclusive
    end: int
    lines: list[str]


@dataclass
class Section:
    heading: list[str] = field(default_factory=list)
    units: list[Unit] = field(default_factory=list)


FENCE = re.compile(r"\s*(`{3,}|~{3,})")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$")
MARKER = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])[ \t]")
RULE = re.compile(r"\s*[|:\- ]*-[|:\- ]*$")


def table_at(lines: list[str], i: int) -> bool:
    return i + 1 < len(lines) and "|" in lines[i] and "|" in lines[i + 1] and bool(RULE.match(lines[i + 1]))


def markdown(lines: list[str]) -> list[Section]:
    """Sections under ATX headings; fences, tables, lists and paragraphs are units, front matter is skipped."""
    sections, stack, here = [], [], Section()
    i = 0
    if lines and lines[0].strip() == "---":
        i = next((k + 1 for k in range(1, len(lines)) if lines[k].strip() in ("---", "...")), 0)

    def take(kind: str, end: int) -> None:
        nonlocal i
        here.units.append(Unit(kind, i + 1, end, lines[i:end]))
        i = end

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif fence := FENCE.match(line):
            mark = fence[1]
            close = re.compile(rf"\s*{re.escape(mark[0])}{{{len(mark)},}}\s*$")
            take("fence", next((k + 1 for k in range(i + 1, len(lines)) if close.match(lines[k])), len(lines)))
        elif head := HEADING.match(line):
            if here.units:
                sections.append(here)
            level = len(head[1])
            stack = [h for h in stack if h[0] < level] + [(level, (head[2] or "").strip().rstrip("#").strip())]
            here = Section([h for _, h in stack])
            take("heading", i + 1)
        elif table_at(lines, i):
            take("table", next((k for k in range(i + 2, len(lines)) if "|" not in lines[k]), len(lines)))
        elif MARKER.match(line):
            take("list", next((k for k in range(i + 1, len(lines)) if not lines[k].strip() or not (MARKER.match(lines[k]) or lines[k][0] in " \t")), len(lines)))
        else:
            stops = lambda k: not lines[k].strip() or FENCE.match(lines[k]) or HEADING.match(lines[k]) or MARKER.match(lines[k]) or table_at(lines, k)
            take("paragraph", next((k for k in range(i + 1, len(lines)) if stops(k)), len(lines)))
    return [*sections, here] if here.units else sections


UNDERLINE = re.compile(r"([=\-~^\"'*+#<>])\1{2,}\s*$")


def prose(lines: list[str]) -> list[Section]:
    """Paragraphs; underlined lines, and lines after = signs, are headings."""
    sections, here, i = [], Section(), 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        under = i + 1 < len(lines) and UNDERLINE.match(lines[i + 1]) and len(lines[i + 1].rstrip()) >= len(lines[i].strip())
        equals = re.match(r"(={1,6})\s+(\S.*)$", lines[i])
        if under or equals:
            if here.units:
                sections.append(here)
            here = Section([equals[2].strip() if equals else lines[i].strip()])
            end = i + (2 if under and not equals else 1)
            here.units.append(Unit("heading", i + 1, end, lines[i:end]))
        else:
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip()), len(lines))
            here.units.append(Unit("paragraph", i + 1, end, lines[i:end]))
        i = end
    return [*sections, here] if here.units else sections


def config(lines: list[str]) -> list[Section]:
    """Blocks between blank lines, under the [section] above, whose own line is in no chunk."""
    sections, here, i = [], Section(), 0
    while i < len(lines):
        name = re.fullmatch(r"\s*\[\s*(.*\S)\s*\]\s*", lines[i])
        if name:
            if here.units:
                sections.append(here)
            here, i = Section([name[1]]), i + 1
        elif not lines[i].strip():
            i += 1
        else:
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip() or re.fullmatch(r"\s*\[\s*.*\S\s*\]\s*", lines[k])), len(lines))
            here.units.append(Unit("block", i + 1, end, lines[i:end]))
            i = end
    return [*sections, here] if here.units else sections


def greedy(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Half-open ranges, each as long as fits; a larger single one stands alone."""
    out, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            out.append((start, k))
            start, total = k, 0
        total += n
    return [*out, (start, len(sizes))] if sizes else out


def windows(lines: list[str], most: int = CEILING) -> list[tuple[int, int]]:
    """Half-open line ranges whose joined text stays within the ceiling, newlines counted."""
    out, start, chars = [], 0, 0
    for k, line in enumerate(lines):
        grown = len(line) if k == start else chars + 1 + len(line)
        if k > start and -(-grown // 4) > most:
            out.append((start, k))
            start, grown = k, len(line)
        chars = grown
    return [*out, (start, len(lines))] if lines else out


def packed(path: str, sections: list[Section]) -> Iterator[tuple]:
    """Chunks of a file: units of a section together up to the target, larger ones in labelled parts.

    Parts of a table repeat its two header rows. A part's address holds its unit's number, so
    two large units of one chunk cannot share an address.
    """
    ordinal = 0
    for section in sections:
        heading = " > ".join(section.heading)
        label = f"> context: {heading} ({path})" if heading else f"> context: {path}"
        groups = []
        for unit in section.units:
            text = "\n".join(unit.lines)
            if estimated(text) <= CEILING:
                groups.append((unit.start, unit.end, text, []))
                continue
            top = 2 if unit.kind == "table" and len(unit.lines) >= 3 else 0
            parts = greedy([estimated(x) for x in unit.lines[top:]], CEILING)
            rest = []
            for a, b in parts[1:]:
                body = [label, *unit.lines[:top], *unit.lines[top + a : top + b]]
                rest.append((unit.start + top + a, unit.start + top + b - 1, "\n".join(body)))
            first = parts[0][1] + top
            groups.append((unit.start, unit.start + first - 1, "\n".join(unit.lines[:first]), rest))
        for n, (a, b) in enumerate(greedy([estimated(g[2]) for g in groups], TARGET)):
            text = "\n\n".join(g[2] for g in groups[a:b])
            yield path, str(ordinal), None, heading, f"{label}\n{text}" if n else text, groups[a][0], groups[b - 1][1], "", "section"
            for u, group in enumerate(groups[a:b]):
                for k, (start, end, part) in enumerate(group[3]):
                    yield path, f"{ordinal}/{u}.{k}", str(ordinal), heading, part, start, end, "", "part"
            ordinal += 1


DECLARATION = re.compile(
    r"\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:(function)\*?\s+(\w+)|(class|interface|enum)\s+(\w+)|(type)\s+(\w+)[\s<=]|(const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>))"
)
METHOD = re.compile(r"\s+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(\*?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)?[^;]*\{\s*$")
NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "do", "else", "with"}
IMPORT = re.compile(r"""\s*import\s+(?:type\s+)?(.+?)\s+from\s+['"]([^'"]+)['"]|\s*export\s+\{([^}]*)\}\s+from\s+['"]([^'"]+)['"]""")
CALL = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*\(")


def code_stripped(lines: list[str]) -> list[str]:
    """Lines of the same count with strings and comments blanked, so that braces can be counted."""
    text = "\n".join(lines)
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    pattern = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\[\s\S]|[^`\\])*`"
    return re.sub(pattern, blank, text).split("\n")


def block_end(bare: list[str], at: int) -> int:
    """The last line, from 0, of the declaration that starts at a line: where its braces close, or its statement ends."""
    depth, opened = 0, False
    for k in range(at, len(bare)):
        for c in bare[k]:
            depth += (c in "{([") - (c in "})]")
            opened |= c == "{"
        if depth <= 0 and (opened or bare[k].rstrip().endswith((";", ")")) or k + 1 < len(bare) and not bare[k + 1].strip()):
            return k
    return len(bare) - 1


def declarations(lines: list[str]) -> list[tuple[str, str, int, int, str | None, bool]]:
    """(kind, name, first line, last line, parent, exported), lines from 1: top-level declarations and methods of classes."""
    bare, out, i = code_stripped(lines), [], 0
    while i < len(bare):
        found = DECLARATION.match(bare[i])
        if not found or bare[i][:1] in (" ", "\t"):
            i += 1
            continue
        kind, name = next((k, n) for k, n in zip(found.groups()[::2], found.groups()[1::2]) if n)
        kind = {"const": "function", "let": "function", "var": "function"}.get(kind, kind)
        end = block_end(bare, i)
        out.append((kind, name, i + 1, end + 1, None, "export" in bare[i].split("(")[0]))
        k = i + 1
        while kind == "class" and k < end:
            method = METHOD.match(bare[k])
            if method and method[1] not in NOT_METHODS:
                stop = min(block_end(bare, k), end - 1)
                out.append(("method", method[1], k + 1, stop + 1, name, False))
                k = stop
            k += 1
        i = end + 1
    return out


def imports(lines: list[str]) -> list[tuple[str, str, int]]:
    """(local name, module, line) of each imported or re-exported name."""
    out = []
    for k, line in enumerate(lines):
        if m := IMPORT.match(line):
            names, module = (m[1], m[2]) if m[1] else ("{" + m[3] + "}", m[4])
            for name in re.split(r"[{},]", names):
                if name := name.strip().removeprefix("* as ").removeprefix("type ").split(" as ")[-1].strip():
                    out.append((name, module, k + 1))
    return out


def calls(lines: list[str], most: int = 512) -> list[tuple[str, int]]:
    """(name, line) of names that are called, each once a line; keywords are none."""
    seen: dict[tuple[str, int], None] = {}
    for k, line in enumerate(code_stripped(lines)):
        if not DECLARATION.match(line):
            for name in CALL.findall(line):
                if name not in NOT_METHODS:
                    seen[name, k + 1] = None
    return list(seen)[:most]


def code(path: str, lines: list[str]) -> Iterator[tuple]:
    """A chunk per top-level declaration with its leading comment, gaps between them, large ones in windows."""
    at, ordinal = 0, 0
    tops = [d for d in declarations(lines) if d[4] is None]
    spans = []
    for kind, name, start, end, _, _ in tops:
        first = start - 1
        while first > at and re.match(r"\s*(//|/?\*)", lines[first - 1]):
            first -= 1
        if any(x.strip() for x in lines[at:first]):
            spans.append((at, first, "", "gap"))
        spans.append((first, end, name, kind))
        at = end
    if any(x.strip() for x in lines[at:]):
        spans.append((at, len(lines), "", "gap"))
    for a, b, name, kind in spans:
        for n, (x, y) in enumerate(windows(lines[a:b])):
            yield path, str(ordinal) if not n else f"{ordinal}/{n}", str(ordinal) if n else None, "", "\n".join(lines[a + x : a + y]), a + x + 1, a + y, name, kind
        ordinal += 1


TS = {"ts", "tsx", "js", "jsx", "mjs", "cjs"}


def chunk_file(path: str, language: str, role: str, text: str) -> Iterator[tuple]:
    """The chunks of one file by language and role. A role other than code with a language of code has none."""
    lines = lines_of(text)
    if language == "markdown":
        yield from packed(path, markdown(lines))
    elif language in ("text", "restructuredtext", "asciidoc"):
        yield from packed(path, prose(lines))
    elif language in ("json", "yaml", "yml", "toml", "ini", "conf", "proto"):
        yield from packed(path, config(lines))
    elif role == "code" and language in TS:
        yield from code(path, lines)
    elif role == "code":
        for n, (a, b) in enumerate(windows(lines)):
            yield path, str(n), None, "", "\n".join(lines[a:b]), a + 1, b, "", "window"


def chunked(files: DataFrame) -> DataFrame:
    """Chunks of ``files`` (path, language, role, text), numbered within each file as they come."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            rows = [(*c, i) for f in frame.itertuples(index=False) for i, c in enumerate(chunk_file(f.path, f.language, f.role, f.text or ""))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "language", "role", "text").mapInPandas(apply, SCHEMA)


SYMBOLS = "path string, name string, kind string, line_start int, line_end int, parent string, exported boolean, ord int"
REFS = "path string, name string, kind string, line int, module string, ord int"


def symbols(files: DataFrame) -> DataFrame:
    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f.path, n, k, a, b, p, x, i) for f in frame.itertuples(index=False) for i, (k, n, a, b, p, x) in enumerate(declarations(lines_of(f.text or "")))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOLS.split(", ")])

    return files.where(files["language"].isin(*TS)).select("path", "text").mapInPandas(apply, SYMBOLS)


def references(files: DataFrame) -> DataFrame:
    """Imports and calls of each file, numbered in order."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for f in frame.itertuples(index=False):
                lines = lines_of(f.text or "")
                found = [(n, "import", k, m) for n, m, k in imports(lines)] + [(n, "call", k, None) for n, k in calls(lines)]
                rows += [(f.path, n, kind, k, m, i) for i, (n, kind, k, m) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REFS.split(", ")])

    return files.where(files["language"].isin(*TS)).select("path", "text").mapInPandas(apply, REFS)
