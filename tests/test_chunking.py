"""Chunkers: golden chunks, exact ranges, full coverage, and the ceiling."""

import pytest

from tomeforge.operators import chunking as ch

MD = """---
role: plan
---
# Top

Intro text
on two lines.

```
# not a heading
```
## Sub
- one
  more
- two

| a | b |
|---|---|
| 1 | 2 |
""".split("\n")


def test_markdown_units():
    got = [(s.heading, [(u.kind, u.start, u.end) for u in s.units]) for s in ch.markdown(ch.lines_of("\n".join(MD)))]
    assert got == [
        (["Top"], [("heading", 4, 4), ("paragraph", 6, 7), ("fence", 9, 11)]),
        (["Top", "Sub"], [("heading", 12, 12), ("list", 13, 15), ("table", 17, 19)]),
    ]


def test_prose_headings():
    lines = ["Title", "=====", "", "text", "more", "", "= Ascii", "body"]
    assert [(s.heading, [(u.kind, u.start, u.end) for u in s.units]) for s in ch.prose(lines)] == [
        (["Title"], [("heading", 1, 2), ("paragraph", 4, 5)]),
        (["Ascii"], [("heading", 7, 7), ("paragraph", 8, 8)]),
    ]


def test_config_sections():
    assert [(s.heading, [(u.start, u.end) for u in s.units]) for s in ch.config(["a = 1", "", "[x]", "b = 2", "c = 3", "[ y ]", "d"])] == [
        ([], [(1, 1)]), (["x"], [(4, 5)]), (["y"], [(7, 7)])
    ]


@pytest.mark.parametrize("kind", ["paragraph", "table"])
def test_large_units_are_cut(kind):
    body = ["| row | " + "x" * 90 + " |" for _ in range(200)] if kind == "table" else ["w" * 100 for _ in range(200)]
    lines = (["| a | b |", "|---|---|"] if kind == "table" else []) + body
    got = list(ch.packed("p", ch.markdown(lines)))
    assert len({c[1] for c in got}) == len(got) > 3
    covered = sorted(x for c in got for x in range(c[5], c[6] + 1))
    assert covered == list(range(1, len(lines) + 1))
    assert all(c[4].startswith("> context: p\n" + ("| a | b |\n|---|---|\n" if kind == "table" else "")) for c in got if c[2] is not None)


def test_windows_stay_under_the_ceiling():
    lines = ["x" * n for n in (10, 3990, 8, 5000, 1, 1, 3999)]
    for a, b in ch.windows(lines):
        assert b - a == 1 or ch.estimated("\n".join(lines[a:b])) <= ch.CEILING
    assert [x for a, b in ch.windows(lines) for x in lines[a:b]] == lines


TS = """import { helper as h, other } from './util';
import type { T } from "../t";

// adds
export function add(a: number, b: number) {
  return h(a) + b; // } in a comment
}

const LIMIT = 3;
export class Box extends Base {
  private size = 1;
  async open(key: string): Promise<void> {
    if (key === "}") { this.log(key); }
  }
  close() {
    add(1, 2);
  }
}
""".rstrip().split("\n")


def test_code():
    assert ch.declarations(TS) == [
        ("function", "add", 5, 7, None, True), ("class", "Box", 10, 18, None, True), ("method", "open", 12, 14, "Box", False), ("method", "close", 15, 17, "Box", False)
    ]
    assert ch.imports(TS) == [("h", "./util", 1), ("other", "./util", 1), ("T", "../t", 2)]
    assert ("h", 6) in ch.calls(TS) and ("add", 16) in ch.calls(TS) and not any(n == "if" for n, _ in ch.calls(TS))
    got = [(c[5], c[6], c[7]) for c in ch.code("p", TS)]
    assert got == [(1, 3, ""), (4, 7, "add"), (8, 9, ""), (10, 18, "Box")]


def test_chunks_of_files(spark):
    files = [("a.md", "markdown", "current-doc", "\n".join(MD)), ("b.ts", "ts", "code", "\n".join(TS)), ("c.ts", "ts", "plan", "x"), ("d.py", "py", "code", "def f():\n  pass"), ("e.txt", "text", "current-doc", None)]
    got = ch.chunked(spark.createDataFrame(files, "path string, language string, role string, text string")).collect()
    assert {r.path for r in got} == {"a.md", "b.ts", "d.py"}
