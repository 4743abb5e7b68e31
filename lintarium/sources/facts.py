"""Facts of source files: one long table, made by a parser for each language inside ``mapInPandas``."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lintarium.sources.tables import ship

#: One row a fact. Offsets are of UTF-8 bytes, lines count from 1; ``attrs`` has what only some kinds have.
FACTS = "project string, path string, language string, kind string, name string, start int, end int, line int, end_line int, attrs map<string,string>"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


class Facts:
    """Collects the facts of one file; positions are given in characters."""

    def __init__(self, text: str):
        self.text, self.rows = text, []
        self.ascii = text.isascii()
        self.starts = [0, *[i + 1 for i, c in enumerate(text) if c == "\n"]]
        self.sums: list[int] | None = None

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        if self.sums is None:
            self.sums, n = [0], 0
            for c in self.text:
                n += 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                self.sums.append(n)
        return self.sums[at]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def line_text(self, line: int) -> str:
        if not 1 <= line <= len(self.starts):
            return ""
        end = self.starts[line] - 1 if line < len(self.starts) else len(self.text)
        return self.text[self.starts[line - 1] : end]

    def add(self, kind: str, name: str | None, start: int, end: int, **attrs) -> None:
        a = {k: str(v) for k, v in attrs.items() if v is not None}
        self.rows.append((kind, name, self.byte(start), self.byte(end), self.line(start), self.line(max(start, end - 1)), a))


def parse_one(language: str, text: str) -> list[tuple]:
    from lintarium.sources import brace_code, python_code

    f = Facts(text)
    try:
        {"python": python_code.parse, "rust": brace_code.rust, "js": brace_code.js}[language](f)
    except (SyntaxError, ValueError, RecursionError) as e:
        f.rows.clear()
        f.add("parse_error", type(e).__name__, 0, 0, message=str(e)[:200])
    return f.rows


def parse(files: DataFrame) -> DataFrame:
    """Facts of files (project, path, language, content).

    A file that can't be parsed, or isn't UTF-8, gives one fact of kind parse_error; files of other languages, and null
    contents, give none. No shuffle: each file is parsed where it was read.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for project, path, language, content in zip(b["project"], b["path"], b["language"], b["content"]):
                if content is None:
                    continue
                try:
                    text = content if isinstance(content, str) else bytes(content).decode("utf-8")
                except UnicodeDecodeError as e:
                    out.append((project, path, language, "parse_error", "UnicodeDecodeError", 0, 0, 1, 1, {"message": str(e)[:200]}))
                    continue
                out += [(project, path, language, *r) for r in parse_one(language, text)]
            yield pd.DataFrame(out, columns=COLUMNS)

    known = files.where(files["language"].isin("python", "rust", "js")).select("project", "path", "language", "content")
    return known.mapInPandas(run, FACTS)
