"""Lines, offsets, globs, versions and edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from lintarium.sources.tables import ship


def lines(df: DataFrame, text: str, *keys: str, ahead: tuple[str, int] | None = None) -> DataFrame:
    """(keys, line_no from 1, text, byte_start) of every line; line ends are \\n or \\r\\n, offsets are of UTF-8 bytes.

    One pass over each batch of texts with Arrow's kernels, linear in the text and without a shuffle. With ``ahead`` a
    line that holds its word, whatever the case, also has ``rest``: so many bytes of text behind it. Null text has no lines.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "line_no int, text string, byte_start bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keys))
            split = pc.split_pattern(texts, "\n")
            flat, of = split.flatten(), pc.list_parent_indices(split)
            row = of.to_numpy()
            sizes = pc.binary_length(flat).to_numpy().astype(np.int64) + 1
            starts = np.cumsum(sizes) - sizes
            many = pc.list_value_length(split).to_numpy()
            first = (np.cumsum(many) - many).astype(np.int64)
            offsets = starts - starts[first[row]] if len(row) else starts
            columns = [*(b.column(i).take(of) for i in range(len(keys))), pa.array((np.arange(len(row)) - first[row] + 1).astype(np.int32)), flat, pa.array(offsets)]
            if ahead:
                rest: list[bytes | None] = [None] * len(row)
                for i in np.flatnonzero(pc.match_substring(flat, ahead[0], ignore_case=True).to_numpy(zero_copy_only=False)).tolist():
                    at = int(offsets[i] + sizes[i])
                    rest[i] = memoryview(texts[int(row[i])].as_buffer())[at : at + ahead[1]].tobytes()
                columns.append(pa.array(rest, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "line_no", "text", "byte_start", *(["rest"] if ahead else [])])

    out = rows.mapInArrow(run, kinds + (", rest binary" if ahead else ""))
    return out.withColumn("text", F.regexp_replace("text", "\r$", ""))


def plain_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no from 1, text) of every line, without offsets, in time linear in the text."""
    cut = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_i", "_line"))
    return cut.select(*keys, (F.col("_i") + 1).alias("line_no"), F.regexp_replace("_line", "\r$", "").alias("text"))


def position(line_starts: Column, offset: Column) -> Column:
    """Line and column, both from 1, of a byte offset, given the offsets of line starts."""
    line = F.size(F.filter(line_starts, lambda s: s <= offset))
    return F.struct(line.alias("line"), (offset - F.element_at(line_starts, F.greatest(line, F.lit(1))) + 1).alias("column"))


def is_comment(line: Column) -> Column:
    return F.ltrim(line).rlike(r"^(//|#|\*|/\*)")


def glob_regex(glob: str) -> str:
    """A regular expression for a path glob: * and ? stay inside a path part, ** crosses parts, [..] and {a,b} as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + ("(?:)" if not depth else ")" * depth) + "$"


def osa(a: str, b: str, most: int | None = None) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            now.append(cost)
        two, one = one, now
    return one[-1]


@pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """``osa`` over columns; null where either is null."""
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def version(text: Column) -> Column:
    """Major, minor and patch of a version; what isn't a number is 0."""
    parts = F.split(F.regexp_replace(F.trim(text), "^[vV]", ""), r"[.\-+]")
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"))


def query_pairs(url: Column) -> Column:
    """The decoded pairs of a URL's query as (name, value), in order; + is a blank, a name without = has an empty value.

    What can't be decoded stays as it is; the fragment isn't part of the query.
    """
    query = F.regexp_extract(F.regexp_replace(url, r"#.*$", ""), r"\?(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(parts, lambda x: F.struct(plain(F.regexp_extract(x, r"^([^=]*)", 1)).alias("name"), plain(F.regexp_extract(x, r"=(.*)$", 1)).alias("value")))
