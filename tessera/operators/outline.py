"""Nested heads of notes as paths and values: indentation is a stack, and a fold over the lines keeps it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.text import frontmatter

FIELDS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))
LINE = re.compile(r"^( *)((?:- +|-$)*)(?:([^\s:\[{\"'#-][^:]*?|\"[^\"]*\"|'[^']*'):(?: +|$))?(.*)$")


def plain(value: str) -> str:
    """A value without a remark at its end and without quotes."""
    if value[:1] in "\"'" and len(value) > 1 and (end := value.find(value[0], 1)) > 0:
        return value[1:end]
    return re.sub(r"\s+#.*$", "", value).strip()


def folded(head: str | None) -> list[tuple[str, str]]:
    """``path, value`` of each plain value in order; items of lists have their number from 0 as a step of the path.

    Maps and lists may be nested in each other by indentation, lists in brackets on one line too. Blank lines and remarks are passed over;
    other lines that are neither a key nor an item, such as those of block texts, go to the value before them, with a blank in between.
    """
    out: list[tuple[str, str]] = []
    stack: list[list] = [[-1, "", 0, False]]  # indentation, step, number of items so far, whether it is an item; first the head itself

    def put(steps: list[str], value: str) -> None:
        if value[:1] == "[" and value[-1:] == "]":
            items = [x.strip() for x in re.findall(r"(?:\"[^\"]*\"|'[^']*'|[^,\"'])+", value[1:-1])]
            out.extend((".".join([*steps, str(n)]), plain(x)) for n, x in enumerate(x for x in items if x))
        else:
            out.append((".".join(steps), plain(value)))

    for line in (head or "").split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, dashes, key, rest = LINE.match(line.rstrip().replace("\t", "    ")).groups()
        at = len(indent)
        if not dashes and key is None:
            if out:
                out[-1] = out[-1][0], f"{out[-1][1]} {rest.strip()}".strip()
            continue
        for dash in re.findall(r"- *", dashes):
            while stack[-1][0] > at or stack[-1][0] == at and stack[-1][3]:
                stack.pop()
            stack[-1][2] += 1
            stack.append([at, str(stack[-1][2] - 1), 0, True])
            at += len(dash)
        if key is not None:
            while stack[-1][0] >= at:
                stack.pop()
            stack.append([at, plain(key), 0, False])
        if rest and rest not in ("|", ">", "|-", ">-"):
            put([s[1] for s in stack[1:]], rest)
        elif rest:
            out.append((".".join(s[1] for s in stack[1:]), ""))
    return out


@F.pandas_udf(FIELDS)
def fields_of(head: pd.Series) -> pd.Series:
    return head.map(folded)


def head_fields(files: DataFrame) -> DataFrame:
    """``path, field, value`` of the heads of Markdown notes ``path, content``; a note without a head has no rows."""
    t = files.select("path", F.explode(fields_of(frontmatter(F.col("content")))).alias("f"))
    return t.select("path", F.col("f.path").alias("field"), F.col("f.value").alias("value"))
