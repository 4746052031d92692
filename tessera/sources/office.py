"""Text of Word and slide files, as parsers for :func:`tessera.sources.io.parsed`: paragraphs, and texts of shapes by slide.

Both are ZIP archives of XML. PDF isn't read: register a parser of your own for it.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.io import register_parser

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: A part of an archive that unpacks to more is taken for broken.
MOST_BYTES = 200_000_000


def _parts(content: bytes, pattern: str) -> list[tuple[str, ElementTree.Element]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [i.filename for i in z.infolist() if re.fullmatch(pattern, i.filename) and i.file_size <= MOST_BYTES]
        return [(n, ElementTree.fromstring(z.read(n))) for n in names]


def docx_text(content: bytes) -> str:
    """The paragraphs of a document's body, outside tables, one a line."""
    lines = []
    for _, root in _parts(content, r"word/document\.xml"):
        for p in root.findall(f"{_W}body/{_W}p"):
            lines.append("".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")))
    return "\n".join(lines)


def pptx_text(content: bytes) -> str:
    """The texts of all shapes, slide by slide in order of their numbers; a shape's paragraphs are lines."""
    slides = sorted(_parts(content, r"ppt/slides/slide\d+\.xml"), key=lambda s: int(re.findall(r"\d+", s[0])[-1]))
    return "\n".join("\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in body.iter(f"{_A}p")) for _, root in slides for body in root.iter(f"{_P}txBody"))


def _parser(read):
    @F.pandas_udf(T.StringType())
    def text(content: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else read(bytes(b))
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                return None  # the row's status says that it couldn't be read

        return content.map(one)

    return text


def register() -> None:
    """Add both parsers; a file that can't be read has the status ``error``."""
    register_parser(".docx", _parser(docx_text))
    register_parser(".pptx", _parser(pptx_text))
