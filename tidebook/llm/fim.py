"""Fill-in-the-middle: a text is cut at two unit borders, and its middle part moves to the end behind marks.

Each text becomes an array of code points (UTF-32). Its code points fall into classes, and a unit ends where the
classes of two neighbours say so; two of the borders are drawn from a hash of the row's id, so that a row is cut
alike whenever and wherever it is. Tasks work on whole texts, one Arrow batch of about 2 MB of text at a time.

Defined cases: a null text counts as empty. An empty text, one that holds a mark, and those that the rate leaves out
stay as they are (form "plain", no lengths). Marks are checked when a Recipe is made: none may hold or overlap with
another, so that text beside a mark can never be taken for one. A null id is drawn for like an empty one. Rows with one id
are each cut, by the same draws. An empty table gives no rows. Only the columns in keep and the text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

#: For each kind of unit: the class of each code point, and by the classes of two neighbours whether a unit ends between them.
UNITS = {
    "line": (lambda c: c == 10, np.array([[False, False], [True, True]])),
    "word": (lambda c: (c == 0x20) | ((c >= 0x09) & (c <= 0x0D)), np.array([[False, False], [True, False]])),
    "char": (lambda c: c < 0, np.array([[True, True], [True, True]])),
}


def check_marks(marks: Sequence[str]) -> None:
    """No mark is empty, is part of another, or begins with what another (or itself) ends with."""
    for k, a in enumerate(marks):
        for m, b in enumerate(marks):
            if not a or (k != m and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks that hold or overlap with each other: {a!r}, {b!r}")


@dataclass(frozen=True)
class Recipe:
    """How texts are cut; rate and spm are shares in hundredths."""

    unit: str = "line"
    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        check_marks(self.marks)

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def borders(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end: one more than there are units."""
    classes, ends = UNITS[unit]
    kind = classes(points).astype(np.int8)
    inner = np.flatnonzero(ends[kind[:-1], kind[1:]]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def cut(doc_id: int | None, text: str, recipe: Recipe) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and the output."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = borders(points, recipe.unit)
    n = len(at) - 1
    draws = hashlib.sha256(f"{recipe.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(draws[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or h3 % 100 >= recipe.rate or any(m in text for m in recipe.marks):
        return n, "plain", None, None, text
    a, b = sorted((at[h1 % (n + 1)], at[h2 % (n + 1)]))
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in ((0, a), (a, b), (b, len(points))))
    if h4 % 100 < recipe.spm:
        return n, "spm", int(a), int(b - a), f"{recipe.suffix}{suffix}{recipe.prefix}{prefix}{recipe.middle}{middle}"
    return n, "psm", int(a), int(b - a), f"{recipe.prefix}{prefix}{recipe.suffix}{suffix}{recipe.middle}{middle}"


def transform(documents: DataFrame, recipe: Recipe = Recipe(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: B008
    """The columns in keep, and n (units), form, prefix_chars, middle_chars and output of each whole text."""
    schema = documents.select(*keep).schema
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        schema = schema.add(name, kind)
    source = documents.select(*keep, F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))

    def run(batches):
        for part in W.chunks(batches, "_text"):
            done = [cut(i, t or "", recipe) for i, t in zip(part["_id"].to_pylist(), part["_text"].to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*done, strict=True)
            out = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *out], names=schema.names)

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:  # noqa: B008
    """The text that output was made of: between the marks lie its parts, none of which holds a mark."""
    parts = F.split(output, "|".join(re.escape(m) for m in recipe.marks), -1)
    first, second, middle = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
