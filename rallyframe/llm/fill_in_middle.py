"""Fill-in-middle transformation with a sparse checkpoint index.

A text is cut into units (``[A-Za-z]+|[^A-Za-z]`` by code points). Counting them records, every ``STRIDE`` units, a
checkpoint: how many units, bytes and code points lie before it. A cut after a number of units is found by binary search of
the checkpoints and a short scan on from there, so no list of units is ever held: a text needs memory for itself and one
checkpoint per ``STRIDE`` units. Units are scanned in UTF-8, pieces are cut out by byte offsets, their lengths are
differences of code-point offsets. Which cuts and which form a document gets follows from a hash of its id and a seed.

Forms: ``plain`` is the text; ``psm`` is <P>prefix<S>suffix<M>middle; ``spm`` is <S>suffix<P>prefix<M>middle. A text that is
empty or holds a marker stays plain, so a marker in the output ends the piece before it and ``restore`` is exact.

Defined cases: a null text counts as empty; a null id is hashed as an empty one; rows that repeat an id get the same draws;
texts of any length are transformed whole, by themselves in a task; nothing is shuffled; an empty table stays empty; input
columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyframe.llm.arrow import made_rows

if TYPE_CHECKING:
    import pyarrow as pa

#: Units between two checkpoints.
STRIDE = 256
#: Of 100 documents so many are transformed, and of 100 transformed ones so many in the form spm.
RATE, SPM_RATE = 90, 20
MARKERS = ("<P>", "<S>", "<M>")
RESULT = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}

_UNIT = rb"(?:[A-Za-z]++|[^A-Za-z\x80-\xff]|[\xc0-\xff][\x80-\xbf]*+)"
_CONTINUED = bytes(range(0x80, 0xC0))


class Checkpoints:
    """Units, bytes and code points before every ``stride``-th unit of a text and at its end."""

    def __init__(self, text: bytes, stride: int = STRIDE):
        self.text, self.unit = text, re.compile(_UNIT)
        self.units, self.bytes, self.chars = [0], [0], [0]
        full = re.compile(_UNIT + rb"{%d}+" % stride)
        while found := full.match(text, self.bytes[-1]):
            self._add(stride, found.end())
        if rest := sum(1 for _ in self.unit.finditer(text, self.bytes[-1])):
            self._add(rest, len(text))

    def _add(self, units: int, end: int) -> None:
        self.chars.append(self.chars[-1] + self._chars(self.bytes[-1], end))
        self.units.append(self.units[-1] + units)
        self.bytes.append(end)

    def _chars(self, start: int, end: int) -> int:
        return len(self.text[start:end].translate(None, _CONTINUED))

    @property
    def n(self) -> int:
        return self.units[-1]

    def after(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the end of so many units."""
        at = bisect_right(self.units, units) - 1
        end = self.bytes[at]
        for _ in range(units - self.units[at]):
            end = self.unit.match(self.text, end).end()
        return end, self.chars[at] + self._chars(self.bytes[at], end)


def transform(text: bytes, draws: tuple[int, int, int, int], rate: int = RATE, spm_rate: int = SPM_RATE, stride: int = STRIDE) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and output of one text."""
    points = Checkpoints(text, stride)
    one, two, three, four = draws
    marks = [m.encode() for m in MARKERS]
    if not text or any(m in text for m in marks) or three % 100 >= rate:
        return points.n, "plain", None, None, text
    first, second = sorted((one % (points.n + 1), two % (points.n + 1)))
    (a, a_chars), (b, b_chars) = points.after(first), points.after(second)
    prefix, middle, suffix = (marks[0], text[:a]), (marks[2], text[a:b]), (marks[1], text[b:])
    form = "spm" if four % 100 < spm_rate else "psm"
    order = (suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle)
    return points.n, form, a_chars, b_chars - a_chars, b"".join(chain for part in order for chain in part)


def restored(output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    first, second, third = MARKERS if form == "psm" else (MARKERS[1], MARKERS[0], MARKERS[2])
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(third, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def draws_of(id_col: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits: the first groups of eight digits of the hexadecimal SHA-256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _transformed(batches: Iterator[pa.RecordBatch], left: list[str], rate: int, spm_rate: int) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    def made(text: pa.StringScalar, *draws: pa.Int64Scalar) -> tuple:
        return transform(text.as_buffer().to_pybytes(), tuple(h.as_py() for h in draws), rate, spm_rate)

    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    return made_rows(batches, ["__text", *(f"__h{k}" for k in range(4))], made, kinds, left)


def _restored(batches: Iterator[pa.RecordBatch], left: list[str], name: str, output_col: str) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    return made_rows(batches, [output_col, "form"], lambda output, form: (restored(output.as_py(), form.as_py()),), {name: pa.string()}, left)


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all) and n (units), form, prefix_chars and middle_chars (code points; null if plain), output."""
    left = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    draws = [h.alias(f"__h{k}") for k, h in enumerate(draws_of(F.col(id_col), seed))]
    texts = docs.select(*left, F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *draws)
    schema = T.StructType([*(docs.schema[c] for c in left), *(T.StructField(c, kind) for c, kind in RESULT.items())])
    return texts.mapInArrow(lambda it: _transformed(it, left, rate, spm_rate), schema)


def restore(made: DataFrame, name: str = "restored", output_col: str = "output") -> DataFrame:
    """``made`` with ``name``: the exact text, from output and form alone."""
    left = [c for c in made.columns if c != name]
    schema = T.StructType([*(made.schema[c] for c in left), T.StructField(name, T.StringType())])
    return made.select(*left).mapInArrow(lambda it: _restored(it, left, name, output_col), schema)
