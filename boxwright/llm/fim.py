"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is cut into units (runs of letters, or single other code points). The first pass counts them; two hashes of the
document's id choose two ranks; the second pass advances a lazy match iterator to both ranks. No list of units is ever
held: besides the text a task keeps two offsets. Rows are independent, so nothing is shuffled and a hot source does not matter.

Null texts count as empty, and empty texts are plain with no units. Very long texts are matched lazily in a batch of their own. Equal ranks
give an empty middle. Repeated rows and ids: one result row each; a null id hashes as the empty string. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.store import small_batches

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = re.compile("<[PSM]>")
#: Of 100 documents so many are transformed, and so many of these begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None) -> list[int]:
    """The four numbers that choose a document's ranks and form."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut_points(text: str, low: int, high: int) -> tuple[int, int]:
    """Code points before unit ``low`` and before unit ``high``, by one lazy pass that stops there."""
    units = UNIT.finditer(text)
    a = b = 0
    if low:
        a = b = next(islice(units, low - 1, None)).end()
    if high > low:
        b = next(islice(units, high - low - 1, None)).end()
    return a, b


def transform(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    n = sum(1 for _ in UNIT.finditer(text))
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= TRANSFORMED or MARK.search(text):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut_points(text, low, high)
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = OUTPUT.replace(",", "").split()[2::2], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = [transform(i.as_py(), t.as_py() or "") for i, t in zip(batch.column(0), batch.column(1), strict=True)]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id and text. Returns doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_transform, OUTPUT)


def restored(output: Column, form: Column) -> Column:
    """The exact text behind an output: its parts between the three marks, put back in order."""
    parts = F.split(output, MARK.pattern, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
