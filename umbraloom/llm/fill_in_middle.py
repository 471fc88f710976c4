"""Fill-in-the-middle transformation by a matcher that reads a text twice and stores nothing of it.

A text is a sequence of units, the matches of a pattern. The first pass counts them. A document's two cuts are ranks among them,
drawn from a keyed digest of its id, so that they depend neither on partitions nor on other rows. The second pass advances one lazy match
iterator to the smaller rank, then on to the larger one. Neither pass holds more than one match, however long the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Marks of prefix, suffix and middle. None is a prefix of another's end, so an output can be taken apart again.
MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Mix:
    """Which share of the texts is transformed, and which share of those starts with the suffix, in percent; seed keys the draws."""

    transformed: int = 90
    suffix_first: int = 20
    seed: str = "1"


def draws(doc_id: int | None, seed: str = "1") -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first groups of the sha256 of seed, colon and decimal id; a null id has no digits."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12))


def count_units(unit: re.Pattern, text: str) -> int:
    """How many units a text has. One match is held at a time."""
    n = 0
    for n, _ in enumerate(unit.finditer(text), 1):  # noqa: B007
        pass
    return n


def ends_at(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first `first` units of a text end, and where the first `second` do; first <= second. The matcher goes no further."""
    matches, out, at, end = unit.finditer(text), [], 0, 0
    for rank in (first, second):
        for m in deque(islice(matches, rank - at), maxlen=1):
            end = m.end()
        at = rank
        out.append(end)
    return out[0], out[1]


def transform(text: str, doc_id: int | None, unit: re.Pattern, mix: Mix) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n = count_units(unit, text)
    h1, h2, h3, h4 = draws(doc_id, mix.seed)
    if not text or h3 % 100 >= mix.transformed or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = ends_at(unit, text, a, b)
    p, s, m = MARKS
    if h4 % 100 < mix.suffix_first:
        return n, "spm", x, y - x, f"{s}{text[y:]}{p}{text[:x]}{m}{text[x:y]}"
    return n, "psm", x, y - x, f"{p}{text[:x]}{s}{text[y:]}{m}{text[x:y]}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone. Within an output each mark stands once, as texts that hold
    one stay plain and no mark can arise where a piece of text meets one."""
    p, s, m = MARKS
    first, second = F.when(form == "psm", F.lit(p)).otherwise(F.lit(s)), F.when(form == "psm", F.lit(s)).otherwise(F.lit(p))
    before = lambda text, mark: F.call_function("substring_index", text, mark, F.lit(1))
    rest = before(output, F.lit(m))
    middle = F.substring(output, F.length(rest) + F.lit(len(m) + 1), F.length(output))
    head = F.substring(rest, F.length(first) + F.lit(1), F.length(rest))
    left = before(head, second)
    right = F.substring(head, F.length(left) + F.length(second) + F.lit(1), F.length(head))
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))


def fill_in_middle(docs: DataFrame, mix: Mix | None = None, unit: str = UNIT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs, one for one.

    Null text counts as empty; an empty text is plain with n = 0. A null doc_id is passed on and draws from an id without digits. Repeated
    rows have the same result each; an empty table gives no rows. prefix_chars and middle_chars are null in plain rows. Texts that hold a mark
    stay plain. Very long texts take time in proportion and no memory beside text and output. Other columns are not read, whatever their names.
    """
    mix = mix or Mix()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for b in batches:
            held, size, out = 0, 0, [[] for _ in range(6)]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                row = transform(text.as_py() or "", doc_id, pattern, mix)
                for c, v in zip(out, (doc_id, *row), strict=True):
                    c.append(v)
                held, size = held + 1, size + len(row[-1])
                if size > 16 << 20:  # long texts leave in batches of their own
                    yield _batch(out)
                    held, size, out = 0, 0, [[] for _ in range(6)]
            if held:
                yield _batch(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


#: The same as SQL: units as a list, cut by the same draws.
SQL = r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
               sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    r AS (
        SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM d),
    c AS (
        SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
               array_to_string(u[greatest(a, b) + 1:n], '') AS s
        FROM r)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM c"""
