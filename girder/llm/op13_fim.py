"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix, which are dealt out with sentinels.

The cuts of all texts of an Arrow batch are found together, on its UTF-8 bytes: a table gives each byte its class, another
says for each pair of adjacent classes whether a unit begins between them, running sums of that mask that start again at each
text count its units, and a binary search in them finds the bytes at which the two cuts fall. Units are code points, or words
with the white space after them. Prefix, middle and suffix then are three arrays over the batch's own bytes, and the outputs
of all rows are joined at once. Nothing loops over rows or bytes; beside the batch a byte a byte (the mask), the running sums
of one piece of ``PIECE`` bytes and the joined output are held, so memory follows the batch, which Spark bounds in bytes, or
one text if that is longer.

Cuts depend on the id and the seed alone: the first four groups of 8 hex digits of sha256("seed:id"). The first two, modulo
the number of units plus one, are the cuts; the third decides whether the text stays plain, the fourth between the two orders
suffix-prefix-middle and prefix-suffix-middle.

Nulls: a null text is cut as an empty one, which stays plain; a null id is hashed as an empty string. Texts that hold a
sentinel stay plain. Equal rows give equal rows. An empty table gives none. Other columns stay as they are, but for one that
has the name of the result (``into``), which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import table
from girder.llm.textkit import utf8

#: Bytes that are summed at once.
PIECE = 4 << 20
SEED = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are cut at all, and of these in the order suffix, prefix, middle.
CUT_RATE, SPM_RATE = 90, 20

INNER, SPACE, OTHER = 0, 1, 2
_CLASSES = np.full(256, OTHER, np.uint8)
_CLASSES[0x80:0xC0] = INNER  # all but the first byte of a code point
_CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE
#: Whether a unit begins at a byte, by the class of the byte before and its own.
BEGINS = {
    "chars": np.array([[cur != INNER for cur in range(3)] for _ in range(3)]),
    "words": np.array([[cur == OTHER and before == SPACE for cur in range(3)] for before in range(3)]),
}
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_starts(raw: np.ndarray, off: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte; the first byte of each text begins one."""
    kind = _CLASSES[raw]
    mask = np.zeros(len(raw), bool)
    mask[1:] = BEGINS[unit].ravel()[kind[:-1] * 3 + kind[1:]]
    first = off[:-1]
    mask[first[first < off[1:]]] = True
    return mask


def units_before(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For ascending places, the units that begin before each."""
    out, carry = np.zeros(len(at), np.int64), 0
    for a in range(0, len(mask), PIECE):
        sums = np.cumsum(mask[a : a + PIECE], dtype=np.int32)
        i, j = np.searchsorted(at, [a + 1, a + len(sums) + 1])
        out[i:j] = carry + sums[at[i:j] - a - 1]
        carry += int(sums[-1])
    return out


def byte_of_unit(mask: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte at which each unit (counted over the batch from 0, any order) begins; past the last one, the end."""
    out, carry = np.full(len(units), len(mask), np.int64), 0
    for a in range(0, len(mask), PIECE):
        sums = np.cumsum(mask[a : a + PIECE], dtype=np.int32)
        inside = np.flatnonzero((units >= carry) & (units < carry + sums[-1]))
        out[inside] = a + np.searchsorted(sums, units[inside] - carry + 1)
        carry += int(sums[-1])
    return out


def cut(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, whole: np.ndarray, unit: str = "chars") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its units, those of prefix and middle, and the bytes (within the batch) at which prefix and middle end; texts marked ``whole`` are all prefix."""
    raw, off = utf8(texts)
    lo, hi = int(off[0]), int(off[-1])
    raw, off = raw[lo:hi], off - lo
    mask = unit_starts(raw, off, unit)
    before = units_before(mask, off)
    n = np.diff(before)
    x, y = h1 % (n + 1), h2 % (n + 1)
    first, second = np.minimum(x, y), np.maximum(x, y)
    first, second = np.where(whole, n, first), np.where(whole, n, second)
    ends = byte_of_unit(mask, np.concatenate([before[:-1] + first, before[:-1] + second]))
    ends = np.where(np.concatenate([first == n, second == n]), np.tile(off[1:], 2), ends) + lo
    return n, first, second - first, ends[: len(n)], ends[len(n) :]


def dealt(texts: pa.Array, form: pa.Array, first_end: np.ndarray, second_end: np.ndarray, marks: tuple[str, str, str]) -> pa.Array:
    """The outputs: sentinels and parts in each row's order."""
    _, off = utf8(texts)
    borders = np.empty(3 * len(texts) + 1, off.dtype)
    borders[0:-1:3], borders[1::3], borders[2::3], borders[-1] = off[:-1], first_end, second_end, off[-1]
    wide = pa.types.is_large_string(texts.type)
    data = texts.buffers()[2]
    parts = (pa.LargeStringArray if wide else pa.StringArray).from_buffers(3 * len(texts), pa.py_buffer(borders.astype(np.int64 if wide else np.int32)), data if data is not None else pa.py_buffer(b""))
    prefix, middle, suffix = (parts.take(pa.array(np.arange(i, 3 * len(texts), 3))) for i in range(3))
    spm, plain = pc.equal(form, "spm"), pc.equal(form, "plain")
    p, s, m = (pa.scalar(x, texts.type) for x in marks)
    none = pa.scalar("", texts.type)
    lead, inner, last = pc.if_else(spm, s, pc.if_else(plain, none, p)), pc.if_else(spm, p, pc.if_else(plain, none, s)), pc.if_else(plain, none, m)
    return pc.binary_join_element_wise(lead, pc.if_else(spm, suffix, prefix), inner, pc.if_else(spm, prefix, suffix), last, middle, none)


def kernel(marks: tuple[str, str, str], unit: str, cut_rate: int, spm_rate: int):
    @F.arrow_udf(RESULT)
    def fim(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        a, b, c, d = (h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2, h3, h4))
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        whole = c % 100 >= cut_rate
        whole |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for mark in marks:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        form = pa.array(np.where(whole, "plain", np.where(d % 100 < spm_rate, "spm", "psm")).astype(object), pa.string())
        n, prefix, middle, first_end, second_end = cut(texts, a, b, whole, unit)
        output = dealt(texts, form, first_end, second_end, marks)
        return pa.StructArray.from_arrays([pa.array(n), form, pa.array(prefix, mask=whole), pa.array(middle, mask=whole), output], ["n", "form", "prefix_chars", "middle_chars", "output"])

    return fim


def draws(key: Column, seed: int) -> list[Column]:
    """The first four groups of 8 hex digits of sha256("seed:key"), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fim", unit: str = "chars", seed: int = SEED, cut_rate: int = CUT_RATE, spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``docs`` with a struct ``into``: n (units), form, prefix_chars, middle_chars (units; null if plain), output.

    ``marks``: the sentinels before prefix, suffix and middle; none may be part of another or be able to overlap one.
    """
    if unit not in BEGINS:
        raise ValueError(f"unit is one of {', '.join(BEGINS)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(into, kernel(marks, unit, cut_rate, spm_rate)(text, *draws(F.col(id_col), seed)))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from."""
    p, s, m = marks

    def between(left: str, right: str | None) -> Column:
        rest = F.substring_index(output, left, -1)
        return rest if right is None else F.substring_index(rest, right, 1)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    f = F.col("fim")
    return docs.select("doc_id", f.n.alias("n"), f.form.alias("form"), f.prefix_chars.alias("prefix_chars"), f.middle_chars.alias("middle_chars"), F.sha2(f.output.cast("binary"), 256).alias("output_sha256"), F.sha2(restored(f.output, f.form).cast("binary"), 256).alias("restored_sha256"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), h AS (
  SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS x, ('0x' || s[9:16])::BIGINT % (n + 1) AS y, ('0x' || s[17:24])::BIGINT % 100 AS u, ('0x' || s[25:32])::BIGINT % 100 AS v FROM d
), f AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR u >= {CUT_RATE} THEN 'plain' WHEN v < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (
  SELECT *, left(t, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS z FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || z || '{MIDDLE}' || m ELSE '{SUFFIX}' || z || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""
