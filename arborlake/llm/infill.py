"""Fill-in-the-middle: documents cut at two line ends and put together in another order.

A text is looked at as fixed blocks of UTF-8 bytes. Two Fenwick trees hold the line ends and the code points
of each block. A cut after so many units descends the first tree by binary lifting to the block that holds
it, finds the boundary inside that block alone, and reads the code points before it off the second tree. Only
the counts leave the Python worker; Spark cuts the text and puts the parts together.

Cases: a null text is empty, and an empty text stays plain. A null ``doc_id`` is drawn for as an empty name.
Rows that repeat an id get the same draws. Texts that hold a mark stay plain, so that ``restored`` is always
exact. A long text costs its bytes, two flags for each byte and one count for each block. An empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block.
BLOCK = 2048
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")

CUTS = "n long, prefix_chars int, middle_chars int"


def fenwick(counts: np.ndarray) -> np.ndarray:
    """tree[i]: the sum of the last ``i & -i`` of the first i counts."""
    sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    i = np.arange(len(sums))
    return sums - sums[i & (i - 1)] if len(sums) > 1 else sums


class Blocks:
    """A text's line ends and code points, counted by block."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        starts = np.arange(0, len(data), block)
        count = lambda flags: fenwick(np.add.reduceat(flags, starts, dtype=np.int64)) if len(data) else fenwick(starts)
        self.ends, self.points = count(data == 10), count((data & 0xC0) != 0x80)
        self.units = self._before(self.ends, len(self.ends) - 1) + bool(len(data) and data[-1] != 10)

    @staticmethod
    def _before(tree: np.ndarray, blocks: int) -> int:
        total = 0
        while blocks:
            total += int(tree[blocks])
            blocks &= blocks - 1
        return total

    def end_of(self, units: int) -> int:
        """The byte after the first ``units`` units."""
        if units in (0, self.units):
            return len(self.data) if units else 0
        tree, at, left = self.ends, 0, units
        step = 1 << (len(tree) - 1).bit_length()
        while step:
            if at + step < len(tree) and tree[at + step] < left:
                at += step
                left -= int(tree[at])
            step >>= 1
        start = at * self.block
        inside = np.flatnonzero(self.data[start : start + self.block] == 10)
        return start + int(inside[left - 1]) + 1

    def points_before(self, byte: int) -> int:
        """Code points that begin before ``byte``."""
        block, _ = divmod(byte, self.block)
        return self._before(self.points, block) + int(np.count_nonzero((self.data[block * self.block : byte] & 0xC0) != 0x80))


def cut(data: np.ndarray, first: int, second: int, block: int = BLOCK) -> tuple[int, int, int]:
    """Units of a text, and the code points of its prefix and middle for two draws."""
    blocks = Blocks(data, block)
    low, high = sorted((first % (blocks.units + 1), second % (blocks.units + 1)))
    prefix = blocks.points_before(blocks.end_of(low))
    return blocks.units, prefix, blocks.points_before(blocks.end_of(high)) - prefix


def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = [
        cut(np.frombuffer(t.as_buffer(), np.uint8) if t.as_buffer().size else np.zeros(0, np.uint8), a, b)
        for t, a, b in zip(texts, first.to_pylist(), second.to_pylist())
    ]
    columns = zip(*found) if found else [[], [], []]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["n", "prefix_chars", "middle_chars"])


def _draw(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks begin with one character that they do not hold again, so that none can arise where a text meets a mark."""
    if len(set(marks)) != 3 or any(not m or m[0] != marks[0][0] or m[0] in m[1:] for m in marks):
        raise ValueError("marks must differ, begin with the same character and not repeat it")


def transform(
    docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    ``percent`` of the documents are cut, ``spm_percent`` of them with the suffix first.
    """
    check_marks(marks)
    before, after, middle = map(F.lit, marks)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    name = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    drawn = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole, F.sha2(F.concat(F.lit(f"{seed}:"), name), 256).alias("digest"))
    find = F.arrow_udf(_cuts, CUTS)
    cuts = drawn.select("doc_id", "text", *[_draw(F.col("digest"), i).alias(f"h{i + 1}") for i in range(4)]).select(
        "doc_id", "text", "h3", "h4", find("text", "h1", "h2").alias("cuts")
    )
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    formed = cuts.select("doc_id", "text", "cuts.*", form.alias("form"))
    one = F.lit(1)
    prefix = F.substring("text", one, F.col("prefix_chars"))
    between = F.substring("text", F.col("prefix_chars") + one, F.col("middle_chars"))
    suffix = F.substring("text", F.col("prefix_chars") + F.col("middle_chars") + one, F.length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(before, prefix, after, suffix, middle, between))
        .when(F.col("form") == "spm", F.concat(after, suffix, before, prefix, middle, between))
        .otherwise(F.col("text"))
    )
    counted = lambda c: F.when(F.col("form") != "plain", F.col(c).cast("long")).alias(c)
    return formed.select("doc_id", "n", "form", counted("prefix_chars"), counted("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of ``transform`` was made from."""
    check_marks(marks)
    before, after, middle = marks
    between = lambda first, last: F.substring_index(F.substring_index(output, last, 1), first, -1)
    body = F.substring_index(output, middle, -1)
    return (
        F.when(form == "psm", F.concat(between(before, after), body, between(after, middle)))
        .when(form == "spm", F.concat(between(before, middle), body, between(after, before)))
        .otherwise(output)
    )


def digests(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``transform`` with SHA-256 digests in place of the texts, of the output and of the text read back from it."""
    found = transform(docs, seed, percent, spm_percent)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
