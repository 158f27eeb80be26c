"""Fill-in-middle transformation: a text is cut at two units and its middle moves to the end.

A unit is a run of letters A-Z, a-z or any other single code point.  Each text
is seen as blocks of a fixed number of UTF-8 bytes; a Fenwick tree over the
blocks stores how many units and how many code points begin in each.  The block
of a cut is found by binary-lifting descent, which adds up the code points it
leaves behind on the way; only inside that block is the text looked at again.
Cuts come back as code point counts, so texts never return from Python: Spark
puts the output together itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

LETTER = np.zeros(256, bool)
LETTER[ord("A"):ord("Z") + 1] = LETTER[ord("a"):ord("z") + 1] = True


class Blocks:
    """Fenwick tree of (units, code points) over blocks of ``size`` bytes of one UTF-8 text."""

    def __init__(self, data: np.ndarray, size: int):
        self.size = size
        self.lead = (data & 0xC0) != 0x80
        letter = LETTER[data]
        self.unit = self.lead.copy()
        self.unit[1:] &= ~(letter[1:] & letter[:-1])
        edges = np.arange(0, len(data), size)
        total = np.zeros((len(edges) + 1, 2), np.int64)
        if len(edges):
            for i, mask in enumerate((self.unit, self.lead)):
                total[1:, i] = np.cumsum(np.add.reduceat(mask, edges, dtype=np.int64))
        at = np.arange(len(edges) + 1)
        self.tree = (total - total[at & (at - 1) * (at > 0)]).tolist()  # node i sums the lowbit(i) blocks up to block i
        self.units, self.points = total[-1].tolist()

    def cut(self, k: int) -> int:
        """Code points before the unit number ``k`` (from 0); all of them for k = number of units."""
        last = len(self.tree) - 1
        at, units, points = 0, 0, 0
        step = 1 << last.bit_length() >> 1
        while step:
            if at + step <= last and units + self.tree[at + step][0] <= k:
                at += step
                units += self.tree[at][0]
                points += self.tree[at][1]
            step >>= 1
        if at == last:
            return points
        begin = at * self.size
        inside = int(np.flatnonzero(self.unit[begin:begin + self.size])[k - units])
        return points + int(np.count_nonzero(self.lead[begin:begin + inside]))


def _cuts(text: Column, first: Column, second: Column, block: int) -> Column:
    """(n, a, b): units of the text, code points before the smaller and the larger cut."""
    @F.arrow_udf("n long, a long, b long")
    def run(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        rows = []
        for t, x, y in zip(texts, first.to_pylist(), second.to_pylist()):
            raw = t.as_buffer()
            b = Blocks(np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8), block)
            x, y = sorted((x % (b.units + 1), y % (b.units + 1)))
            rows.append((b.units, b.cut(x), b.cut(y)))
        n, a, b = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (n, a, b)], ["n", "a", "b"])
    return run(text, first, second)


def _draw(key: Column, group: int) -> Column:
    """The 8-digit group number ``group`` (from 1) of a hex digest as an unsigned number."""
    return F.conv(F.substring(key, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, block: int = 1024, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row per row of ``docs``.

    ``n`` counts the units of the whole text.  Cuts, form and order follow the
    SHA-256 of "seed:doc_id", so reruns agree and no row needs another.  The
    form is plain (output is the text) for an empty text, for one that holds a
    marker already and for ``plain_percent`` of the rest; of the others
    ``spm_percent`` put the suffix first.  prefix_chars and middle_chars are
    null for plain texts.

    A null text is empty; a null doc_id draws like the empty string; repeated
    rows and ids draw alike; an empty table gives no rows; columns besides
    doc_id and text are not read.  No shuffle; a text is worked on inside its
    row, in about four bytes of memory for each of its own.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    d = d.select("doc_id", "text", "key", _cuts(F.col("text"), _draw(F.col("key"), 1), _draw(F.col("key"), 2), block).alias("cut"))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (_draw(F.col("key"), 3) % 100 >= 100 - plain_percent)
    d = d.select("doc_id", "text", F.col("cut.n").alias("n"), F.col("cut.a").cast("int").alias("a"), F.col("cut.b").cast("int").alias("b"),
                 F.when(plain, "plain").when(_draw(F.col("key"), 4) % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    prefix, middle = F.substring("text", 1, F.col("a")), F.substring("text", F.col("a") + 1, F.col("b") - F.col("a"))
    suffix = F.substring("text", F.col("b") + 1, F.length("text"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "plain", F.col("text")).when(
        F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return d.select("doc_id", "n", "form", F.when(cut, F.col("a").cast("long")).alias("prefix_chars"),
                    F.when(cut, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from.  Texts that hold a marker are plain, so
    each marker stands exactly once in any other output."""
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    middle = F.split_part(output, m, F.lit(2))
    head = F.split_part(output, m, F.lit(1))
    psm = F.concat(F.split_part(F.split_part(head, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(head, s, F.lit(2)))
    spm = F.concat(F.split_part(head, p, F.lit(2)), middle, F.split_part(F.split_part(head, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


#: DuckDB: the same rows from token lists.
ORACLE = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
  h AS (SELECT *, len(u) AS n, CAST('0x' || k[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || k[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || k[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || k[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
  p AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid,
    array_to_string(u[greatest(x, y) + 1:], '') AS suf FROM h)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p"""
