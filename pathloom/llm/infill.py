"""Fill-in-the-middle by relations: units, running sums of their lengths, cuts joined by unit ordinal, substrings.

A text is a row of units, runs of letters or single other characters. The relations of a document never leave the task
that holds its text: in Arrow batches units become rows of an array, their lengths are summed along, two cut requests a
document meet them by ordinal, and the offsets go back beside the text, where Spark takes the substrings. Nothing is
shuffled. (As exploded rows with windows and joins the texts have to be shuffled to their offsets; see the README.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
#: Characters of the texts whose units are held at a time, but for a longer single text.
HELD = 1 << 20


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits that follow from the id alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def unit_ends(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of texts whose code points follow each other: how many each text has, and the characters up to each unit's end, by text."""
    letter = ((codes | 0x20) >= ord("a")) & ((codes | 0x20) <= ord("z"))
    text = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.ones(len(codes), bool)
    begins[1:] = ~(letter[1:] & letter[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(begins)
    lengths = np.diff(np.append(first, len(codes)))
    counts = np.bincount(text[first], minlength=len(sizes))
    before = np.concatenate(([0], np.cumsum(sizes)))[:-1]  # characters of the texts before
    return counts, np.cumsum(lengths) - np.repeat(before, counts)


def _offsets(texts: list[str], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, and the characters before the two cuts, of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    counts, ends = unit_ends(codes, sizes)
    n, first = counts.astype(np.int64), np.concatenate(([0], np.cumsum(counts)))[:-1]
    requests = np.sort(np.stack((h1 % (n + 1), h2 % (n + 1))), axis=0)
    found = [np.where(r > 0, np.append(ends, 0)[first + r - 1], 0) for r in requests]  # request r meets the r-th unit of its text
    return n, *found


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, h1, h2, h3, h4) to (doc_id, text, n, a, b, h3, h4), as many texts at a time as HELD allows."""
    names = ["doc_id", "text", "n", "a", "b", "h3", "h4"]
    for batch in batches:
        sizes = np.asarray(pa.compute.utf8_length(batch["text"]))
        part = np.cumsum(sizes) // HELD
        for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
            if len(at):
                own = batch.slice(at[0], len(at))
                found = _offsets(own["text"].to_pylist(), np.asarray(own["h1"]), np.asarray(own["h2"]))
                columns = [own["doc_id"], own["text"], *(pa.array(x, pa.int64()) for x in found), own["h3"], own["h4"]]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def infill(docs: DataFrame, keep: float = 0.9, spm: float = 0.2) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix and output of every row of ``docs`` (doc_id, text).

    ``keep`` is the share of texts that is cut at all, ``spm`` the share of these whose suffix comes first; both are
    taken in whole hundredths, and the draws follow from the id alone, so reruns agree. A null text counts as empty. An
    empty text, and one that holds a mark, stays plain: its parts are null and its output is the text. Rows without an id
    draw alike. Repeated rows are answered one by one. Texts of any length are cut whole; equal draws leave the middle
    empty. Other columns, whatever their names, are not read, and an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *(h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col("doc_id")))))
    rows = own.mapInArrow(_planned, "doc_id long, text string, n long, a long, b long, h3 long, h4 long")
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= round(100 * keep))
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < round(100 * spm), "spm").otherwise("psm"))
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    cut = F.col("form") != "plain"
    prefix = F.when(cut, F.substr("text", F.lit(1), a))
    middle = F.when(cut, F.substr("text", a + 1, b - a))
    suffix = F.when(cut, F.substr("text", b + 1))
    out = rows.select("doc_id", "n", "form", "text", prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))
    p, s, m = (F.lit(x) for x in MARKS)
    psm, spm_ = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    return out.withColumn("output", output).drop("text")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from."""
    at = lambda mark: F.instr(output, F.lit(mark))
    p, s, m = (at(x) for x in MARKS)
    between = lambda start, stop: F.substr(output, start + 3, stop - start - 3)
    middle = F.substr(output, m + 3)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_query(spark, sf_dir: str) -> DataFrame:
    """op11: all documents, nine of ten cut, a fifth of these with the suffix first."""
    found = infill(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


INFILL_SQL = """
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
draws AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
cuts AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""
