"""Operator 8: exact dedup by distributed MSD radix partitioning.

Documents are split into groups by successive byte runs of their normalised
text (white space ``[\\x20\\x09-\\x0D]`` deleted), most significant first. The
first digit is the byte length and the leading ``HEAD`` bytes; each later
round takes the next, 16 times longer run. A group that holds one row is done;
a group whose bytes are used up holds equal texts. Equality is decided by the
bytes alone, never by a digest.

One round is an aggregate over (group, next bytes) and a join back to the rows
still open. The aggregate combines in the map tasks, so a group with a third
of all rows sends one row per task; in the join such a key is split by the
adaptive skew join, and nothing needs a whole group in one task. Rows that are
alone leave after the first round, so later rounds only move copies.

Result: one row per input row with ``doc_id, keep_id, group_size, kept,
text_sha256``. Cases: a null text counts as empty, all empty texts are one
group; ties on length go to the smallest id (null ids last); a row repeated
with the same id counts twice and only one of them is kept; an empty table
gives an empty result; other columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.staging import is_empty, merged, stage, table, text_of

SPACE = " \t\n\x0b\x0c\r"
HEAD = 32
WIDTH, GROWTH, MAX_WIDTH = 1024, 16, 1 << 20


def radix_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _uid, _gid, _chars, _sha``: rows of equal text share ``_gid``.

    ``_uid`` numbers the rows; ``_gid`` is the smallest ``_uid`` of the group.
    """
    norm = F.translate(text_of(text_col), SPACE, "").cast("binary")
    base = (df.select(F.col(id_col).alias("_id"), F.length(text_of(text_col)).cast("long").alias("_chars"),
                      norm.alias("_norm"))
            .withColumn("_len", F.octet_length("_norm"))
            .withColumn("_head", F.substring("_norm", 1, HEAD)))
    # Staged, so that both sides of the join are plain scans: only then can the
    # adaptive join split a hot key.
    shared = stage(base.groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("_n"))
                   .filter("_n > 1").select("_len", "_head", F.lit(True).alias("_open")), "shared")
    rows = stage(
        merged(base, shared, ["_len", "_head"], "left").select(
            F.monotonically_increasing_id().alias("_uid"), "_id", "_chars",
            F.sha2("_norm", 256).alias("_sha"), F.when(F.col("_open"), F.col("_len")).alias("_len"),
            F.when(F.col("_open"), F.col("_head")).alias("_head"),
            F.when(F.col("_open"), F.expr(f"substring(_norm, {HEAD + 1})")).alias("_rest")),
        "radix")
    keep = ["_id", "_uid", "_chars", "_sha"]
    done = [rows.filter("_rest is null").select(*keep, F.col("_uid").alias("_gid"))]
    open_rows, keys, width = rows.filter("_rest is not null"), ["_len", "_head"], WIDTH
    while not is_empty(open_rows):
        digit = open_rows.withColumn("_digit", F.substring("_rest", 1, width))
        groups = stage(digit.groupBy(*keys, "_digit").agg(
            F.min("_uid").alias("_to"), F.count(F.lit(1)).alias("_n")), "groups")
        over = (F.col("_n") == 1) | (F.length("_rest") <= width)
        split = stage(
            merged(digit, groups, [*keys, "_digit"]).select(
                *keep, F.col("_to").alias("_gid"),
                F.when(~over, F.expr(f"substring(_rest, {width + 1})")).alias("_rest")),
            "radix")
        done.append(split.filter("_rest is null").select(*keep, "_gid"))
        open_rows, keys, width = split.filter("_rest is not null"), ["_gid"], min(width * GROWTH, MAX_WIDTH)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with its group and whether it is the row kept."""
    rows = radix_groups(df, id_col, text_col)
    best = stage(rows.groupBy("_gid").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"),
                       F.col("_id").alias("i"), F.col("_uid").alias("u"))).alias("_best")), "best")
    return merged(rows, best, "_gid").select(
        F.col("_id").alias(id_col), F.col("_best.i").alias("keep_id"), "group_size",
        (F.col("_uid") == F.col("_best.u")).alias("kept"), F.col("_sha").alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
