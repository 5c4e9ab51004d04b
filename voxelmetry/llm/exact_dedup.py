"""Exact deduplication: rows are grouped by a 128-bit hash of their text, and the bytes inside groups are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmetry.llm.common import pick
from voxelmetry.session import cut_lineage


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hasher: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the hash of the text.

    The first pass reads the texts once and writes a narrow table (id, hash, digest). Groups are counted on it, with
    partial counts before the shuffle. Only texts whose hash occurs more than once are looked at again: the smallest
    and the largest text of a group, also combined before the shuffle, are equal exactly if all its bytes are. A hash
    under which two texts meet is split by text, so a collision never joins different texts.

    ``keep``: the row with the ``smallest`` or the ``largest`` id of a group stays.
    Null text counts as empty. A null id is worse than any other, and ``keep_id`` is null only where a whole group has
    null ids. Of rows that repeat the staying id and text, one is kept. An empty table gives an empty result. Columns
    of other names are never read, so they may be called anything.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    docs = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(
        docs.select(
            "doc_id", F.monotonically_increasing_id().alias("_row"),
            hasher(text).alias("text_hash"), F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        ),
        "copies",
    )
    clashing = _collisions(docs.select(text.alias("_text"), hasher(text).alias("text_hash")), rows)
    # texts that share a hash are told apart by their digest; everywhere else the hash alone names the group
    if clashing is None:
        rows = rows.withColumn("_variant", F.lit(""))
    else:
        rows = rows.join(clashing.withColumn("_clash", F.lit(True)), "text_hash", "left").withColumn(
            "_variant", F.when(F.col("_clash"), F.col("text_sha256")).otherwise("")
        ).drop("_clash")
    if keep == "smallest":
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    else:
        best = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("id"), (-F.col("_row")).alias("row")))
    groups = (
        rows.groupBy("text_hash", "_variant").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        .select("text_hash", "_variant", F.col("b.id").alias("keep_id"), F.abs("b.row").alias("_keep_row"), "group_size")
    )
    groups = cut_lineage(groups, "groups")  # its size is known then, and rows are not dealt by hash where it is small
    single = F.col("group_size").isNull()
    return rows.join(groups, ["text_hash", "_variant"], "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        "text_sha256", "text_hash",
    )


def _collisions(texts: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Hashes that stand for more than one text, or None; found by comparing bytes."""
    repeated = cut_lineage(rows.groupBy("text_hash").count().where("count > 1").select("text_hash"), "repeated")
    bounds = texts.join(repeated, "text_hash", "left_semi").groupBy("text_hash").agg(F.min("_text").alias("a"), F.max("_text").alias("b"))
    clashing = cut_lineage(bounds.where("a <> b").select("text_hash"), "collisions")
    return None if clashing.isEmpty() else clashing


def staying_rows(docs: DataFrame, stay: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``stay`` (_id, _hash: distinct ids and content hashes) names, with all their columns.

    Rows that repeat an id and its text are one document: the first of them stays. Which of them are repeated is found
    on the narrow columns, so that the grouping of whole rows runs over those only.
    """
    names = list(docs.columns)
    flat = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own_id, own_text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    keyed = flat.withColumn("_own", content_hash(F.coalesce(own_text, F.lit(""))))
    copies = keyed.groupBy(own_id.alias("_cid"), F.col("_own").alias("_chash")).agg(F.count(F.lit(1)).alias("_copies"))
    match = F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_hash") == F.col("_chash"))
    stay = cut_lineage(stay.join(copies, match).select("_id", "_hash", "_copies"), "staying")
    found = keyed.join(stay, own_id.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    once = found.where("_copies = 1").select(flat.columns)
    if not stay.where("_copies > 1").isEmpty():
        once = once.unionByName(found.where("_copies > 1").dropDuplicates(["_id", "_hash"]).select(flat.columns))
    return once.toDF(*names)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that ``exact_copies`` keeps, with all their columns."""
    kept = exact_copies(docs, id_col, text_col, keep).where("kept")
    return staying_rows(docs, kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), id_col, text_col)
