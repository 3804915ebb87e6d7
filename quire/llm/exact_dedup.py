"""Exact duplicates by two passes over a Bloom filter (operator 8).

Pass 1 counts the rows that fall on each slot of a bit field by a hash of the normalised text, and then, of the rows that share their slot, those on each slot
of a second field by another hash. The slots that two or more rows share, as bitmaps, are a Bloom filter of all hashes that may be repeated. Pass 2 tests each row
against it: a row with a slot of its own in either field has no copy and passes straight through; only the others shuffle, to be
grouped by the SHA-256 of their text. So pass 1 moves one small record a row, and few more. The filter decides only who shuffles, so its size can't change the result.

The field takes `bits_per_row` bits a row up to `max_bits`, so a broadcast bitmap is at most max_bits / 8 bytes (64 MB
by default). Beyond that many rows its hit rate rises and more rows shuffle: digests, not texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import ascii_lower, packed, staged, unpacked

PER_BUCKET = 32768  # bits of a bitmap of bitmap_construct_agg


def _bit(bitmap, slot):
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def maybe_repeated(rows: DataFrame, hashes: list[str], bits_per_row: int = 16, max_bits: int = 1 << 29) -> DataFrame:
    """rows with a column `maybe`: false only where no other row has the same hashes."""
    bits = min(max_bits, 1 << max(15, (bits_per_row * rows.count()).bit_length()))
    rows = rows.withColumn("maybe", F.lit(True))
    for k, h in enumerate(hashes):
        slot = (F.pmod(F.col(h), F.lit(bits)) + 1).cast("int")
        shared = rows.filter("maybe").select(slot.alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
        shared = shared.groupBy(F.bitmap_bucket_number("slot").alias(f"bucket{k}")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(f"bitmap{k}"))
        shared = staged(shared, "bloom")  # bits / 8 bytes at most
        rows = rows.join(F.broadcast(shared), F.bitmap_bucket_number(slot) == F.col(f"bucket{k}"), "left")
        rows = rows.withColumn("maybe", F.col("maybe") & _bit(F.col(f"bitmap{k}"), slot)).drop(f"bucket{k}", f"bitmap{k}")
    return rows


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, bits_per_row: int = 16, max_bits: int = 1 << 29) -> DataFrame:
    """Each row of df, without the text unless keep_text, with keep_id, group_size, kept and text_sha256.

    Texts are equal if they are identical once A-Z are lower case; null counts as empty. The row with the largest id stays; of
    repeated rows with that id one stays, and null ids are below all others. An empty table gives no rows. Columns of df
    with the names of the new ones make way for them.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    drop = () if keep_text else (text_col,)
    digests = packed(df, drop, id=F.col(id_col), sha=F.sha2(text, 256), h0=F.xxhash64(text), h1=F.xxhash64(F.lit(1), text), tag=F.monotonically_increasing_id())
    digests = staged(digests, "digests")
    rows = maybe_repeated(digests, ["h0", "h1"], bits_per_row, max_bits)
    alone = unpacked(rows.filter(~F.col("maybe")), keep_id=F.col("id"), group_size=F.lit(1).cast("long"), kept=F.lit(True), text_sha256=F.col("sha"))
    again = rows.filter("maybe")
    groups = again.groupBy(F.col("sha").alias("of")).agg(F.max(F.struct("id", "tag")).alias("top"), F.count("*").alias("n"))
    groups = staged(groups, "groups")  # read anew, so that the join has shuffles of its own, of which a hot group's can be split
    again = again.join(groups, F.col("sha") == F.col("of"))
    again = unpacked(again, keep_id=F.col("top.id"), group_size=F.col("n"), kept=F.col("tag") == F.col("top.tag"), text_sha256=F.col("sha"))
    return alone.unionByName(again)
