"""Exact dedup of a batch against the digests seen before, by minimal perfect hashing.

The different digests of the history are dealt into shards of bounded size.
Each shard holds a minimal perfect hash: levels of bit arrays, where a digest
takes the first level in which no other digest shares its bit, and the rank of
the bit is its slot. A slot holds the full digest, the place of the document
that stays, and the number of its copies. A lookup compares all bytes of the
digest with those of the slot, since a digest that was never seen may lead to
any slot. Digests that are no members form classes of their own.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.llm.common import BLANKS, stored

#: Digests of one shard, which one task builds and looks up.
SHARD = 65_536
#: Bits of a level for each digest still without a slot.
SPARSE = 2.0
LEVELS = 64

INDEX = "shard long, sizes binary, bits binary, digests binary, ids binary, uids binary, copies binary"
CLASSES = "digest binary, keep_id long, keep_uid long, group_size long"
#: Fixed for the wire: a missing doc_id in a slot.
NO_ID = -(1 << 63)


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.coalesce(F.regexp_replace(text, BLANKS, " "), F.lit(""))


def classes(rows: DataFrame) -> DataFrame:
    """One row per digest: the first document (null ids last, then row order) and the count.

    Counted before the shuffle, so a text with very many copies is a few rows.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("uid")))
    return rows.groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("copies")).select(
        "digest", F.col("f.doc_id").alias("id"), F.col("f.uid").alias("uid"), "copies")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.view("<u8")


def _bit(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest among the bits of a level."""
    x = words[:, level % 4] ^ np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class Hash:
    """A minimal perfect hash of different 32-byte digests: bits of all levels and their sizes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, words: np.ndarray) -> Hash:
        left, sizes, parts = np.arange(len(words)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(8, int(SPARSE * len(left)))
            at = _bit(words[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("digests repeat within a shard")
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of every member; any slot or -1 for others."""
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + _bit(words[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


def _digests(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _ids(column: pd.Series) -> np.ndarray:
    return column.astype("Int64").fillna(NO_ID).to_numpy(np.int64)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _digests(rows["digest"])
    words = _words(digests)
    perfect = Hash.build(words)
    order = np.argsort(perfect.slots(words))
    return pd.DataFrame({
        "shard": rows["shard"].iloc[:1].to_numpy(), "sizes": [perfect.sizes.tobytes()],
        "bits": [np.packbits(perfect.bits).tobytes()], "digests": [digests[order].tobytes()],
        "ids": [_ids(rows["id"])[order].tobytes()],
        "uids": [rows["uid"].to_numpy(np.int64)[order].tobytes()],
        "copies": [rows["copies"].to_numpy(np.int64)[order].tobytes()],
    })


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index, one row per shard. history: digest, id, uid, copies, digests all different."""
    dealt = history.select("digest", "id", "uid", "copies", _shard(shards))
    return dealt.groupBy("shard").applyInPandas(_build_shard, INDEX)


def _look_up(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    digests = _digests(batch["digest"]) if len(batch) else np.zeros((0, 32), np.uint8)
    ids, uids = _ids(batch["id"]), batch["uid"].to_numpy(np.int64)
    copies = batch["copies"].to_numpy(np.int64)
    if len(index):
        row = index.iloc[0]
        sizes = np.frombuffer(row["sizes"], np.int64)
        perfect = Hash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8))[:sizes.sum()].astype(bool))
        kept = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        total = np.frombuffer(row["copies"], np.int64).copy()
        slot = perfect.slots(_words(digests))
        member = slot >= 0
        member[member] = (kept[slot[member]] == digests[member]).all(axis=1)
        np.add.at(total, slot[member], copies[member])
        digests = np.concatenate([kept, digests[~member]])
        ids = np.concatenate([np.frombuffer(row["ids"], np.int64), ids[~member]])
        uids = np.concatenate([np.frombuffer(row["uids"], np.int64), uids[~member]])
        copies = np.concatenate([total, copies[~member]])
    blob = digests.tobytes()
    return pd.DataFrame({
        "digest": [blob[i * 32:i * 32 + 32] for i in range(len(ids))],
        "keep_id": pd.array(ids, "Int64") if not (ids == NO_ID).any() else pd.Series(ids).astype("Int64").where(ids != NO_ID),
        "keep_uid": uids, "group_size": copies,
    })


def look_up(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """Classes after the batch: digest, keep_id, keep_uid, group_size.

    A digest of the batch that is a member joins its slot; the others follow
    as classes of their own.
    """
    dealt = batch.select("digest", "id", "uid", "copies", _shard(shards))
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(_look_up, CLASSES)


def dedup(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    docs: doc_id, text (further columns are not read). The documents of the
    lower half of the id range are the history, the others the batch, so what
    stays is always the smallest id. Of rows that repeat this id as well, one
    is kept. Null ids come last: a group of null ids alone has a null keep_id.
    Null texts count as empty. An empty table gives no rows.
    """
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "exact-rows")
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = 0 if low is None else (low + high) // 2
    shards = max(1, ceil(n / shard))
    old = F.col("doc_id").isNotNull() & (F.col("doc_id") <= middle)
    index = stored(build_index(classes(rows.where(old)), shards), "exact-index")
    found = look_up(index, classes(rows.where(~old)), shards)
    return rows.join(found, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
