"""Membership filters of a size that follows the number of members, built by tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.scratch import FEW_ROWS
from . import bytesnp as B

SLOT_BITS = 1 << 16
BITS_EACH = 12
MOST_SLOTS = 1 << 12  # 32 MB of bits at most; more members make the filter spare less, never miss one
_SALT = np.uint64(0x9FB21C651E98DF25)


def _places(ids: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each number, and three places in it."""
    h = B.mix(ids.astype(np.int64).view(np.uint64) + _SALT)
    slot = ((h >> np.uint64(48)) * np.uint64(slots)) >> np.uint64(16)
    return slot.astype(np.int64), np.stack([(h >> np.uint64(16 * k)) & np.uint64(SLOT_BITS - 1) for k in range(3)]).astype(np.int64)


def build(numbers: DataFrame) -> np.ndarray:
    """Bits, a row a slot, of a Bloom filter of the one column (longs) of a written frame; nulls are left out."""
    numbers = numbers.toDF("id").where("id is not null")
    count = numbers.count()
    slots = int(max(1, min(MOST_SLOTS, -(-count * BITS_EACH // SLOT_BITS))))
    if count <= FEW_ROWS:
        numbers = numbers.coalesce(1)

    def deal(batches):
        for batch in batches:
            ids = batch.column("id")
            yield pa.record_batch({"id": ids, "slot": pa.array(_places(ids.to_numpy(), slots)[0])})

    def fill(_key: tuple, t: pa.Table) -> pa.Table:
        bits = np.zeros(SLOT_BITS, bool)
        bits[_places(t["id"].to_numpy(), slots)[1]] = True
        return pa.table({"slot": t["slot"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((slots, SLOT_BITS // 8), np.uint8)
    for slot, bits in numbers.mapInArrow(deal, "id long, slot long").groupBy("slot").applyInArrow(fill, "slot long, bits binary").collect():  # MOST_SLOTS rows of 8 KB at most
        out[slot] = np.frombuffer(bits, np.uint8)
    return out


def may_have(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which numbers may be members; a member always is."""
    slot, at = _places(ids, len(filter_))
    return ((filter_[slot, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)
