"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size, given by
an offset and a step from hashes of its name. Shards take turns, each claiming its
most preferred free slot, until the table is full, so that shards own equally many slots but
for one, and adding a shard moves few slots. A key's slot is its hash modulo the
table size; the table travels as one literal, so placing a row is one array access.

Defined cases: a null key counts as empty text; equal keys share a shard, so repeated rows do; a very
long key is hashed whole; columns slot and shard that the table has already are replaced (unless one of
them is the key), all others, whatever their names, are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

SHARDS, SLOTS = 16, 1_627
#: The largest table that may travel with the tasks.
MAX_SLOTS = 1 << 20


def hash60(text: str) -> int:
    """The first 15 hexadecimal digits of the MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in names) that owns each slot."""
    if not names or slots > MAX_SLOTS or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"shards are needed, and a prime number of slots up to {MAX_SLOTS}")
    at = [hash60(f"offset {n}") % slots for n in names]
    step = [hash60(f"step {n}") % (slots - 1) + 1 for n in names]
    owner = [-1] * slots
    for turn in range(slots):
        k = turn % len(names)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        owner[at[k]] = k
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % slots


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def place(docs: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """docs with columns for the slot and the shard."""
    # one text, which the optimiser folds into one array
    table = F.split(F.lit(",".join(map(str, lookup_table(names or shard_names(), slots)))), ",").cast("array<int>")
    slot = slot_of(column(key), slots)
    own = [column(x) for x in docs.columns if x not in (slot_col, shard_col) or x == key]
    return docs.select(*own, slot.alias(slot_col), F.element_at(table, (slot + 1).cast("int")).alias(shard_col))


#: The same table by recursion in DuckDB: state is the owners so far, one turn a row.
ORACLE_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT k, printf('shard-%04d', k) AS name FROM range({SHARDS}) t(k)),
orders AS (
  SELECT k, ('0x' || substr(md5('offset ' || name), 1, 15))::BIGINT % {SLOTS} AS a,
         ('0x' || substr(md5('step ' || name), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS b FROM shards),
prefs AS (
  SELECT list(p ORDER BY k) AS lists FROM (
    SELECT k, list((a + b * j) % {SLOTS} ORDER BY j) AS p FROM orders, range({SLOTS}) r(j) GROUP BY k)),
fill AS (
  SELECT 0 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS owner
  UNION ALL
  SELECT turn + 1, list_transform(range({SLOTS}), lambda s: CASE WHEN s = claimed THEN turn % {SHARDS} ELSE owner[s + 1] END)
  FROM (SELECT turn, owner, list_filter(lists[turn % {SHARDS} + 1], lambda s: owner[s + 1] = -1)[1] AS claimed
        FROM fill, prefs WHERE turn < {SLOTS}))
SELECT doc_id, slot, owner[slot + 1]::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents),
     (SELECT owner FROM fill WHERE turn = {SLOTS})
"""
