"""Hashes that several owners hold, found by a shuffle of packed bytes instead of rows.

Tasks gather owners' hashes in chunks. A hash that `least` owners of one chunk hold is settled there and goes out once,
under the name 0; of any other hash at most `least` - 1 owners are named. So a hash of any number of owners is shipped
a few times a chunk, and a bucket's task holds no hot key. A key has 40 bits beside those of its bucket: what is found
is a superset of what is shared, larger by chance alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Hashes in a bucket on average, and the least number of buckets.
BUCKET, BUCKETS = 1 << 23, 64
#: Hashes that a task gathers before it ships them.
CHUNK = 1 << 19
SCHEMA = "bucket int, known boolean, keys binary, refs binary, times binary"
_WIDE = np.uint64((1 << 40) - 1)


def count(total: int) -> int:
    """How many buckets take this many hashes, a power of 2."""
    return max(BUCKETS, 1 << max(0, total // BUCKET).bit_length())


def keys_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """What stands for each hash: the bits of its bucket and 40 others."""
    return (hashes & np.uint64(buckets - 1)) << np.uint64(40) | hashes >> np.uint64(20) & _WIDE


def _rows(keys: np.ndarray, owner: np.ndarray, names: np.ndarray, known: bool) -> Iterator[tuple]:
    """Rows of SCHEMA, one for each bucket: its keys, 5 bytes each, by owner."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(40)).astype(np.int64)
    order = np.lexsort((owner, bucket))
    keys, owner, bucket = keys[order], owner[order], bucket[order]
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    run = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
    ends, of = np.append(run, len(keys)), bucket[run]
    times, name = np.diff(ends).astype("<u4"), np.append(names, 0)[owner[run]]  # owner -1 has the name 0
    edge = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of))
    for a, b in zip(edge, edge[1:]):
        yield int(of[a]), known, low[ends[a] : ends[b]].tobytes(), name[a:b].tobytes(), times[a:b].tobytes()


def shipped(hashes: list[np.ndarray], refs: list[int], buckets: int, least: int) -> Iterator[tuple]:
    """A chunk's rows of SCHEMA: hashes holds each owner's distinct hashes, refs the owners' names (not 0)."""
    names, keys = np.array(refs, np.int64), keys_of(np.concatenate(hashes), buckets)
    owner = np.repeat(np.arange(len(refs)), [len(h) for h in hashes])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    settled = np.diff(np.append(first, len(keys))) >= least
    each = np.repeat(settled, np.diff(np.append(first, len(keys))))
    yield from _rows(keys[each], owner[each], names, True)
    once = keys[first[settled]]
    yield from _rows(np.concatenate([keys[~each], once]), np.concatenate([owner[~each], np.full(len(once), -1)]), names, False)


def batch(rows: Iterator[tuple]) -> pa.RecordBatch:
    """Rows of SCHEMA for Arrow."""
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "known", "keys", "refs", "times"])


def shared(rows: Iterator[tuple], bucket: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket's rows (known, keys, refs, times): names and keys, wherever `least` owners hold the key."""
    told_k, told_r, keys, refs = [], [], [], []
    for known, k, r, t in rows:
        wide = np.zeros((len(k) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(k, np.uint8).reshape(-1, 5)
        (told_k if known else keys).append(wide.reshape(-1).view("<u8"))
        (told_r if known else refs).append(np.repeat(np.frombuffer(r, "<i8"), np.frombuffer(t, "<u4").astype(np.int64)))
    if keys:
        key, ref = np.concatenate(keys), np.concatenate(refs)
        order = np.lexsort((ref, key))
        key, ref = key[order], ref[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        once = new | np.concatenate([[True], ref[1:] != ref[:-1]])  # copies of one owner are not two
        at = np.cumsum(new) - 1
        enough = (np.bincount(at[once & (ref != 0)], minlength=at[-1] + 1) >= least) | (np.bincount(at, weights=ref == 0) > 0)
        own = once & enough[at] & (ref != 0)
        told_k.append(key[own])
        told_r.append(ref[own])
    return np.concatenate(told_r), np.concatenate(told_k) | np.uint64(bucket) << np.uint64(40)
