"""Exact repeats of passages, found with fixed-block anchors.

Reference blocks of ``size // 2`` words, end to end in every document, are indexed; every rolling window of that length
probes them. A passage of ``size`` words holds a whole block wherever it begins, so a repeated passage always has a
probe that meets a block of its other copy. Only around such hits are passages of ``size`` words compared, by
fingerprints of 128 bits, and those with an earlier copy are removed; neighbouring ones run together into maximal repeats.

Documents are dealt into groups, by id, of bounded size. A group sends its distinct fingerprints once, packed by bucket,
and gets back those that met others; so a passage that stands in a third of all rows costs each group one entry, and no
task sees pairs. The text is shuffled once and read three times.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import blocks, windows, within

SIZE = 20
GROUP_BYTES, LEAST_GROUPS = 8 << 20, 256
RESULT = "n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>"


def _sorted(table: pa.Table) -> pa.Table:
    """Rows in an order that doesn't hang on how they arrived; rows without an id come last."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the group's texts one after another, and of each word the row."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in blocks(table.column("text"), fold=False):
        hashes.append(w.hashes())
        rows.append(w.row_of + w.lo)
    return np.concatenate(hashes), np.concatenate(rows)


def _pack(x: np.ndarray) -> bytes:
    """Values byte plane by byte plane: high bytes of small values compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpack(x: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _fresh(code: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Where, among sorted fingerprints of two parts, another one begins."""
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (more[1:] != more[:-1])
    return fresh


def _probes(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, position among the group's words, and offset in its row, of every window of ``length`` words."""
    hashes, rows = _hashes(table)
    at = np.flatnonzero(within(rows, length))
    return windows(hashes, length)[at], at, at - np.searchsorted(rows, rows[at])


def removals(documents: DataFrame, size: int = SIZE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row doc_id, n_words, n_removed, kept_sha256 and the removed word ranges (``removed``, ends exclusive).

    A word goes if a window of ``size`` words that covers it, in one document, also starts earlier: in a row with a
    smaller id, or earlier in the same one. Rows with equal ids are taken as one place, so neither is earlier; rows
    without an id come after all others. Null and empty texts, and texts of under ``size`` words, lose nothing. A text
    is read whole, however long. Ids are whole numbers; others are an error.
    """
    length = size // 2
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(LEAST_GROUPS, math.ceil(total / group_bytes))
    bits = max(9, math.ceil(math.log2(groups / 4)))
    shift = np.uint64(64 - bits)
    grouped = documents.select(F.expr(f"cast(pmod(xxhash64(doc_id), {groups}) as int)").alias("grp"), "doc_id", "text")

    def send(key, table):
        """Distinct probes of a group by bucket: 32-bit tags; whether one is a block, and whether it came more than once."""
        h, _, offset = _probes(_sorted(table), length)
        short = np.uint64(32 - bits)
        code, index, count = np.unique(h >> short, return_inverse=True, return_counts=True)
        block = np.zeros(len(code), bool)
        block[index[offset % length == 0]] = True
        cut = np.searchsorted(code >> np.uint64(32), np.arange((1 << bits) + 1).astype(np.uint64))
        full = np.flatnonzero(np.diff(cut))
        tag = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        parts = [(cut[b], cut[b + 1]) for b in full]
        return pa.table({
            "bucket": pa.array(full.astype(np.int32)),
            "grp": pa.array(np.full(len(full), key[0].as_py(), np.int32)),
            "tags": pa.array([_pack(np.diff(tag[a:b], prepend=np.uint32(0))) for a, b in parts], pa.binary()),
            "block": pa.array([np.packbits(block[a:b]).tobytes() for a, b in parts], pa.binary()),
            "many": pa.array([np.packbits(count[a:b] > 1).tobytes() for a, b in parts], pa.binary()),
        })

    def meet(table):
        """Of each group's probes of this bucket, those that are a block somewhere and came at least twice in all."""
        tags = [np.cumsum(_unpack(x.as_py(), "u4"), dtype=np.uint32) for x in table.column("tags")]
        flag = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(t)) for x, t in zip(table.column(name), tags, strict=True)])
        flat = np.concatenate(tags)
        _, index = np.unique(flat, return_inverse=True)
        seen = np.bincount(index, 1.0 + flag("many"))
        hit = (seen >= 2) & (np.bincount(index, flag("block")) > 0)
        hit = hit[index]
        bucket = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in tags])])
        found = [(flat[a:b][hit[a:b]].astype(np.uint64) | bucket).tobytes() for a, b in zip(edges, edges[1:])]
        out = pa.table({"grp": table.column("grp").cast(pa.int32()), "codes": pa.array(found, pa.binary())})
        return out.filter(pa.array([len(f) > 0 for f in found], pa.bool_()))

    def extend(key, table, hits):
        """Passages around hits. Those that came earlier in the group itself are settled; the first ones are sent on."""
        table = _sorted(table)
        hashes, rows = _hashes(table)
        h = windows(hashes, length)
        codes = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in hits.column("codes"))])
        near = np.isin(h >> np.uint64(32 - bits), codes) & within(rows, length)
        reach = np.concatenate([[0], np.cumsum(near)])
        n = max(0, len(rows) - size + 1)
        at = np.flatnonzero((reach[length + 1 :][:n] > reach[:n]) & within(rows, size)) if n else np.zeros(0, np.int64)
        code, more = windows(hashes, size)[at], windows(hashes, size, True)[at]
        ids = table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)
        row_first = np.searchsorted(rows, np.arange(len(ids)))
        place = np.unique(ids, return_inverse=True)[1][rows[at]] * np.int64(len(rows) + 1) + at - row_first[rows[at]]
        order = np.lexsort((place, more, code))
        fresh = _fresh(code[order], more[order])
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) if len(order) else order
        again = place[order] > place[order][lead]
        settled = np.sort(at[order[again]])
        first = np.sort(order[fresh])
        code, more, at, owner = code[first], more[first], at[first], ids[rows[at[first]]]
        bucket = (code >> shift).astype(np.int32)
        out = {"bucket": [-1 - key[0].as_py()], "grp": [], "codes": [b""], "owner": [b""], "at": [_pack(settled.astype(np.uint32))]}
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange((1 << bits) + 1))
        for b in np.flatnonzero(np.diff(cut)):
            own = by[cut[b] : cut[b + 1]]
            for name, value in (("bucket", int(b)), ("codes", np.concatenate([code[own], more[own]]).tobytes()), ("owner", _pack(owner[own])), ("at", _pack(at[own].astype(np.uint32)))):
                out[name].append(value)
        out["grp"] = [key[0].as_py()] * len(out["bucket"])
        kinds = {"bucket": pa.int32(), "grp": pa.int32(), "codes": pa.binary(), "owner": pa.binary(), "at": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    def settle(table):
        """Of each group's passages of this bucket, the positions of those of which another group has an earlier one."""
        groups_, places = table.column("grp").to_pylist(), [_unpack(x.as_py(), "u4") for x in table.column("at")]
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"grp": pa.array(groups_, pa.int32()), "at": table.column("at").cast(pa.binary())})
        code, more = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in table.column("codes")], 1)
        owner = np.concatenate([_unpack(x.as_py(), "i8") for x in table.column("owner")])
        order = np.lexsort((owner, more, code))
        fresh = _fresh(code[order], more[order])
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        later = np.zeros(len(order), bool)
        later[order] = owner[order] > owner[order][lead]
        edges = np.concatenate([[0], np.cumsum([len(p) for p in places])])
        found = [p[later[a:b]] for p, a, b in zip(places, edges, edges[1:])]
        kept = [i for i, f in enumerate(found) if len(f)]
        return pa.table({"grp": pa.array([groups_[i] for i in kept], pa.int32()), "at": pa.array([_pack(found[i]) for i in kept], pa.binary())})

    def cut(key, table, marks):
        table = _sorted(table)
        at = np.concatenate([np.zeros(0, np.uint32), *(_unpack(x.as_py(), "u4") for x in marks.column("at"))]).astype(np.int64)
        at.sort()
        ids, sizes, lost, digests, ranges, done = table.column("doc_id"), [], [], [], [], 0
        for value in table.column("text"):
            words = (value.as_py() or "").encode().split()
            own = at[np.searchsorted(at, done) : np.searchsorted(at, done + len(words))] - done
            done += len(words)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, own, 1)
            np.add.at(cover, own + size, -1)
            gone = np.cumsum(cover)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(own) else words
            sizes.append(len(words))
            lost.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            ranges.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": ids.cast(pa.int64()), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "removed": pa.array(ranges, kind)})

    by = grouped.groupBy("grp")
    probes = by.applyInArrow(send, "bucket int, grp int, tags binary, block binary, many binary")
    hits = probes.groupBy("bucket").applyInArrow(meet, "grp int, codes binary")
    passages = by.cogroup(hits.groupBy("grp")).applyInArrow(extend, "bucket int, grp int, codes binary, owner binary, at binary")
    marks = passages.groupBy("bucket").applyInArrow(settle, "grp int, at binary")
    return by.cogroup(marks.groupBy("grp")).applyInArrow(cut, f"doc_id long, {RESULT}")
