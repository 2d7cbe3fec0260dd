"""Near-duplicates by word shingles: Jaccard similarity of the sets of five-word shingles, at 0.8 or more.

Candidates come from SimHash: the sets' fingerprints of 64 majority bits are linked at four differing bits or fewer by the
operator of ``simhash`` (segments on a ring, chains, star contraction), and the sets of a component are one group. At 0.8
fingerprints lie 8 bits apart, with a spread of 3, and a radius that holds them all has far more chance pairs than true
ones in a large corpus; so what four bits don't hold comes from min-hash bands beside them: 20 keys of four minima each, of
which a pair at similarity 0.8 shares one in all but 0.00003 of cases, and one at 0.9 practically always. Every link is
then decided by the exact similarity of the two sets; sets go only to the groups whose members share a key or a component.

Texts of the same set are collapsed first. Groups of the same members are compared once. In a group, a set that is
reached is taken out of what is left to be searched, so a dense group costs about its size; what is emitted is a
spanning forest, whose links become components by star contraction.

Cases: a text of under five words is one shingle; null and empty texts have the empty set and are copies of each
other; rows without an id are never dropped and drop nothing; rows that share an id are told apart by their texts.
A group is held in memory by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.durable import checkpoint, components, hot_keys, join_split
from millrace.llm.slices import slices, small_batches, tidy

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 4
U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode(errors="replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    a, b = starts[: max(1, len(words) - SHINGLE + 1)].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in zip(a, b)], np.uint64))


def digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set, which has no near copies but its like."""
    if not len(found):
        return found
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 512):
        x = found[k : k + 512, None] * _TIMES + _PLUS
        low = np.minimum(low, (x ^ (x >> U(31))).min(0))
    return np.array([xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64)


def links_within(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Pairs of places that span the components of sets at ``similar`` or more."""
    size = np.array([len(s) for s in sets])
    rest = np.arange(1, len(sets))
    queue, out = [0], []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        k = queue.pop()
        fits = np.minimum(size[rest], size[k]) >= similar * np.maximum(size[rest], size[k]) - 1e-9
        hit = np.zeros(len(rest), bool)
        at = np.flatnonzero(fits)
        for part in np.array_split(at, len(at) // 256 + 1):
            if not len(part):
                continue
            pool = np.concatenate([sets[rest[p]] for p in part])
            place = np.searchsorted(sets[k], pool)
            same = (sets[k][np.minimum(place, size[k] - 1)] == pool).astype(np.int64)
            both = np.add.reduceat(same, np.append(0, np.cumsum(size[rest[part]])[:-1]))
            hit[part] = both >= similar * (size[rest[part]] + size[k] - both) - 1e-9
        out += [(k, int(r)) for r in rest[hit]]
        queue += rest[hit].tolist()
        rest = rest[~hit]
    return out


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: the bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(found), 4096):
        counts += np.unpackbits(found[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > len(found)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _groups(keyed: DataFrame) -> DataFrame:
    """(gid, digest): members of keys that two digests or more share; keys of the same members give one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, members = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def grouped(k: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(edge, len(k)))
            gid, out = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for at, n in zip(edge[size > 1].tolist(), size[size > 1].tolist()):
                own = m[at : at + n]  # in order of digest
                own = own[np.append(True, own[1:] != own[:-1])]
                if len(own) > 1:
                    gid.append(np.full(len(own), xxhash.xxh64_intdigest(own.tobytes(), 3), np.uint64))
                    out.append(own)
            return pa.RecordBatch.from_arrays([_signed(np.concatenate(gid)), pa.array(np.concatenate(out))], names=["gid", "digest"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.append(keys, batch.column(0).to_numpy(zero_copy_only=False))
            members = np.append(members, batch.column(1).to_numpy(zero_copy_only=False))
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut:
                yield grouped(keys[:cut], members[:cut])
                keys, members = keys[cut:], members[cut:]
        if len(keys):
            yield grouped(keys, members)

    return keyed.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(tidy(run), "gid long, digest long").distinct()


def _components(prints: DataFrame) -> DataFrame:
    """(key, digest) of ``prints`` (digest, fp): a key for each component of fingerprints that SimHash links, and for each one by itself."""
    roots = simhash.components(simhash.links(prints.select("fp").distinct()))
    placed = prints.join(roots, prints.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "digest")
    return placed.select(F.xxhash64(F.lit("simhash"), "root").alias("key"), "digest")


def rows_of_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, low: struct of the two, the least of the component): a row for every row of ``docs``."""
    source = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 2)):
            found = [shingles(x.as_py()) for x in batch.column(2)]
            keys = [band_keys(s).view(np.int64) for s in found]
            ends = np.cumsum([0, *(len(k) for k in keys)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
            prints = pa.array(np.array([fingerprint(s) for s in found], np.uint64).view(np.int64), mask=np.array([not len(s) for s in found], bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(np.array([digest(s) for s in found], np.uint64)), prints, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "text_hash", "digest", "fp", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (s for b in batches for s in slices(b, 0)):
            ids, data = [], []
            for x in batch.column(0):
                s = shingles(x.as_py())
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    ids.append(d)
                    data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([_signed(np.array(ids, np.uint64)), pa.array(data, pa.binary())], names=["digest", "found"])

    def link(group: pa.Table) -> pa.Table:
        ids = group.column("digest").to_numpy()
        pairs = links_within([np.frombuffer(x.as_py(), np.uint64) for x in group.column("found")])
        return pa.table({"u": pa.array([int(ids[a]) for a, _ in pairs], pa.int64()), "v": pa.array([int(ids[b]) for _, b in pairs], pa.int64())})

    each = checkpoint(source.mapInArrow(tidy(sketch), "doc_id long, text_hash long, digest long, fp long, keys array<long>"))
    # rows without an id neither drop others nor are dropped, so they don't link either
    named = each.filter("doc_id IS NOT NULL")
    prints = checkpoint(named.filter("fp IS NOT NULL").select("digest", "fp").distinct())
    bands = named.groupBy("digest").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "digest")
    groups = checkpoint(_groups(_components(prints).unionByName(bands)))
    wanted = groups.select("digest").distinct()
    found = source.filter("doc_id IS NOT NULL").select("text").mapInArrow(tidy(sets), "digest long, found binary").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("found").alias("found"))
    edges = groups.join(found, "digest").groupBy("gid").applyInArrow(link, "u long, v long").distinct()
    roots = components(edges)
    least = named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("low"))
    placed = checkpoint(least.join(roots, least.digest == roots.node, "left").select("digest", "low", F.coalesce("root", "digest").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("low"))
    of_set = join_split(placed.select("digest", "root"), lowest, "root", "digest", hot_keys(placed, "root")).select("digest", "low")
    rows = named.select("doc_id", "text_hash", "digest")
    return join_split(rows, of_set, "digest", "text_hash", []).select("doc_id", "text_hash", "low")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each component of near copies the row of the smallest id, and the rows without an id."""
    rows = checkpoint(rows_of_groups(docs, text, key))
    gone = rows.filter("low <> struct(doc_id, text_hash)").select("doc_id", "text_hash").distinct()
    marked = docs.withColumn("_id", F.col(key).cast("long")).withColumn("_hash", F.xxhash64(text))
    kept = marked.join(gone, (F.col("_id") == gone.doc_id) & (F.col("_hash") == gone.text_hash), "left_anti")
    again = rows.filter("low = struct(doc_id, text_hash)").groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    if again:
        kept = kept.filter("_id IS NOT NULL").dropDuplicates(["_id", "_hash"]).unionByName(kept.filter("_id IS NULL"))
    return kept.select(docs.columns)
