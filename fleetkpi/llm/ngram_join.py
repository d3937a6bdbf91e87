"""N-gram Jaccard join by PartEnum signatures.

Sets are 5-word shingles (`words.shingle_sets`). Two texts link when their sets have a Jaccard
similarity of at least `percent` / 100; the result is exact.

Sizes are cut into bands so that a set and any partner lie in the same or in the next band. For the
pairs of a band, similarity bounds how many shingles differ: at most k. The domain of shingles is
cut into n1 > k + 1 equal ranges of the hash, and the part of a set in a range is one signature: two
linked sets differ in at most k ranges and agree on the rest. Of its non-empty parts each set hands
in the k + 1 first in one order for all, most shingles first, so that two linked sets share at least
one signature, and parts that only hold a passage which many texts share are mostly left out. A set
with k non-empty parts or fewer hands in all of them, and its single shingles besides, which find
the partners that are equally short of parts.

Signatures travel as packed arrays, one row for a task and bucket. In a bucket, texts with the same
signature are tied to the smallest one (a star, not all pairs); sets decide which ties hold. Where a
tie fails, the other members of that signature are compared too, unless they are connected anyway: in
rounds, in which each hands in a few pairs, until all are connected or refuted.

Each set also has a parity sketch, about two bits a shingle, in which a shingle flips one bit. Two
sketches differ in no more bits than their sets differ in shingles, so a pair whose sketches differ
too much is out without its sets; sets are moved for the few pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .bits import id_filter
from .components import components
from .words import Words, mix, shingle_sets, slices, texts

PERCENT = 80
#: Signatures that a task packs before it hands them on.
FLUSH = 1_000_000
#: Pairs for each member of a list that it hands in at first; where there are more, pairs that a member or two components hand in. Four times as many in each further round.
CROSS = 16
#: Lists with more members hand in a quarter of that: what holds or fails in one of them settles many others.
LONG = 256
#: Cells of a table of pairs, or words of their sketches, that a task looks at together.
CELLS = 1 << 20
LARGEST = 1 << 31

FACTS = "doc_id bigint, n_shingles bigint, key_1 bigint, key_2 bigint, sketch binary"
PACKED = "bucket int, docs binary, counts binary, signatures binary"
FOUND = "a bigint, b bigint, members array<bigint>, list_key bigint"


class Bands:
    """First size, k and n1 of each band of sizes."""

    def __init__(self, percent: int):
        first = [1]
        while first[-1] < LARGEST:
            first.append(first[-1] * 100 // percent + 1)
        top = np.array(first[1:]) - 1
        partner = top * 100 // percent
        self.first = np.array(first[:-1])
        self.k = (top + partner) * (100 - percent) // (100 + percent)
        self.parts = np.where(self.k > 0, np.ceil(1.25 * (self.k + 1)).astype(np.int64) + 3, 1)
        #: Largest size that has a partner in the band before.
        self.reach = np.concatenate(([0], partner[:-1]))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, "right") - 1


def set_keys(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two columns."""
    sizes = np.diff(edges)
    out = []
    for salt in (np.uint64(0x51ED270B1), np.uint64(0x9D39247E33776D41)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ salt), dtype=np.uint64)))
        out.append(mix(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(values: np.ndarray, edges: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """56-bit signatures of sets in the instance that `band` names for each; and how many each has."""
    sizes = np.diff(edges)
    parts, k = bands.parts[band], bands.k[band]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # sorted hashes fall into ascending ranges, so a part is a run
    part = ((values >> np.uint64(32)) * parts.astype(np.uint64)[owner]) >> np.uint64(32)
    new = np.ones(len(values), bool)
    new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    salt = mix(band.astype(np.uint64) + np.uint64(1))
    sums = np.add.reduceat(mix(values), at)
    count = np.diff(np.append(at, len(values)))
    whose = owner[at]
    hashed = mix(sums ^ salt[whose]) >> np.uint64(8)
    order = hashed | ((np.uint64(255) - np.minimum(count, 255).astype(np.uint64)) << np.uint64(56))
    own = np.bincount(whose, minlength=len(sizes))
    ends = np.cumsum(own)
    chosen, numbers = [], np.zeros(len(sizes), np.int64)
    for i, (a, b, most) in enumerate(zip((ends - own).tolist(), ends.tolist(), (k + 1).tolist(), strict=True)):
        if b - a > most:
            order[a:b].sort()
            chosen.append(order[a : a + most])
        elif b > a:
            chosen.append(order[a:b])
            if b - a < most:
                chosen.append(mix(values[edges[i] : edges[i + 1]] + salt[i]) >> np.uint64(8))
        numbers[i] = min(b - a, most) + (sizes[i] if b - a < most else 0)
    mask = np.uint64((1 << 56) - 1)
    return np.concatenate(chosen) & mask, numbers


def sketches(values: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Parity of the shingles of each set in a power of two of cells, two to four for a shingle."""
    sizes = np.diff(edges)
    logs = np.maximum(np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), 8)
    begin = np.concatenate(([0], np.cumsum(1 << logs)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cells = (values >> np.uint64(7)) & ((np.uint64(1) << logs.astype(np.uint64)) - np.uint64(1))[owner]
    odd = np.bincount(begin[:-1][owner] + cells.astype(np.int64), minlength=begin[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch with fewer cells: halves laid over each other."""
    words = np.frombuffer(sketch, np.uint64)
    while len(words) > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Words]:
    words = Words(*texts(batch.column("text")), lower=True)
    values, edges = shingle_sets(words)
    return values, edges, words


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values, edges, _ = _sets(part)
            one, two = set_keys(values, edges)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(edges).astype(np.int64)), pa.array(one), pa.array(two), pa.array(sketches(values, edges), pa.binary())],
                ["doc_id", "n_shingles", "key_1", "key_2", "sketch"],
            )


def _packer(buckets: int, percent: int):
    bands = Bands(percent)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id")
                values, edges, _ = _sets(part)
                sizes = np.diff(edges)
                keys = set_keys(values, edges)[0]
                valid = ids.is_valid().to_numpy(zero_copy_only=False)
                own = ids.fill_null(0).to_numpy()
                use = np.flatnonzero(valid & (sizes > 0))
                # equal sets link by their keys; the first one here stands for all
                use = np.array([i for i in use.tolist() if not (keys[i] in seen or seen.add(keys[i]))], np.int64)
                if not len(use):
                    continue
                band = bands.of(sizes[use])
                for which, rows in ((band, use), (band - 1, use[(band > 0) & (sizes[use] <= bands.reach[band])])):
                    if which is not band:
                        which = bands.of(sizes[rows]) - 1
                    if not len(rows):
                        continue
                    picked = np.concatenate([values[edges[i] : edges[i + 1]] for i in rows.tolist()])
                    cuts = np.concatenate(([0], np.cumsum(sizes[rows])))
                    sigs, numbers = signatures(picked, cuts, which, bands)
                    held.append((sigs, np.repeat(own[rows], numbers)))
                    total += len(sigs)
                if total > FLUSH:
                    yield _bucketed(held, buckets)
                    held, total = [], 0
        if held:
            yield _bucketed(held, buckets)

    return pack


def _bucketed(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    sigs = np.concatenate([s for s, _ in held])
    docs = np.concatenate([d for _, d in held])
    bucket = ((sigs >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32 if buckets > 65535 else np.uint16)
    order = np.argsort(bucket, kind="stable")
    low, docs, bucket = sigs[order].astype(np.uint32), docs[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows: list[tuple[int, bytes, bytes, bytes]] = []
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if b > a:
            d = docs[a:b]
            at = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            count = np.diff(np.append(at, len(d))).astype(np.uint32)
            rows.append((i, d[at].tobytes(), count.tobytes(), low[a:b].tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "docs", "counts", "signatures"])


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Texts of one bucket that share a signature: stars, and the members where there are three or more."""
    sigs = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.signatures])
    docs = np.concatenate(
        [
            np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32))
            for d, c in zip(rows.docs, rows.counts, strict=True)
        ]
    )
    order = np.argsort(sigs, kind="stable")
    sigs, docs = sigs[order], docs[order]
    same = sigs[1:] == sigs[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    sigs, docs = sigs[keep], docs[keep]
    order = np.lexsort((docs, sigs))
    sigs, docs = sigs[order], docs[order]
    fresh = np.ones(len(sigs), bool)
    fresh[1:] = (sigs[1:] != sigs[:-1]) | (docs[1:] != docs[:-1])
    sigs, docs = sigs[fresh], docs[fresh]
    if not len(sigs):
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("a", "b", "members", "list_key")})
    at = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
    count = np.diff(np.append(at, len(sigs)))
    rest = np.ones(len(sigs), bool)
    rest[at] = False
    pairs = np.unique(np.stack([np.repeat(docs[at], count)[rest], docs[rest]], 1), axis=0)
    keys = mix(np.add.reduceat(mix(docs.view(np.uint64)), at) + count.astype(np.uint64)).view(np.int64)
    many = np.flatnonzero(count >= 3)
    _, first = np.unique(keys[many], return_index=True)
    lists = many[first]
    members = [None] * len(pairs) + [docs[at[i] : at[i] + count[i]] for i in lists]
    none = [None] * len(lists)
    return pd.DataFrame(
        {
            "a": pd.array([*pairs[:, 0].tolist(), *none], "Int64"),
            "b": pd.array([*pairs[:, 1].tolist(), *none], "Int64"),
            "members": pd.Series(members, dtype=object),
            "list_key": pd.array([*([None] * len(pairs)), *keys[lists].tolist()], "Int64"),
        }
    )


def _set_rows(bits):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.load()
        for batch in batches:
            ids = batch.column("doc_id")
            batch = batch.filter(pa.array(wanted(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(False)))
            for part in slices(batch, "text"):
                values, edges, _ = _sets(part)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "shingles"])

    return rows


def _decided(percent: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, n, m, equal, one, two in batch.itertuples(index=False):
                linked = None
                if equal:
                    linked = True
                elif 100 * min(n, m) < percent * max(n, m):
                    linked = False
                else:
                    size = min(len(one), len(two)) // 8
                    apart = int(np.bitwise_count(_folded(one, size) ^ _folded(two, size)).sum())
                    if apart > (n + m) * (100 - percent) // (100 + percent):
                        linked = False
                out.append((a, b, linked))
            yield pd.DataFrame(out, columns=["a", "b", "linked"])

    return rows


def _verified(docs: DataFrame, facts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with `linked`, from sizes, keys and sketches where they decide, else from the sets."""
    for side in "ab":
        own = facts.select(
            F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n_shingles", "key_1", "key_2", "sketch"))
        )
        pairs = pairs.join(own, side)
    equal = F.expr("key_1_a = key_1_b and key_2_a = key_2_b and n_shingles_a = n_shingles_b")
    known = pairs.select("a", "b", "n_shingles_a", "n_shingles_b", equal.alias("equal"), "sketch_a", "sketch_b")
    known = materialise(known.mapInPandas(_decided(percent), "a bigint, b bigint, linked boolean"))
    decided = _by_sets(docs, known.where("linked is null").select("a", "b"), percent)
    return materialise(known.where("linked is not null").unionByName(decided).groupBy("a", "b").agg(F.max("linked").alias("linked")))


def _by_sets(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with `linked`, from the sets; a row for each two texts of a pair. Pairs are read twice and may repeat."""
    bits = id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    sets = docs.mapInArrow(_set_rows(bits), "doc_id bigint, shingles array<bigint>")
    both = pairs.distinct().join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")), "a"
    )
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    # two empty sets link with nothing
    linked = (common > 0) & (common.cast("bigint") * 100 >= union.cast("bigint") * percent)
    return both.select("a", "b", linked.alias("linked"))


def _bits(sketches: pd.Series, size: int) -> np.ndarray:
    """Sketches folded to `size` words, [row, word]."""
    lengths = sketches.map(len).to_numpy() // 8
    out = np.zeros((len(sketches), size), np.uint64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        # halves laid over each other again and again: words that lie a multiple of `size` apart
        words = np.frombuffer(b"".join(sketches.iloc[at]), np.uint64).reshape(len(at), -1, size)
        out[at] = np.bitwise_xor.reduce(words, axis=1)
    return out


def _cross_pairs(percent: int, most: int):
    def of_one_size(rows: pd.DataFrame, ends: np.ndarray, limit: np.ndarray, budget: np.ndarray, size: int) -> list[np.ndarray]:
        """Places of the pairs' members and whether there may be more of these or their components; `ends`, `limit` and `budget` are those of the lists."""
        ids, group, sizes = (rows[c].to_numpy() for c in ("member", "component", "n_shingles"))
        bits, refuted = _bits(rows["sketch"], size), rows["refuted"].to_numpy()
        found = np.zeros(len(rows), np.int64)
        # pairs of the list that a place belongs to, at the list's last place
        whole = np.zeros(len(rows) + 1, np.int64)
        out = [np.zeros((2, 0), np.int64)]
        active, begin, block = np.arange(len(rows)), 1, 64
        while len(active):
            for part in np.array_split(active, -(-len(active) * block // CELLS)):
                # each member with those that come `begin` to `begin + block` places later in its list
                reach = int(min(block, (ends[part] - part).max() - begin))
                if reach <= 0:
                    continue
                other = part[:, None] + np.arange(begin, begin + reach)
                inside = other < ends[part][:, None]
                other = np.where(inside, other, part[:, None])
                low, high = np.minimum(sizes[part][:, None], sizes[other]), np.maximum(sizes[part][:, None], sizes[other])
                row, column = np.nonzero(inside & (group[other] != group[part][:, None]) & (low * 100 >= high * percent))
                left, right = part[row], other[row, column]
                keep = np.zeros(len(left), bool)
                for at in range(0, len(left), step := max(CELLS // size, 1)):
                    i, j = left[at : at + step], right[at : at + step]
                    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                    keep[at : at + step] = apart <= (sizes[i] + sizes[j]) * (100 - percent) // (100 + percent)
                left, right = left[keep], right[keep]
                keep = np.ones(len(left), bool)
                heads = np.append(np.flatnonzero(np.diff(left, prepend=-1)), len(left)).tolist()
                for a, b in zip(heads[:-1], heads[1:], strict=True):
                    known = refuted[left[a]]
                    if known is not None and len(known):
                        keep[a:b] = ~np.isin(ids[right[a:b]], known)
                left, right = left[keep], right[keep]
                # all pairs of a list that has few, else the first of each member
                nth = np.arange(len(left)) - np.searchsorted(left, left) + found[left]
                inside = (nth < limit[left]) | (whole[ends[left]] <= budget[left])
                left, right = left[inside], right[inside]
                found += np.bincount(left, minlength=len(rows))
                whole += np.bincount(ends[left], minlength=len(whole))
                out.append(np.stack([left, right]))
            begin, block = begin + block, 2 * block
            active = active[((found[active] < limit[active]) | (whole[ends[active]] <= budget[active])) & (active + begin < ends[active])]
        left, right = np.concatenate(out, axis=1)
        many = whole[ends] > budget
        # each member's in the order of their places, as they were found
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        inside = (np.arange(len(left)) - np.searchsorted(left, left) < limit[left]) | ~many[left]
        left, right = left[inside], right[inside]
        # the first of those between the same two components of a list: one that holds connects them
        low, high = np.minimum(group[left], group[right]), np.maximum(group[left], group[right])
        order = np.lexsort((high, low, ends[left]))
        alike = np.stack([ends[left], low, high])[:, order]
        heads = np.flatnonzero(np.concatenate(([True], (alike[:, 1:] != alike[:, :-1]).any(axis=0)))[: len(left)])
        count = np.diff(np.append(heads, len(left)))
        left, right = left[order], right[order]
        kept = (np.arange(len(left)) - np.repeat(heads, count) < limit[left]) | ~many[left]
        more = many[left] & ((np.repeat(count, count) > limit[left]) | (found[left] >= limit[left]))
        return [left[kept], right[kept], more[kept]]

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of members of the same list that are not connected yet and that sizes and sketches let pass.

        A list with at most `most` pairs for each of its members (a quarter of that if it has over `LONG`) hands in
        all of them. In any other each member hands in its first `most` later ones that were not refuted, so the
        rows follow the members, and of these pairs two components hand in no more than that. `list_key` is set
        where there may be more: all open pairs of the other lists are among the rows.
        """
        rows = rows.sort_values(["list_key", "member"], kind="stable", ignore_index=True)
        keys, group = rows["list_key"].to_numpy(), rows["component"].to_numpy()
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.append(at, len(rows)))
        least = np.minimum.reduceat(rows["sketch"].map(len).to_numpy(), at) // 8
        least[np.minimum.reduceat(group, at) == np.maximum.reduceat(group, at)] = 0
        out = []
        for size in np.unique(least[least > 0]).tolist():
            many = count[least == size]
            limit = np.where(many > LONG, max(most // 4, 1), most)
            own = rows[np.repeat(least == size, count)]
            ends, budget = np.cumsum(many), limit * many
            left, right, more = of_one_size(own, *(np.repeat(x, many) for x in (ends, limit, budget)), size)
            ids = own["member"].to_numpy()
            key = pd.array(own["list_key"].to_numpy()[left], "Int64")
            key[~more] = pd.NA
            out.append(pd.DataFrame({"a": ids[left], "b": ids[right], "list_key": key}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "list_key": []}, dtype="Int64")

    return pairs


def _listed(percent: int, most: int):
    pairs = _cross_pairs(percent, most)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of all lists of a task, whose rows come list by list."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch["list_key"].to_numpy()
            # the last list may go on in the next batch; so may the one held
            last = len(keys) - int((keys[::-1] != keys[-1]).argmax()) if keys[0] != keys[-1] else 0
            if last or (held and held[0]["list_key"].iloc[0] != keys[0]):
                yield pairs(pd.concat([*held, batch.iloc[:last]]))
                held = []
            held.append(batch.iloc[last:])
        if held:
            yield pairs(pd.concat(held))

    return rows


def jaccard_components(docs: DataFrame, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id, one row for each row of docs (doc_id, text).

    component_id is the smallest doc_id reached by links, the own one included. A null or empty text,
    or one without words, has no shingles and links with nothing. Rows with one doc_id count as one
    node; a row without doc_id links with nothing and has no component. Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = materialise(docs.mapInArrow(_facts, FACTS))
    solid = facts.where("doc_id is not null and n_shingles > 0")
    first = solid.groupBy("key_1", "key_2", "n_shingles").agg(F.min("doc_id").alias("a"))
    copies = solid.join(first, ["key_1", "key_2", "n_shingles"]).select("a", F.col("doc_id").alias("b")).where("a <> b")

    packed = docs.mapInArrow(_packer(buckets, percent), PACKED)
    found = materialise(packed.groupBy("bucket").applyInPandas(_meet, FOUND))
    ties = _verified(docs, solid, found.where("a is not null").select("a", "b").distinct(), percent)
    edges = copies.unionByName(ties.where("linked").select("a", "b"))

    broken = ties.where("not linked").select("a", "b")
    mixed = (
        found.where("members is not null")
        .withColumn("a", F.col("members")[0])
        .join(broken.withColumnRenamed("b", "x"), "a")
        .where("array_contains(members, x)")
        .dropDuplicates(["list_key"])
        .select("list_key", "members")
    )
    mixed = materialise(mixed)
    grouped = materialise(components(edges))
    # a pair that holds connects its texts, so few pairs of a list need a look; those that fail are not looked at again
    refuted, most = broken, CROSS
    while mixed.limit(1).count():
        members = (
            mixed.select("list_key", F.explode("members").alias("member"))
            .join(grouped.withColumnRenamed("node", "member"), "member", "left")
            .join(solid.select(F.col("doc_id").alias("member"), "n_shingles", "key_1", "key_2", "sketch"), "member")
            .join(refuted.groupBy(F.col("a").alias("member")).agg(F.collect_list("b").alias("refuted")), "member", "left")
            .withColumn("component", F.coalesce("component", "member"))
        )
        # equal sets have the same links and are connected: the smallest one of a list stands for all
        of_set = ["list_key", "n_shingles", "key_1", "key_2"]
        first = F.min(F.struct("member", "component", "sketch", "refuted")).alias("first")
        members = members.repartition("list_key").groupBy(*of_set).agg(first).select("list_key", "n_shingles", "first.*")
        members = members.select("list_key", "member", "component", "n_shingles", "sketch", "refuted").sortWithinPartitions("list_key")
        handed = materialise(members.mapInPandas(_listed(percent, most), "a bigint, b bigint, list_key bigint"))
        if not handed.limit(1).count():
            break
        # sizes and sketches have let these pass, so only their sets are left to compare
        checked = _by_sets(docs, handed.select("a", "b"), percent)
        checked = materialise(checked.groupBy("a", "b").agg(F.max("linked").alias("linked")))
        more = checked.where("linked").select("a", "b")
        if more.limit(1).count():
            grouped = materialise(
                components(grouped.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
            )
        # a list that has handed in all it had is settled: its pairs hold now or are refuted
        left = handed.select("list_key").where("list_key is not null").distinct()
        if not left.limit(1).count():
            break
        mixed = materialise(mixed.join(left, "list_key", "left_semi"))
        refuted = materialise(refuted.unionByName(checked.where("not linked").select("a", "b")))
        most *= 4
    return facts.join(grouped.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
