"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of 100 bytes that covers it also starts earlier: in a document of smaller id, or further in front
in the same one. Every such string holds a 16-byte gram that is the smallest by hash among its 85 grams; equal
strings hold the same one at the same place. So

1. each part of the documents lists its minimal grams with the runs of window starts they stand for;
2. grams that occur once are left out, by a shuffle of grams alone; so are those whose 42 bytes on neither side come with the
   same gram again, as of the other 84 bytes of a window half at least lie on one side;
3. the text around each gram that is left (184 bytes at most) goes to the shard of its gram;
4. a shard leaves out later copies of whole snippets, and those that are then alone with their gram, as equal windows share it and no
   two windows of a snippet hold it at the same place; it sorts the suffixes of the others by Larsson-Sadakane refinement, gets the common prefixes of neighbours by
   Kasai's method, and so the sets of equal windows; a shard that is too large is sorted in pieces, whose
   distinct windows are looked up in each other by binary search;
5. all windows but the first of each set mark their bytes, and each document drops what is marked.

Nothing is compared by hash alone but the choice of grams. Identical snippets of a part travel once.

Defined results: NULL text is empty; a NULL id sorts behind all others. Repeated rows are one document, so they are not
copies of each other. Rows that share an id, or have none, but differ in text are documents of their own, which follow each other
in the order of a digest of the text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.llm.textarrays import BYTE_CODE, U64, column, mix64, pack_planes, parts, powers, text_bytes, unpack_planes
from staytide.operators.prefix import row_ranks
from staytide.session import materialize

WINDOW = 100
GRAM = 16
GRAMS_PER_WINDOW = WINDOW - GRAM + 1
# Equal windows agree on so many bytes on one side of their gram at least.
SIDE = (WINDOW - GRAM) // 2
_LAST_ID = np.iinfo(np.int64).max
_PLACE_BITS = 24
# Text, grams or snippet bytes that a task handles at a time.
PART_BYTES = 3 << 20
GRAMS_PER_BUCKET = 1_000_000
BYTES_PER_SHARD = 2 << 20
# Shards travel in lots, so that a part of the text has no more rows to send where there is more text: up to SHARDS_PER_LOT
# in one, beyond LOTS of them.
LOTS = 512
SHARDS_PER_LOT = 16
# Ranges of ids that are ranked apart.
ID_CHUNKS = 4096


def words_at(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number; zeros follow the last byte."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    return np.ndarray((len(flat) + 1,), ">u8", padded.tobytes(), 0, (1,))[: len(flat)].astype(U64)


def minimal_grams(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, place, first window, last window, document) per run of windows that share their minimal gram."""
    found = []
    size = (1 << _PLACE_BITS) - 4 * WINDOW
    for begin in range(0, max(len(flat), 1), size):
        piece = flat[begin : begin + size + WINDOW - 1]
        if len(piece) < WINDOW:
            continue
        eight = words_at(piece)
        n = len(piece) - GRAM + 1
        gram = mix64(eight[:n] * U64(0x9E3779B97F4A7C15) + mix64(eight[8 : n + 8]))
        low = (gram & ~U64((1 << _PLACE_BITS) - 1)) | np.arange(n, dtype=U64)
        # the minimum of 64 places by doubling, then of 85
        reach = 1
        while reach * 2 <= GRAMS_PER_WINDOW:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = GRAMS_PER_WINDOW - reach
        low = np.minimum(low[: len(low) - rest], low[rest:])
        place = (low & U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        starts = np.arange(len(place))[: size if begin + size < len(flat) else None]
        doc = np.searchsorted(at, starts + begin, "right") - 1
        starts = starts[starts + begin + WINDOW <= at[doc + 1]]
        if not len(starts):
            continue
        doc = np.searchsorted(at, starts + begin, "right") - 1
        own = place[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(starts)) - 1
        found.append((gram[own[first]], own[first] + begin, starts[first] + begin, starts[last] + begin, doc[first]))
    if not found:
        empty = np.empty(0, np.int64)
        return empty.astype(U64), empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def sides(flat: np.ndarray, at: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(2, n) hashes of the SIDE bytes in front of each gram and of those behind it; 0 where the document has fewer."""
    eight = words_at(flat)
    out = np.zeros((2, len(place)), np.uint32)
    for k, (begin, inside) in enumerate(((place - SIDE, place - SIDE >= at[doc]), (place + GRAM, place + GRAM + SIDE <= at[doc + 1]))):
        begin = begin[inside]
        x = np.zeros(len(begin), U64)
        for step in [*range(0, SIDE - 8, 8), SIDE - 8]:
            x = mix64(x * U64(0x9E3779B97F4A7C15) + eight[begin + step])
        out[k, inside] = np.maximum(x >> U64(32), U64(1))
    return out


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return column(part, "doc_id").cast(pa.int64()).fill_null(_LAST_ID).to_numpy(zero_copy_only=False)


GRAM_SCHEMA = "bucket int, n int, gram binary, sides binary, id binary, first binary, runs binary"


def _grams(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", PART_BYTES):
            flat, at = text_bytes(column(part, "text"))
            gram, place, first, last, doc = minimal_grams(flat, at)
            bucket = (gram % U64(buckets)).astype(np.int64)
            order = np.lexsort((gram, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            ids, own = _ids(part)[doc], (first - at[doc]).astype(np.uint32)
            runs = ((place - first) | (last - first) << 8).astype(np.uint16)
            around = sides(flat, at, place, doc)
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                o = order[cuts[b] : cuts[b + 1]]
                rows.append((b, len(o), pack_planes(gram[o]), around[:, o].tobytes(), pack_planes(ids[o]), pack_planes(own[o]), pack_planes(runs[o])))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                names = ["bucket", "n", "gram", "sides", "id", "first", "runs"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _twice(key: np.ndarray) -> np.ndarray:
    """Mask of the values that occur more than once."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice


def _repeated_grams(table: pa.Table) -> pa.Table:
    """The runs whose gram occurs more than once in its bucket, with the same bytes on one side."""
    rows = table.to_pydict()

    def all_of(name, kind):
        return np.concatenate([unpack_planes(b, n, kind) for b, n in zip(rows[name], rows["n"])])

    gram = all_of("gram", U64)
    often = _twice(gram)
    around = np.concatenate([np.frombuffer(b, np.uint32).reshape(2, n) for b, n in zip(rows["sides"], rows["n"])], 1)
    shared = np.zeros(len(gram), bool)
    for side in around:
        has = np.flatnonzero(often & (side > 0))
        shared[has] |= _twice(mix64(gram[has] + side[has] * U64(0x9E3779B97F4A7C15)))
    often = shared
    first, runs = all_of("first", np.uint32)[often].astype(np.int64), all_of("runs", np.uint16)[often].astype(np.int64)
    return pa.table(
        {
            "id": all_of("id", np.int64)[often],
            "gram": gram[often].view(np.int64),
            "first": first,
            "last": first + (runs >> 8),
        }
    )


SNIPPET_SCHEMA = "lot int, n int, counts binary, tags binary, id binary, first binary, sizes binary, bytes binary"
# Of a snippet's size, sent as what goes beyond a window: that it is a later copy of one of its part and comes without bytes.
_LATE = 128


def _snippets(shards: int, per_lot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_bytes = zstandard.ZstdCompressor(level=1).compress
        lots = -(-shards // per_lot)
        for part in parts(batches, "text", PART_BYTES):
            flat, at = text_bytes(column(part, "text"))
            runs = column(part, "runs")
            doc = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
            values = runs.flatten()
            gram, first, last = (values.field(k).to_numpy() for k in range(3))
            begin = first + at[doc]
            size = last - first + WINDOW
            mixed = mix64(gram.view(U64))
            shard, tag = (mixed % U64(shards)).astype(np.int64), (mixed >> U64(32)).astype(np.uint32)
            order = np.lexsort((first, doc, shard))
            cuts = np.searchsorted(shard[order], np.arange(lots + 1) * per_lot)
            ids = _ids(part)
            rows = []
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                o = order[cuts[s] : cuts[s + 1]]
                data = _gather(flat, begin[o], size[o])
                heads, late = first_copies(ids[doc[o]], first[o], size[o], data)
                data = data[np.repeat(heads, size[o])].tobytes()
                o, late = o[heads | late], late[heads | late]
                counts = np.bincount(shard[o] - s * per_lot, minlength=per_lot).astype(np.uint32).tobytes()
                sizes = (size[o] - WINDOW + np.where(late, _LATE, 0)).astype(np.uint8).tobytes()
                rows.append((s, len(o), counts, tag[o].tobytes(), pack_planes(ids[doc[o]]), pack_planes(first[o].astype(np.uint32)), sizes, zip_bytes(data)))
            if rows:
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
                names = ["lot", "n", "counts", "tags", "id", "first", "sizes", "bytes"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The given stretches, one after the other."""
    at = np.cumsum(size) - size
    return flat[np.repeat(begin - at, size) + np.arange(int(size.sum()))]


def suffix_array(flat: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The starts in the order of the `depth` bytes that follow them, by Larsson-Sadakane refinement.

    A suffix's rank is the first place of its group. Each round sorts the groups that are still open by the ranks of the
    suffixes as far on as the sorted depth, which doubles; suffixes alone in their group are never sorted again.
    """
    n = len(flat)
    key = words_at(flat)
    order = np.argsort(key).astype(np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[n] = 0
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    # ranks count from 1; what lies beyond the end has rank 0
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(1, n + 1, dtype=np.int32), 0))
    del key
    sorted_depth = 8
    while sorted_depth < depth:
        alone = fresh & np.append(fresh[1:], True)
        places = np.flatnonzero(~alone).astype(np.int32)
        if not len(places):
            break
        members = order[places]
        both = rank[members].astype(np.int64) << 32 | rank[np.minimum(members.astype(np.int64) + sorted_depth, n)]
        again = np.argsort(both)
        members, both = members[again], both[again]
        order[places] = members
        cut = np.ones(len(places), bool)
        cut[1:] = both[1:] != both[:-1]
        fresh[places] = cut
        rank[members] = places[np.maximum.accumulate(np.where(cut, np.arange(len(places), dtype=np.int32), 0))] + 1
        sorted_depth *= 2
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return order[wanted[order]].astype(np.int64)


def first_copies(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the earliest of each set of identical snippets, mask of the later ones).

    A snippet at the same place of the same id as the earliest is the same one, and in neither. Snippets of equal
    hash are compared byte by byte; one that differs after all counts as a first.
    """
    n = len(ids)
    at = np.cumsum(sizes) - sizes
    up, down = powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, U64)
    np.cumsum(BYTE_CODE[flat] * up[: len(flat)], out=total[1:])
    key = mix64((total[at + sizes] - total[at]) * down[at]) + sizes.astype(U64)
    order = np.lexsort((first, ids, key))
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    head = np.empty(n, np.int64)
    head[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(n), 0))]
    later = np.flatnonzero(head != np.arange(n))
    own = np.repeat(at[later] - (np.cumsum(sizes[later]) - sizes[later]), sizes[later]) + np.arange(int(sizes[later].sum()))
    fits = sizes[later] == sizes[head[later]]
    other = np.minimum(own + np.repeat(at[head[later]] - at[later], sizes[later]), max(len(flat) - 1, 0))
    if len(later):
        ends = np.cumsum(sizes[later]) - sizes[later]
        fits &= np.logical_and.reduceat(flat[own] == flat[other], ends)
    heads = np.ones(n, bool)
    heads[later[fits]] = False
    late = np.zeros(n, bool)
    late[later[fits]] = True
    late &= (ids != ids[head]) | (first != first[head])
    return heads, late


def common_prefixes(flat: np.ndarray, order: np.ndarray, first: np.ndarray, counts: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to `depth`, by Kasai's method.

    A suffix's common prefix is at most one shorter than that of the suffix one byte further in front, as long as the
    neighbour's next suffix is in the array too, and in front of ours. The walk goes along all
    snippets at once: snippet k holds the suffixes first[k], first[k] + 1, ... (counts[k] of them).
    """
    n = len(flat)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    rank = np.full(n + 1, n, np.int64)
    rank[order] = np.arange(len(order))
    padded = np.concatenate([flat, np.zeros(depth + 8, np.uint8)])
    eight = words_at(padded)
    out = np.zeros(n, np.int16)
    held = np.zeros(len(first), np.int64)
    neighbour = np.full(len(first), n - 1)
    for step in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > step)
        own = first[live] + step
        other = before[own]
        bound = rank[neighbour[live] + 1] < rank[own]
        length = np.where((other >= 0) & bound, np.maximum(held[live] - 1, 0), 0)
        going = np.flatnonzero(other >= 0)
        while len(going):
            x = eight[own[going] + length[going]] ^ eight[other[going] + length[going]]
            # equal bytes in front: whole words, or the zero bytes of the difference
            bits = np.frexp((x >> U64(11)).astype(np.float64))[1]
            equal = np.where(x == 0, 8, np.where(x >> U64(11) != 0, (53 - bits) // 8, 6 + (x < U64(256))))
            length[going] += equal
            going = going[(equal == 8) & (length[going] < depth)]
        length = np.minimum(length, depth)
        held[live], neighbour[live] = length, other
        out[own] = length
    return out[order]


class Shard:
    """Snippets of one shard and the sets of equal windows in them."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.flat, self.ids, self.begin = flat, ids, first
        self.counts = sizes - WINDOW + 1
        self.at = np.cumsum(sizes) - sizes
        self.starts = np.repeat(self.at - (np.cumsum(self.counts) - self.counts), self.counts) + np.arange(int(self.counts.sum()))
        snippet = np.zeros(len(flat), np.int64)
        snippet[self.at] = 1
        self.snippet = np.cumsum(snippet) - 1
        self.order = suffix_array(flat, self.starts)
        lcp = common_prefixes(flat, self.order, self.at, self.counts)
        fresh = lcp < WINDOW
        fresh[:1] = True
        self.group = np.cumsum(fresh) - 1
        owner = self.snippet[self.order]
        self.id, self.place = ids[owner], first[owner] + self.order - self.at[owner]
        # the earliest window of each group
        rank = np.lexsort((self.place, self.id, self.group))
        head = rank[np.flatnonzero(np.append(True, np.diff(self.group[rank]) > 0))]
        self.head_id, self.head_place, self.head_start = self.id[head], self.place[head], self.order[head]

    def keys(self) -> np.ndarray:
        """The distinct windows in order, as rows of bytes."""
        return self.flat[self.head_start[:, None] + np.arange(WINDOW)]

    def lower(self, ids: np.ndarray, places: np.ndarray, at: np.ndarray, has: np.ndarray) -> None:
        """Take over the earlier windows that another shard holds for our groups."""
        other_id, other_place = ids[at[has]], places[at[has]]
        mine = np.flatnonzero(has)
        better = (other_id < self.head_id[mine]) | ((other_id == self.head_id[mine]) & (other_place < self.head_place[mine]))
        self.head_id[mine[better]], self.head_place[mine[better]] = other_id[better], other_place[better]

    def repeated(self) -> pa.Table:
        """Stretches of bytes that later windows cover: id, from, to."""
        late = (self.id != self.head_id[self.group]) | (self.place != self.head_place[self.group])
        spot = np.sort(self.order[late])
        if not len(spot):
            return pa.table({"id": pa.array([], pa.int64()), "from": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        owner = self.snippet[spot]
        cut = np.ones(len(spot), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (np.diff(spot) > WINDOW)
        a = np.flatnonzero(cut)
        z = np.append(a[1:], len(spot)) - 1
        who = owner[a]
        shift = self.begin[who] - self.at[who]
        return pa.table({"id": self.ids[who], "from": spot[a] + shift, "to": spot[z] + shift + WINDOW})


def merge(shards: list[Shard]) -> None:
    """Each shard learns where its windows occur earliest in the others, by binary search in their sorted windows."""
    if len(shards) < 2:
        return
    keys = [np.ascontiguousarray(s.keys()).view([("b", f"V{WINDOW}")]).ravel() for s in shards]
    keys = [np.array([row.tobytes() for row in k], object) for k in keys]
    heads = [(s.head_id.copy(), s.head_place.copy()) for s in shards]
    for i, own in enumerate(shards):
        for j, theirs in enumerate(keys):
            if i != j and len(theirs) and len(keys[i]):
                at = np.minimum(np.searchsorted(theirs, keys[i]), len(theirs) - 1)
                own.lower(*heads[j], at, theirs[at] == keys[i])


def _lot_repeats(table: pa.Table) -> pa.Table:
    """Later copies of whole snippets, and what each shard of the lot finds."""
    import zstandard

    rows = table.to_pydict()
    unzip = zstandard.ZstdDecompressor().decompress
    ids = np.concatenate([unpack_planes(b, n, np.int64) for b, n in zip(rows["id"], rows["n"])])
    first = np.concatenate([unpack_planes(b, n, np.uint32) for b, n in zip(rows["first"], rows["n"])]).astype(np.int64)
    sizes = np.concatenate([np.frombuffer(b, np.uint8) for b in rows["sizes"]]).astype(np.int64)
    late = sizes >= _LATE
    sizes += np.where(late, WINDOW - _LATE, WINDOW)
    counts = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["counts"]]).astype(np.int64)
    per_lot = len(counts) // table.num_rows
    shard = np.repeat(np.tile(np.arange(per_lot), table.num_rows), counts)[~late]
    tags = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["tags"]])[~late]
    found = [pa.table({"id": ids[late], "from": first[late], "to": (first + sizes)[late]})]
    ids, first, sizes = ids[~late], first[~late], sizes[~late]
    flat = np.frombuffer(b"".join(unzip(b) for b in rows.pop("bytes")), np.uint8)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(per_lot + 1))
    for a, z in zip(cuts[:-1], cuts[1:]):
        if z > a:
            o = order[a:z]
            found += _shard_repeats(ids[o], first[o], sizes[o], tags[o], _gather(flat, begin[o], sizes[o]))
    return pa.concat_tables(found)


def _shard_repeats(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, tags: np.ndarray, flat: np.ndarray) -> list[pa.Table]:
    """`tags`: hashes of the snippets' grams."""
    heads, late = first_copies(ids, first, sizes, flat)
    whole = pa.table({"id": ids[late], "from": first[late], "to": (first + sizes)[late]})
    heads[heads] = _twice(tags[heads])
    if not heads.any():
        return [whole]
    flat = flat[np.repeat(heads, sizes)]
    ids, first, sizes = ids[heads], first[heads], sizes[heads]
    at = np.append(0, np.cumsum(sizes))
    cuts = np.searchsorted(at, np.arange(0, at[-1], 2 * BYTES_PER_SHARD))
    cuts = np.unique(np.append(cuts, len(sizes)))
    shards = [Shard(ids[a:b], first[a:b], sizes[a:b], flat[at[a] : at[b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    merge(shards)
    return [whole, *(s.repeated() for s in shards)]


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text", PART_BYTES):
        flat, at = text_bytes(column(part, "text"))
        data = flat.tobytes()
        spans_of = column(part, "spans")
        cuts = spans_of.offsets.to_numpy()
        cuts = cuts - cuts[0]
        values = spans_of.flatten()
        begin, end = values.field(0).to_numpy(), values.field(1).to_numpy()
        n_removed, n_spans, digests = [], [], []
        for k in range(part.num_rows):
            text = data[at[k] : at[k + 1]]
            kept, upto, spans, removed = [], 0, 0, 0
            stretches = sorted(zip(begin[cuts[k] : cuts[k + 1]].tolist(), end[cuts[k] : cuts[k + 1]].tolist()))
            last = -1
            for a, z in stretches:
                if a > last:
                    spans += 1
                    kept.append(text[upto:a])
                if z > last:
                    removed += z - max(a, last)
                    upto = last = z
            kept.append(text[upto:])
            digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
            n_removed.append(removed)
            n_spans.append(spans)
        yield pa.record_batch(
            [column(part, "doc_id"), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id and text with one text to an id, and where ids had to be numbered anew the old ones: number, doc_id.

    A number says the place of the document in the order of ids, and of the digests of their texts.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = F.md5(F.coalesce("text", F.lit("")))
    slim = texts.select("doc_id", digest.alias("digest"))
    shared = slim.groupBy("doc_id").agg(F.min(F.unhex("digest")).alias("low"), F.max(F.unhex("digest")).alias("high")).filter("low != high")
    if shared.isEmpty():
        return texts, None
    ids = materialize(slim.distinct(), "suffix-ids")
    ends = ids.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    width = ((ends["high"] or 0) - (ends["low"] or 0)) // ID_CHUNKS + 1
    # those without an id come last, in the order of their digests
    apart = F.lit(ID_CHUNKS) + F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    chunk = F.coalesce(F.floor((F.col("doc_id") - (ends["low"] or 0)) / width).cast("int"), apart)
    numbered = materialize(row_ranks(ids.withColumn("chunk", chunk), [], "chunk", [F.col("doc_id").asc_nulls_last(), "digest"], "number"), "suffix-numbers")
    of = numbered.select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), "number")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (digest == F.col("of_digest"))
    placed = materialize(texts.join(of, same).select(F.col("number").alias("doc_id"), "text"), "suffix-texts")
    return placed, numbered.select("number", "doc_id")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, from, to): stretches of bytes that windows with an earlier twin cover. They may overlap. An id has one text."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = int(2 * size / (GRAMS_PER_WINDOW + 1) / GRAMS_PER_BUCKET) + 1
    grams = texts.mapInArrow(_grams(buckets), GRAM_SCHEMA)
    runs = grams.groupBy("bucket").applyInArrow(_repeated_grams, "id bigint, gram bigint, first bigint, last bigint")
    per_doc = runs.groupBy("id").agg(F.collect_list(F.struct("gram", "first", "last")).alias("runs"))
    per_doc = materialize(per_doc, "gram-runs")
    around = per_doc.agg(F.sum(F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"] + WINDOW)).alias("n")).first()["n"]
    shards = int((around or 0) / BYTES_PER_SHARD) + 1
    held = texts.join(per_doc, F.coalesce("doc_id", F.lit(int(_LAST_ID))) == F.col("id")).select("doc_id", "text", "runs")
    per_lot = min(SHARDS_PER_LOT, shards // LOTS + 1)
    snippets = held.mapInArrow(_snippets(shards, per_lot), SNIPPET_SCHEMA)
    return snippets.groupBy("lot").applyInArrow(_lot_repeats, "id bigint, from bigint, to bigint")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    texts, numbers = keyed(docs)
    spans = repeated_spans(texts).groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    # the same columns as in the join of the runs, so that texts are shuffled once
    joined = texts.join(spans, F.coalesce("doc_id", F.lit(int(_LAST_ID))) == F.col("id"), "left")
    joined = joined.select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    found = joined.mapInArrow(_drop, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    if numbers is None:
        return found
    return found.withColumnRenamed("doc_id", "number").join(numbers, "number").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
