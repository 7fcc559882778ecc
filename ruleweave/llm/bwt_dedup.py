"""Exact substring dedup by merged Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes covers it that also starts in a
document with a smaller id. Work is dealt out so that equal strings meet:

1. runs: the hash minimum of the k-mers inside each string is a value of the
   string alone. Consecutive strings of one minimum form a run, whose bytes are a
   fragment. Runs go to the bucket of their minimum. A fragment that is very
   common in one task goes once for its smallest documents; the others, equal in
   all bytes, lose theirs at once, so no minimum brings a row a document.
2. match: minima of one document are dropped, which is most of the text. Of the
   others, each distinct fragment is asked for once a shard, where the shard is a
   hash of the document.
3. cut_out: the documents give the bytes of those fragments.
4. merge: a unit, the fragments of a few minima, has a Burrows-Wheeler transform
   per shard (rotations sorted to depth `length`, each alone). An interleave
   vector says which shard owns each slot of the merged order. It is refined
   from depth to depth by a stable sort on the symbols that stand before the
   slots; a slot that differs from its neighbour in symbol, or did before, opens
   a block, and the depth at which it does bounds their common prefix. Slots with
   common prefixes of `length` are the repeated intervals. No suffix is sorted
   again.
5. apply: spans meet their documents. A span carries a digest of the bytes that
   the merge saw; bytes that differ from it are an error, so nothing goes on the
   word of a hash alone.

Rows between the steps are blobs of packed columns keyed by bucket, so a shuffle
moves about 16 bytes a run. Symbols are groups of as many bytes as fit 63 bits
in the unit's own alphabet, ranked (65,536 at most in a unit of usual size), so
a refinement is one radix pass.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ruleweave.llm.common import cut, frugal, tidy

#: Bytes of a k-mer; shards of a unit; rotations of a unit; bytes of a symbol; text per bucket; bytes hashed at once, whose runs go out at once, and packed at once.
K, SHARDS, UNIT, STEP, BUCKET_BYTES, BLOCK_BYTES, OUT_BYTES, PACK_BYTES = 16, 2, 60_000, 10, 2 << 20, 2 << 20, 16 << 20, 8 << 20
#: Documents of a block with a fragment from which it is common, common fragments that a task remembers, occurrences handled at once.
COMMON, REMEMBERED, AT_ONCE = 16, 100_000, 200_000
#: Odd multipliers of the k-mer hash.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
ROWS = "bucket int, kind int, blob binary"
ROW_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
TEXTS, SPANS, SEEN, WANTED, PIECES = range(5)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each as its minimum and differences of 1, 2, 4 or 8 bytes."""
    out = [struct.pack("<IB", len(columns[0]), len(columns))]
    for c in columns:
        low = int(c.min()) if len(c) else 0
        span = (int(c.max()) if len(c) else 0) - low
        width = 1 if span < 1 << 8 else 2 if span < 1 << 16 else 4 if span < 1 << 32 else 8
        if width == 8:
            low = 0
        kind = np.dtype(f"u{width}")
        out.append(struct.pack("<qB", low, width))
        out.append((c.astype(np.int64) - low).astype(kind).tobytes() if width < 8 else c.astype(np.int64).tobytes())
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    n, columns = struct.unpack_from("<IB", blob)
    at, out = 5, []
    for _ in range(columns):
        low, width = struct.unpack_from("<qB", blob, at)
        kind = np.dtype(f"u{width}") if width < 8 else np.dtype(np.int64)
        out.append(np.frombuffer(blob, kind, n, at + 9).astype(np.int64) + low)
        at += 9 + n * width
    return out


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, blob = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])


def _dealt(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Columns as one blob per bucket."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    edges = np.concatenate(([0], np.nonzero(np.diff(bucket[order]))[0] + 1, [len(order)]))
    sorted_ = [c[order] for c in columns]
    return [(int(bucket[order[a]]), kind, pack(*[c[a:b] for c in sorted_])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    x = ids.view(np.uint64) * MIX[4]
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def kmer_hashes(text: bytes) -> np.ndarray:
    """A hash of the K bytes from each place on; the last K - 1 are of no meaning."""
    n = len(text)
    padded = text + bytes(32)

    def eight(offset: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        for j in range(8):
            part = out[j::8]
            if len(part):
                part[:] = np.frombuffer(padded, "<u8", len(part), offset + j)
        return out

    a, b = eight(0), eight(K - 8)
    a *= MIX[0]
    a ^= a >> np.uint64(31)
    b *= MIX[1]
    b ^= b >> np.uint64(29)
    a += b
    a *= MIX[2]
    a ^= a >> np.uint64(32)
    a *= MIX[3]
    return a


def runs(text: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(minimum, fragment hash, document, start in it, strings) of each run of documents laid end to end."""
    ends = np.cumsum(sizes)
    n, width = len(text), length - K + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashes = kmer_hashes(text)
    least, done = hashes, 1
    while done * 2 <= width:
        least, done = np.minimum(least[:-done], least[done:]), done * 2
    least = np.minimum(least[: n - width + 1], least[width - done :][: n - width + 1])[: n - length + 1]
    valid = np.ones(n - length + 2, bool)
    valid[-1] = False
    short = ends - length + 1
    for begin, end in zip(np.maximum(short, 0).tolist(), ends.tolist()):
        valid[begin:end] = False
    for begin, size in zip((ends - sizes)[sizes < length].tolist(), sizes[sizes < length].tolist()):
        valid[begin : begin + size] = False
    change = np.ones(len(valid), bool)
    change[1:-1] = least[1:] != least[:-1]
    change[1:] |= ~valid[:-1] | ~valid[1:]
    edges = np.nonzero(change)[0]
    start, stop = edges[:-1], edges[1:]
    start, stop = start[valid[start]], stop[valid[start]]
    if len(start) and (stop - start).max() > width:
        times = -(-(stop - start) // width)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start, stop = np.repeat(start, times) + place * width, np.repeat(stop, times)
        stop = np.minimum(stop, start + width)
    document = np.searchsorted(ends, start, side="right")
    strings = stop - start
    whole = _fragment_hashes(hashes, start, strings, length)
    return least[start], whole, document, start - (ends - sizes)[document], strings


def _fragment_hashes(hashes: np.ndarray, start: np.ndarray, strings: np.ndarray, length: int) -> np.ndarray:
    """A hash of all bytes of fragments, by the k-mers that cover them."""
    end = start + strings + length - 1
    whole = hashes[start] * MIX[4] + strings.astype(np.uint64)
    width = length - K + 1
    for i in range(1, -(-(length + width - 1) // K)):
        whole ^= whole >> np.uint64(29)
        whole = (whole + hashes[np.minimum(start + i * K, end - K)]) * MIX[i % 5]
    return whole


def fragment_hash(fragment: bytes, length: int) -> int:
    """The hash of one fragment, signed."""
    return int(_fragment_hashes(kmer_hashes(fragment), np.array([0]), np.array([len(fragment) - length + 1]), length).view(np.int64)[0])


def _repeated_ids(blobs: list[bytes]) -> set[int]:
    """Ids that stand more than once in a bucket's texts."""
    heads = [unpack(blob[4 : 4 + struct.unpack_from("<I", blob)[0]])[0] for blob in blobs]
    names, times = np.unique(np.concatenate(heads), return_counts=True)
    return set(names[times > 1].tolist())


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows of about limit bytes of text (the second column) each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _documents(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of about limit bytes each."""
    for block in _blocks(batches, limit):
        yield np.array(block.column(0).to_pylist(), np.int64), block.column(1).to_pylist()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """(bucket, blobs by kind) from batches sorted by bucket."""
    now, held = None, {}
    for batch in batches:
        for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


def _cogrouped(run: Callable, schema: pa.Schema) -> Callable:
    """run for one bucket of two tables."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs: dict[int, list[bytes]] = {}
        for part in (left, right):
            for kind, blob in zip(part.column("kind").to_pylist(), part.column("blob").to_pylist()):
                blobs.setdefault(kind, []).append(blob)
        out = pa.Table.from_batches(list(run(0, blobs)), schema)
        blobs.clear()
        tidy(collect=False)
        return out

    return both


def _columns(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(unpack, blobs))]


def pack_texts(ids: np.ndarray, texts: list[bytes]) -> bytes:
    head = pack(ids, np.fromiter(map(len, texts), np.int64, len(texts)))
    return struct.pack("<I", len(head)) + head + pa.compress(b"".join(texts), codec="zstd", asbytes=True)


def unpack_texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    (head,) = struct.unpack_from("<I", blob)
    ids, sizes = unpack(blob[4 : 4 + head])
    total = int(sizes.sum())
    return ids, sizes, pa.decompress(blob[4 + head :], decompressed_size=total, codec="zstd", asbytes=True) if total else b""


class Shard:
    """Rotations of fragments, sorted to a depth, with what stands before each."""

    def __init__(self, order: np.ndarray, before: dict[int, np.ndarray]):
        self.order, self.before = order, before


def transform(code: dict[int, np.ndarray], back: dict[int, np.ndarray], steps: list[int], places: np.ndarray) -> Shard:
    """Sort the rotations at some places and keep, in that order, the symbols that precede them."""
    order = places
    for step in steps:
        order = back[step][order]
        order = order[np.argsort(code[step][order], kind="stable")]
    return Shard(order, {step: code[step][back[step][order]] for step in set(steps)})


def merge(shards: list[Shard], steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(places in merged order, bytes each slot is known to share with the one before it).

    These common prefixes are exact to a step, and exact where steps are one byte.
    """
    owner = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.order) for s in shards])
    n = len(owner)
    block, common, depth = np.zeros(n, np.int32), np.full(n, sum(steps), np.int32), 0

    def read(columns: list[np.ndarray]) -> np.ndarray:
        """What each slot takes from its shard, in the shard's order."""
        if len(columns) == 1:
            return columns[0]
        out = np.empty(n, columns[0].dtype)
        out[np.argsort(owner, kind="stable")] = np.concatenate(columns)
        return out

    for step in steps:
        symbol = read([s.before[step] for s in shards])
        moved = np.argsort(symbol, kind="stable")
        symbol, block, owner = symbol[moved], block[moved], owner[moved]
        opens = np.ones(n, bool)
        np.not_equal(symbol[1:], symbol[:-1], out=opens[1:])
        opens[1:] |= block[1:] != block[:-1]
        np.minimum(common, depth, out=common, where=opens)
        block = np.cumsum(opens, dtype=np.int32)
        depth += step
    return read([s.order for s in shards]), common


def _steps(length: int, widest: int) -> list[int]:
    """length as a sum of nearly equal steps of `widest` at most."""
    times = -(-length // max(1, widest))
    return [length // times + (k < length % times) for k in range(times)]


def _codes(text: np.ndarray, after: np.ndarray, step: int, bits: int) -> np.ndarray:
    """Ranks of the groups of `step` symbols from each place on."""

    def packed(of: np.ndarray, times: int, wide: int, hop: np.ndarray) -> np.ndarray:
        code, at = of, hop
        for _ in range(times - 1):
            code = (code << wide) | of[at]
            at = hop[at]
        return code

    if step % 2 == 0 and step * bits > 63:  # ranks of halves, then of pairs of these
        halves = np.unique(packed(text, step // 2, bits, after), return_inverse=True)[1]
        hop = after
        for _ in range(step // 2 - 1):
            hop = after[hop]
        code = packed(halves, 2, 31, hop)
    else:
        code = packed(text, step, bits, after)
    if step > 1:
        code = np.unique(code, return_inverse=True)[1]
    return code.astype(np.uint16 if not len(code) or code.max() < 65_536 else np.int64)


def may_share(fragments: list[bytes]) -> np.ndarray:
    """Which fragments of runs may hold a string that another holds; the others hold none.

    A string of 3 * K bytes or more holds its minimum and K bytes or more on one
    side of it. So two fragments that share one agree in the minimum and in the K
    bytes before it or the K after it. Fragments that hold their minimum twice, and
    all others of that minimum, are kept unseen.
    """
    sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
    first = np.cumsum(sizes) - sizes
    text = b"".join(fragments)
    hashes = np.concatenate([kmer_hashes(text), np.zeros(K, np.uint64)])
    places = np.arange(len(text))
    owner = np.repeat(np.arange(len(fragments)), sizes)
    hashes[: len(text)][places + K > (first + sizes)[owner]] = np.iinfo(np.uint64).max
    least = np.minimum.reduceat(hashes[: len(text)], first)
    at = np.nonzero(hashes[: len(text)] == least[owner])[0]
    times = np.bincount(owner[at], minlength=len(fragments))
    place = np.zeros(len(fragments), np.int64)
    place[owner[at]] = at
    keep = np.zeros(len(fragments), bool)
    group = np.unique(least, return_inverse=True)[1]
    keep |= np.isin(group, group[times > 1])
    for begin, held in ((place - K, place - K >= first), (place + K, place + 2 * K <= first + sizes)):
        own = np.nonzero(held)[0]
        side = (hashes[begin[own]] * MIX[4]) ^ (least[own] * MIX[5])
        _, which, count = np.unique(side, return_inverse=True, return_counts=True)
        keep[own[count[which] > 1]] = True
    return keep


def least_documents(fragments: list[bytes], documents: np.ndarray, length: int, shard: np.ndarray | None = None, widest: int = 63, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each fragment, the smallest document of any fragment that holds it.

    Returns (place of each fragment's first string, value by place). `shard` says
    which transform a fragment goes into; `seen` counts what was merged.
    """
    sizes = np.fromiter(map(len, fragments), np.int64, len(fragments)) + 1
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(fragments)), sizes)
    inside = np.ones(n, bool)
    inside[first + sizes - 1] = False
    text = np.zeros(n, np.int64)
    letters, text[inside] = np.unique(np.frombuffer(b"".join(fragments), np.uint8), return_inverse=True)
    text[inside] += 1
    bits = len(letters).bit_length()
    steps = _steps(length, min(widest, STEP) if n <= 65_536 else max(1, min(widest, 16 // bits)))
    after, back1 = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[first + sizes - 1], back1[first] = first, first + sizes - 1
    code, back = {}, {}
    for s in set(steps):
        back[s] = back1
        for _ in range(s - 1):
            back[s] = back1[back[s]]
        code[s] = _codes(text, after, s, bits)
    of = np.zeros(n, np.int64) if shard is None else shard[owner]
    shards = [transform(code, back, steps, np.nonzero(of == k)[0].astype(np.int32)) for k in np.unique(of).tolist()]
    order, common = merge(shards, steps)
    if seen is not None:
        seen["shards"] = max(seen.get("shards", 0), len(shards))
        seen["merged"] = seen.get("merged", 0) + (len(shards) > 1)
    value = np.where(np.arange(n) + length < (first + sizes)[owner], documents[owner], np.iinfo(np.int64).max)[order]
    common[:1] = 0
    begin = np.nonzero(common < length)[0]
    least = np.empty(n, np.int64)
    least[order] = np.repeat(np.minimum.reduceat(value, begin), np.diff(np.concatenate((begin, [n]))))
    return first, least


def digest(text: bytes) -> int:
    """64 bits of BLAKE2, signed."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _settle_common(text: bytes, ids: np.ndarray, sizes: np.ndarray, whole: np.ndarray, document: np.ndarray, start: np.ndarray, strings: np.ndarray, length: int, known: dict[bytes, int], names: set[int]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(runs to go on, spans of the others): runs whose fragment is common and stands, byte by byte, in a smaller document of this task."""
    _, at, times = np.unique(whole, return_inverse=True, return_counts=True)
    often = times[at] >= COMMON
    if names:
        often |= np.isin(whole, np.fromiter(names, np.uint64, len(names)))
    keep, spans = np.ones(len(whole), bool), []
    rows = np.nonzero(often)[0]
    if len(rows):
        offset = np.cumsum(sizes) - sizes
        own = ids[document[rows]]
        for r in rows[np.argsort(own, kind="stable")].tolist():
            begin = int(offset[document[r]] + start[r])
            key, doc = text[begin : begin + int(strings[r]) + length - 1], int(ids[document[r]])
            least = known.get(key)
            if least is not None and least < doc:
                keep[r] = False
                spans.append((doc, int(start[r]), int(strings[r]), digest(key)))
            elif least is not None or len(known) < REMEMBERED:
                known[key] = doc
                names.add(int(whole[r]))
    return keep, spans


def _find_runs(length: int, buckets: int) -> Callable:
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        names: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        settled: list[tuple[int, int, int, int]] = []
        size = 0

        def out() -> pa.RecordBatch:
            least, whole, document, start, strings = (np.concatenate(c) for c in zip(*held))
            least *= MIX[4]  # minima are small numbers: spread them evenly
            least ^= least >> np.uint64(31)
            least *= MIX[5]
            bucket = (least >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(least), np.int64)
            short = ((least << (np.uint64(64) - shift)) >> np.uint64(32)).astype(np.int64) if buckets > 1 else (least >> np.uint64(32)).astype(np.int64)
            order = np.argsort(short, kind="stable")
            found = _dealt(bucket[order], SEEN, short[order], whole.view(np.int64)[order], document[order], start[order], strings[order])
            gone = np.array(settled, np.int64).reshape(-1, 4)
            found += _dealt(doc_bucket(gone[:, 0].copy(), buckets), SPANS, *gone.T)
            held.clear()
            settled.clear()
            return _rows(found)

        for ids, texts in _documents(batches, BLOCK_BYTES):
            text, sizes = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
            least, whole, document, start, strings = runs(text, sizes, length)
            keep, spans = _settle_common(text, ids, sizes, whole, document, start, strings, length, known, names)
            settled += spans
            held.append((least[keep], whole[keep], ids[document[keep]], start[keep], strings[keep]))
            size += len(text)
            if size >= OUT_BYTES:
                yield out()
                size = 0
        if held:
            yield out()

    return run


def _match(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: list[tuple[np.ndarray, ...]] = []
        held = 0

        def asked() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*wanted)]
            wanted.clear()
            return _rows(_dealt(doc_bucket(columns[0], buckets), WANTED, *columns))

        for bucket, blobs in _grouped(batches):
            found = [(bucket, SPANS, blob) for blob in blobs.get(SPANS, [])]
            if SEEN in blobs:
                least, whole, document, start, strings = _columns(blobs.pop(SEEN))
                order = np.lexsort((whole, least))
                least, whole, document, start, strings = (c[order] for c in (least, whole, document, start, strings))
                begin = np.concatenate(([0], np.nonzero(np.diff(least))[0] + 1))
                times = np.diff(np.concatenate((begin, [len(least)])))
                several = np.repeat(np.minimum.reduceat(document, begin) < np.maximum.reduceat(document, begin), times)
                least, whole, document, start, strings = (c[several] for c in (least, whole, document, start, strings))
                if len(whole):
                    group = np.cumsum(_changes(least)) - 1
                    rank = np.cumsum(_changes(least, whole)) - 1
                    found.append((bucket, SEEN, pack(rank, document, start, strings)))
                    shard = doc_bucket(document, SHARDS)
                    order = np.lexsort((document, shard, rank))
                    one = order[_changes(rank[order], shard[order])]
                    wanted.append((document[one], start[one], strings[one], np.full(len(one), bucket), group[one], rank[one], whole[one] & 0xFFFFFFFF))
                    held += len(one)
            if found:
                yield _rows(found)
            if held >= AT_ONCE:
                yield asked()
                held = 0
        if wanted:
            yield asked()

    return run


def _pack_documents(buckets: int) -> Callable:
    """Texts by bucket, and with them, as Arrow data, what further columns their rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, PACK_BYTES):
            ids, texts = np.array(block.column(0).to_pylist(), np.int64), block.column(1).to_pylist()
            others = block.select(range(2, block.num_columns))
            bucket = doc_bucket(ids, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.concatenate(([0], np.nonzero(np.diff(bucket[order]))[0] + 1, [len(order)]))
            found = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = order[a:b]
                more = b""
                if others.num_columns:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, others.schema) as writer:
                        writer.write_table(others.take(pa.array(own)).combine_chunks())
                    more = sink.getvalue().to_pybytes()
                found.append((int(bucket[own[0]]), TEXTS, struct.pack("<I", len(more)) + more + pack_texts(ids[own], [texts[i] for i in own.tolist()])))
            yield _rows(found)

    return run


def _texts_of(blobs: list[bytes]) -> list[bytes]:
    """The texts of packed documents, without their further columns."""
    return [blob[4 + struct.unpack_from("<I", blob)[0] :] for blob in blobs]


def _cut_out(length: int) -> Callable:
    def run(_: int, blobs: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if WANTED in blobs and TEXTS in blobs:
            wanted = _columns(blobs[WANTED])
            order = np.argsort(wanted[0], kind="stable")
            document, start, strings, target, group, rank, check = (c[order] for c in wanted)
            texts_of = _texts_of(blobs[TEXTS])
            rows, pieces, repeated = [], [], _repeated_ids(texts_of)
            for blob in texts_of:
                ids, sizes, text = unpack_texts(blob)
                offset = np.cumsum(sizes) - sizes
                low, high = np.searchsorted(document, ids), np.searchsorted(document, ids, side="right")
                for i in np.nonzero(high > low)[0].tolist():
                    own = slice(int(low[i]), int(high[i]))
                    texts = [text[s : s + k + length - 1] for s, k in zip((start[own] + offset[i]).tolist(), strings[own].tolist())]
                    held = np.arange(own.start, own.stop)
                    if ids[i] in repeated:  # another row of this id may have other bytes there
                        same = [j for j, t in enumerate(texts) if len(t) >= length and fragment_hash(t, length) & 0xFFFFFFFF == check[own][j]]
                        held, texts = held[same], [texts[j] for j in same]
                    rows.append(held)
                    pieces += texts
            if pieces:
                row = np.concatenate(rows)
                order = np.lexsort((rank[row], target[row]))
                row = row[order]
                edges = np.concatenate(([0], np.nonzero(np.diff(target[row]))[0] + 1, [len(row)]))
                found = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    own = row[a:b]
                    columns = pack(group[own], document[own])
                    found.append((int(target[own[0]]), PIECES, struct.pack("<I", len(columns)) + columns + pack_texts(rank[own], [pieces[i] for i in order[a:b].tolist()])))
                yield _rows(found)

    return run


def _pieces(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(group, rank of the fragment, document, bytes) of the pieces of a bucket, sorted by rank, which goes with the group."""
    columns, texts = [], []
    for blob in blobs:
        (size,) = struct.unpack_from("<I", blob)
        names, sizes, text = unpack_texts(blob[4 + size :])
        columns.append([*unpack(blob[4 : 4 + size]), names])
        ends = np.cumsum(sizes).tolist()
        texts += [text[a:b] for a, b in zip([0, *ends], ends)]
    group, document, rank = (np.concatenate(c) for c in zip(*columns))
    order = np.lexsort((document, rank))
    return group[order], rank[order], document[order], [texts[i] for i in order.tolist()]


def _units(group: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of whole groups of about `limit` rotations; one group may be more."""
    edges = np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1, [len(group)])).tolist()
    total = np.concatenate(([0], np.cumsum(sizes))).tolist()
    start = 0
    for a, b in zip(edges[:-1], edges[1:]):
        if a > start and total[b] - total[start] > limit:
            yield start, a
            start = a
    if len(group) > start:
        yield start, len(group)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's rows differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([np.diff(c) != 0 for c in columns], axis=0)
    return out


def spans_of_bucket(pieces: tuple, occurrences: list[np.ndarray], length: int, seen: dict | None = None) -> Iterator[list[np.ndarray]]:
    """(document, start, strings, digest) of the spans that go, unit by unit.

    pieces: see _pieces. occurrences: rank of the fragment, document, start and strings of every run.
    """
    group, rank, document, texts = pieces
    if not len(texts):
        return
    order = np.argsort(occurrences[0], kind="stable")
    o_rank, o_document, o_start, o_strings = (c[order] for c in occurrences)
    if not np.array_equal(np.unique(o_rank), np.unique(rank)):
        raise ValueError("a run has no fragment")
    if length >= 3 * K:  # a fragment stays if several documents hold it, or it may share a string with another
        begin = np.nonzero(_changes(o_rank))[0]
        told = np.zeros(o_rank[-1] + 1, bool)
        told[o_rank[begin]] = np.minimum.reduceat(o_document, begin) < np.maximum.reduceat(o_document, begin)
        told[rank[may_share(texts)]] = True
        own, kept = np.nonzero(told[o_rank])[0], np.nonzero(told[rank])[0]
        o_rank, o_document, o_start, o_strings = o_rank[own], o_document[own], o_start[own], o_strings[own]
        group, rank, document, texts = group[kept], rank[kept], document[kept], [texts[i] for i in kept.tolist()]
    for u, v in _units(group, np.fromiter(map(len, texts), np.int64, len(texts)) + 1, UNIT):
        fragments = texts[u:v]
        first, least = least_documents(fragments, document[u:v], length, doc_bucket(document[u:v], SHARDS), seen=seen)
        # The first piece of each distinct fragment stands for all its runs.
        names, one = np.unique(rank[u:v], return_index=True)
        low, high = np.searchsorted(o_rank, names[0]), np.searchsorted(o_rank, names[-1], side="right")
        proofs: dict[tuple[int, int, int], int] = {}
        for at in range(low, high, AT_ONCE):
            part = slice(at, min(high, at + AT_ONCE))
            which = one[np.searchsorted(names, o_rank[part])]
            doc, start, strings = o_document[part], o_start[part], o_strings[part]
            begins = np.cumsum(strings) - strings
            goes = least[np.repeat(first[which] - begins, strings) + np.arange(strings.sum())] < np.repeat(doc, strings)
            opens, closes = goes.copy(), goes.copy()
            opens[1:] &= ~goes[:-1]
            opens[begins] = goes[begins]
            closes[:-1] &= ~goes[1:]
            closes[begins + strings - 1] = goes[begins + strings - 1]
            a, b = np.nonzero(opens)[0], np.nonzero(closes)[0]
            row = np.searchsorted(begins, a, side="right") - 1
            begin, size = a - begins[row], b - a + 1
            proof = np.empty(len(a), np.int64)
            for i, spot in enumerate(zip(which[row].tolist(), begin.tolist(), size.tolist())):
                if spot not in proofs:
                    proofs[spot] = digest(fragments[spot[0]][spot[1] : spot[1] + spot[2] + length - 1])
                proof[i] = proofs[spot]
            if len(a):
                yield [doc[row], start[row] + begin, size, proof]


def _merge_bucket(length: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            spans = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return _rows(_dealt(doc_bucket(spans[0], buckets), SPANS, *spans))

        for _, blobs in _grouped(batches):
            if SEEN in blobs and PIECES in blobs:
                for spans in spans_of_bucket(_pieces(blobs.pop(PIECES)), _columns(blobs.pop(SEEN)), length):
                    held.append(spans)
                    size += len(spans[0])
                    if size >= 2 * AT_ONCE:
                        yield out()
                        size = 0
        if held:
            yield out()

    return run


def _apply(length: int, keep: str, schema: pa.Schema) -> Callable:
    def run(_: int, blobs: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if TEXTS in blobs:
            spans = _columns(blobs[SPANS]) if SPANS in blobs else [np.zeros(0, np.int64)] * 4
            order = np.argsort(spans[0], kind="stable")
            document, start, strings, proof = (c[order] for c in spans)
            texts_of = _texts_of(blobs[TEXTS])
            end, repeated = start + strings + length - 1, _repeated_ids(texts_of)
            for packed, blob in zip(blobs[TEXTS], texts_of):
                ids, sizes, text = unpack_texts(blob)
                offset = (np.cumsum(sizes) - sizes).tolist()
                low, high = np.searchsorted(document, ids), np.searchsorted(document, ids, side="right")
                rows, kept = [], []
                for i, (a, b, at, size) in enumerate(zip(low.tolist(), high.tolist(), offset, sizes.tolist())):
                    own, removed, cuts = text[at : at + size], 0, 0
                    if b > a:
                        name = int(ids[i])
                        fits = np.fromiter((digest(own[s:e]) == p for s, e, p in zip(start[a:b].tolist(), end[a:b].tolist(), proof[a:b].tolist())), bool, b - a)
                        if not fits.all() and name not in repeated:
                            raise ValueError(f"a span of document {name} has other bytes than the merge saw")
                        depth = np.zeros(size + 1, np.int64)
                        np.add.at(depth, start[a:b][fits], 1)
                        np.add.at(depth, end[a:b][fits], -1)
                        gone = np.cumsum(depth)[:size] > 0
                        removed = int(gone.sum())
                        cuts = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if size else 0))
                        own = np.frombuffer(own, np.uint8)[~gone].tobytes()
                    if keep == "text":
                        kept.append(own.decode(errors="ignore"))
                    else:
                        rows.append((int(ids[i]), size, removed, cuts, hashlib.sha256(own).hexdigest(), *([own] if keep else [])))
                if keep == "text":
                    (size,) = struct.unpack_from("<I", packed)
                    columns = list(pa.ipc.open_stream(packed[4 : 4 + size]).read_all().columns) if size else []
                    columns.insert(schema.get_field_index(TEXT), pa.chunked_array([pa.array(kept, pa.string())]))
                    yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema).to_batches(500)
                else:
                    for at in range(0, len(rows), 500):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 500]), schema)], schema=schema)

    return run


#: What the last step returns: digests, and the bytes that remain if they are asked for. The text's column in a row of documents.
DIGESTS = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
TEXT = "__text"


def _repeated(rows: DataFrame, length: int, keep: str) -> DataFrame:
    """A row for each row (id, text, further columns) with an id: digests (keep ""), digests and bytes, or the columns after the id with the text that remains.

    For the last, the text stands where a further column TEXT does.
    """
    if length <= K:
        raise ValueError(f"length must be over {K}")
    docs = rows.select("id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << min(30, max(4, (total // BUCKET_BYTES).bit_length()))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket")

    found = cut(dealt(docs.mapInArrow(frugal(_find_runs(length, buckets)), ROWS)).mapInArrow(frugal(_match(buckets)), ROWS))
    others = [c for c in rows.columns if c not in ("id", "text", TEXT)]
    texts = rows.select("id", "text", *others).mapInArrow(frugal(_pack_documents(buckets)), ROWS)
    # Both cogroups deal the texts alike, so that they are shuffled once.
    wanted = found.where(F.col("kind") == WANTED)
    pieces = texts.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_cogrouped(_cut_out(length), ROW_SCHEMA), ROWS)
    merged = dealt(pieces.unionByName(found.where(F.col("kind") == SEEN))).mapInArrow(frugal(_merge_bucket(length, buckets)), ROWS)
    spans = merged.unionByName(found.where(F.col("kind") == SPANS))
    if keep == "text":
        kind = rows.drop("id", "text").withColumn(TEXT, F.col(TEXT).cast("string")).schema
    else:
        kind = from_arrow_schema(pa.schema([*DIGESTS, ("kept", pa.binary())] if keep else DIGESTS))
    schema = to_arrow_schema(kind)
    return texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_cogrouped(_apply(length, keep, schema), schema), kind)


def repeated_bytes(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Return id_col (as bigint: ids must be numbers), n_bytes, n_removed, n_spans, kept_sha256 and, with keep, kept binary (what remains) of every row.

    Null texts are empty; texts below `length` bytes lose nothing. Rows with null
    ids lose nothing and take nothing from others. Rows that repeat an id take
    nothing from each other; if their texts differ, spans found for either go
    from both where the bytes there are the same. An empty table gives no rows;
    other columns are dropped. `length` is 17 or more; 50 is what it is made for.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), _bytes(text_col).alias("text"))
    done = _repeated(rows, length, "bytes" if keep else "")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, none = F.octet_length(text).cast("bigint"), F.lit(0).cast("bigint")
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("bigint").alias("id"), size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *[text.cast("binary").alias("kept")] * keep)
    return done.unionByName(nameless).withColumnRenamed("id", id_col)


def _bytes(text_col: str) -> F.Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the text that remains; characters of which a byte went are dropped whole.

    Every row stays, with its own columns, if with an empty text (a null text
    reads as empty). Rows with null ids stay as they are. The columns travel with
    the texts, so nothing is joined.
    """
    names = [TEXT if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]
    whole = docs.select(F.col(id_col).cast("bigint").alias("id"), _bytes(text_col).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    kept = _repeated(whole.where("id is not null"), length, "text").toDF(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
