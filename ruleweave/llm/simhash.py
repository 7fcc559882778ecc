"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits. Of two that differ in 4 or fewer, one 32-bit half
differs in 2 or fewer, so each half is covered by itself. The anchors of a half
are the code words of the binary Golay code on 23 bits (covering radius 3; it is
perfect) times all values of the other 9 bits (covering radius 0). Two halves at
distance t have a midpoint at t/2 from both, and the midpoint's anchor is within
radius + t/2 of both; replicating a fingerprint to the anchors within radius + 1
of each half, rather than radius + 2, thus meets every pair that links. These
are 28.6 anchors a fingerprint on average, of 2 * 2^21.

Fingerprints are compared once per distinct value, per anchor, in sorted runs of
Arrow batches; a task gives a spanning forest of the links it found, not all
pairs. Anchors with more than HOT distinct fingerprints are dealt out as pairs
of blocks. Components come from star operations on tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ruleweave.llm.common import cut, deal_out, frugal, spread_join, worker_cache
from ruleweave.llm.components import connected

#: Distinct fingerprints of an anchor that one task compares; more are compared in pairs of blocks.
HOT = 20_000
#: The Golay code's generator polynomial: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
SEED, LINKED = 42, 4


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the XXH64 hashes of a text's word shingles; 0 if it has no word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hash_ = xxhash.xxh64_intdigest
        hashes = [hash_(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, keep: bool = False) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed bigint. With keep, (id_col as it is, fp)."""
    name = F.col(id_col).alias("key") if keep else F.col(id_col).cast("bigint").alias("id")
    rows = docs.select(name, F.col(text_col).cast("string").alias("text"))
    label = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [label, "fp"])

    return rows.mapInArrow(frugal(run), StructType([rows.schema.fields[0], StructField("fp", LongType())]))


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (GOLAY << (bit - 11))
    return x


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """Differences to code words by syndrome: (one of weight 3 or less, all of weight 4 or less padded by repeats)."""

    def make() -> tuple[np.ndarray, np.ndarray]:
        ones = 1 << np.arange(23, dtype=np.int64)
        by_weight = [np.zeros(1, np.int64)]
        for _ in range(4):
            grown = (by_weight[-1][:, None] | ones[None, :])[(by_weight[-1][:, None] & ones[None, :]) == 0]
            by_weight.append(np.unique(grown))
        near, every = np.concatenate(by_weight[:4]), np.concatenate(by_weight)
        first = np.zeros(2048, np.int64)
        first[_syndrome(near)] = near
        order = np.argsort(_syndrome(every), kind="stable")
        each = np.split(every[order], np.cumsum(np.bincount(_syndrome(every), minlength=2048))[:-1])
        width = max(map(len, each))
        return first, np.array([np.resize(e, width) for e in each])

    return worker_cache(("golay",), make)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each fingerprint and each anchor within covering radius + 1 of one of its halves."""
    first, near = _patterns()
    rows, keys = [], []
    value = fp.view(np.uint64)
    for half in (0, 1):
        x = ((value >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        code, rest = x & 0x7FFFFF, x >> 23
        syndrome = _syndrome(code)
        lead = np.int64(half) << 40
        found = lead | (rest[:, None] << 23) | (code[:, None] ^ near[syndrome])
        moved = np.concatenate([lead | ((rest ^ (1 << k)) << 23) | (code ^ first[syndrome]) for k in range(9)]).reshape(9, -1).T
        found = np.sort(np.concatenate([found, moved], axis=1), axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        rows.append(np.nonzero(fresh)[0])
        keys.append(found[fresh])
    return np.concatenate(rows), np.concatenate(keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph with the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(i)
    return a[out], b[out]


def _runs(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, joined so that no key (the first column) stands in two of them."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        held.append(columns)
        size += len(columns[0])
        if size >= at_least:
            whole = [np.concatenate(c) for c in zip(*held)]
            end = int(np.searchsorted(whole[0], whole[0][-1]))
            if end:
                yield [c[:end] for c in whole]
            held, size = [[c[end:] for c in whole]], len(whole[0]) - end
            at_least = max(at_least, 2 * size)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def compare(key: np.ndarray, fp: np.ndarray, side: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints that share a key and differ in `limit` bits or fewer.

    Rows of side 1 and 2 are compared with each other only; those of side 0 with all.
    """
    begin = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1))
    end = np.repeat(np.concatenate((begin[1:], [len(key)])), np.diff(np.concatenate((begin, [len(key)]))))
    value = fp.view(np.uint64)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left, step, held = np.arange(len(key)), 1, 0
    while True:
        left = left[left + step < end[left]]
        if not len(left):
            break
        right = left + step
        close = np.bitwise_count(value[left] ^ value[right]) <= limit
        if side.any():
            close &= (side[left] == 0) | (side[left] != side[right])
        links_a.append(fp[left[close]])
        links_b.append(fp[right[close]])
        held += int(close.sum())
        if held > 500_000:
            a, b = forest(np.concatenate(links_a), np.concatenate(links_b))
            links_a, links_b, held = [a], [b], 0
        step += 1
    return forest(np.concatenate(links_a), np.concatenate(links_b))


def linked(values: DataFrame, limit: int = LINKED) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column fp, enough to span every component."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                rows, keys = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["anchor", "fp"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, fp, side in _runs(batches, 500_000):
            a, b = compare(key, fp, side, limit)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    if limit > 4:
        raise ValueError("the anchors cover differences of 4 bits at most")
    placed = values.mapInArrow(frugal(place, "golay"), "anchor bigint, fp bigint")
    return deal_out(placed, "anchor", "fp", HOT).select("key", "anchor", "fp", "side").mapInArrow(frugal(find), "a bigint, b bigint")


def _components(rows: DataFrame, limit: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of rows (id, fp)."""
    values = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = cut(connected(linked(values.select("fp"), limit)))
    values = values.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    components = values.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(values.select("root", "fp"), components, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LINKED) -> DataFrame:
    """Return id_col (as bigint: ids must be numbers), fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest id that can be reached over links of `limit`
    bits or fewer, the row's own included. Texts without words, null ones too,
    have fingerprint zero and link like any other; null ids take part but name
    no component, unless all ids of one are null; repeated rows give repeated
    results; an empty table gives no rows; other columns are dropped.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    named = spread_join(rows, _components(rows, limit), "fp")
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LINKED) -> DataFrame:
    """The rows of docs, all columns, whose id is that of their component; rows with a null id stay.

    Rows are judged by id and text: of rows that repeat an id, those whose own
    text has an earlier near duplicate go and the others stay.
    """
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    own = docs.select(F.struct(F.col(id_col).cast("bigint").alias("id"), digest.alias("md5")).alias("key"), F.col(text_col).cast("string").alias("text"))
    keyed = cut(fingerprints(own, "key", "text", keep=True))
    rows = keyed.select("key.id", "fp")
    found = spread_join(keyed.select("fp", "key.id", "key.md5"), _components(rows, limit), "fp")
    gone = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__id"), F.col("md5").alias("__md5")).distinct()
    return docs.join(gone, (docs[id_col].cast("bigint") == gone["__id"]) & (digest == gone["__md5"]), "left_anti")
