"""Token counts: lengths only, in Arrow batches cut by bytes.

Texts are split before a space that follows another character: in vocabularies
whose pieces hold spaces only at their start, no token crosses such a place, so
the lengths of the parts add up to the length of the whole. Under merge-type
models with the identity normaliser, a part that is still long (Chinese, base64,
minified code) is split again where two characters stand side by side in no
piece, since no merge crosses such a pair. Parts of up to WIDEST characters that
many texts share are encoded once; longer ones are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import frugal, worker_cache

#: Bytes of parts that go to the library in one call, distinct parts a worker remembers, characters of these,
#: and characters from which a part is split where no piece joins.
CALL_BYTES, REMEMBERED, WIDEST, LONG = 1 << 20, 400_000, 64, 4096
SPACE = "▁"


class Counter:
    """Lengths under one sentencepiece or tokenizers model."""

    def __init__(self, model: bytes, kind: str):
        self.kind, self.known = kind, {}
        if kind == "model":
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
            pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
            # A part gets the dummy prefix in place of the space it was cut at.
            self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces) and self.library.encode("a a", out_type=str) == [f"{SPACE}a"] * 2
            self.joined = {pair for p in pieces for pair in zip(p, p[1:])} if self.splits and _plain_merges(model) else None
            if self.joined is not None and any("\n" in pair for pair in self.joined):
                self.joined = None
        else:
            from tokenizers import Tokenizer

            self.library, self.splits, self.joined = Tokenizer.from_str(model.decode()), False, None
            self.library.no_truncation()
            self.library.no_padding()

    def _lengths(self, texts: list[str]) -> list[int]:
        if self.kind == "model":
            return list(map(len, self.library.encode(texts, num_threads=1)))
        return [len(e) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str]:
        """Parts whose lengths add up to that of the text."""
        if not text:
            return []
        if not self.splits or SPACE in text:
            return [text]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        out, begin = [], 0
        while begin < len(text):
            at = begin
            while at < len(text) and text[at] == " ":
                at += 1
            end = text.find(" ", at)
            end = len(text) if end < 0 else end
            out.append(text[begin:end])
            begin = end + 1
            if end == len(text) - 1:  # one space ends the text: a part of its own, which the prefix stands for
                out.append("")
        return out

    def pieces_of(self, part: str) -> list[str]:
        """A long part, cut where no piece joins into stretches of LONG characters or as soon after as can be.

        All but the first begin with a line feed, which keeps the prefix away and joins nothing.
        """
        out, begin = [], 0
        for at in range(1, len(part)):
            if at - begin >= LONG and (part[at - 1], part[at]) not in self.joined:
                out.append(part[begin:at])
                begin = at
        out.append(part[begin:])
        return out[:1] + ["\n" + p for p in out[1:]]

    def encoded(self, parts: Iterable[str]) -> Iterator[tuple[str, int]]:
        """(part, length) of the parts, encoded in calls of bounded bytes."""
        call, size = [], 0
        for part in parts:
            call.append(part)
            size += len(part.encode())
            if size >= CALL_BYTES:
                yield from zip(call, self._lengths(call), strict=True)
                call, size = [], 0
        if call:
            yield from zip(call, self._lengths(call), strict=True)

    def stretched(self, part: str) -> bool:
        """Whether a part is to be cut where no piece joins."""
        return self.joined is not None and len(part) > LONG and " " not in part and SPACE not in part

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.parts(t or "") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        if self.splits:
            self.known[""] = 1  # the prefix alone
        new = set().union(*split) - self.known.keys()
        self.known.update(self.encoded(p for p in new if len(p) <= WIDEST))
        once = dict(self.encoded(p for p in new if len(p) > WIDEST and not self.stretched(p)))
        for part in filter(self.stretched, new):
            pieces = self.pieces_of(part)
            once[part] = sum(n for _, n in self.encoded(pieces)) - self._lengths(["\n"])[0] * (len(pieces) - 1)
        known = self.known
        return [sum(known[p] if len(p) <= WIDEST else once[p] for p in parts) for parts in split]


def _plain_merges(model: bytes) -> bool:
    """Whether a model is merge-type with the identity normaliser, by its own description."""
    from ruleweave.llm.sp_codec import described

    trainer, normalizer = described(model)
    return trainer.get(3, 1) == 2 and not normalizer.get(2, b"") and not normalizer.get(4, 1)


def by_bytes(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs (start, length) of rows of about limit bytes each; a longer text is a run of its own."""
    import pyarrow.compute as pc

    start = size = 0
    for at, own in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if at > start and size + own > limit:
            yield start, at - start
            start, size = at, 0
        size += own
    if len(column) > start:
        yield start, len(column) - start


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, batch_bytes: int = 4 << 20) -> DataFrame:
    """Return id_col, n_bytes, n_tokens and over_limit (n_tokens > max_tokens) of every row.

    Null and empty texts count zero; null ids stay null; repeated rows give
    repeated results; other columns are dropped. No shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    kind = "model" if model_path.endswith(".model") else "json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = worker_cache(("counter", hashlib.md5(model.value).digest()), lambda: Counter(model.value, kind))
        for batch in batches:
            for start, rows in by_bytes(batch.column(1), batch_bytes):
                part = batch.slice(start, rows)
                sizes = pc.cast(pc.fill_null(pc.binary_length(part.column(1)), 0), pa.int64())
                counts = pa.array(counter.count(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, counts, pc.greater(counts, max_tokens)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run, "counter"), "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
