"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says (dummy prefix, spaces as U+2581), its
characters become symbols, and an agenda ordered by (piece score, position)
holds the adjacent pairs whose concatenation is a piece. The best pair merges,
its two neighbours enter the agenda, stale entries are skipped. Characters that
end outside the vocabulary become byte pieces.

No merge can cross a pair of characters that stands side by side in no piece, so
texts fall apart at such pairs; each distinct segment goes through the agenda
once per worker (a cache that bounds entries and their length; longer segments
are not kept), and each segment that is made is compared with the sentencepiece
library, ids and decoded text, a batch at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import Generations, frugal, worker_cache

SPACE = "▁"
#: Distinct words and segments that a worker keeps; twice as many at most.
WORD_LIMIT, SEGMENT_LIMIT = 180_000, 120_000
#: Symbols up to which the agenda is a plain list; and the score of a pair that is no piece.
SHORT, NEVER = 48, float("inf")
SCHEMA = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def described(model: bytes) -> tuple[dict, dict]:
    """(trainer, normaliser) settings of a model file."""
    trainer = dict(_fields(next((v for n, v in _fields(model) if n == 2), b"")))
    return trainer, dict(_fields(next((v for n, v in _fields(model) if n == 3), b"")))


class Codec:
    """Encoder and decoder for the bytes of one .model file."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check = check
        self.pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        if any(self.library.is_unused(i) for i in plain):
            raise ValueError("vocabularies with unused pieces need resegmentation, which is not offered")
        self.number = {self.pieces[i]: i for i in plain}
        self.order = {self.pieces[i]: -self.library.get_score(i) for i in plain}
        self.names = list(map(str, range(len(self.pieces))))
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if self.library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = self.library.unk_id()
        #: Text of each id; None for bytes.
        self.text_of = [None if i in self.byte_of else " ⁇ " if i == self.unknown else "" if self.library.is_control(i) else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        trainer, normalizer = described(model)
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type (BPE) model")
        if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models with the identity normaliser are offered")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.joined = {pair for p in self.number for pair in zip(p, p[1:])}
        self.crosses = any(a != SPACE and b == SPACE for a, b in self.joined)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.segments = Generations(self._segment, SEGMENT_LIMIT)
        self.words = Generations(self._word, WORD_LIMIT)
        self.unchecked: list[tuple[str, list[int], str]] = []

    def agenda(self, text: str) -> list[int]:
        """Ids of a normalised text, by the agenda alone."""
        symbols = self._short(list(text)) if len(text) <= SHORT else self._long(list(text))
        ids = list(map(self.number.get, symbols))
        if None not in ids:
            return ids
        ids = []
        for symbol in symbols:
            if symbol in self.number:
                ids.append(self.number[symbol])
            elif self.byte:
                ids.extend(self.byte[b] for b in symbol.encode())
            else:
                ids.append(self.unknown)
        return ids

    def _short(self, symbols: list[str]) -> list[str]:
        """The agenda as a list in text order: min() takes the best score and, of equals, the leftmost."""
        get = self.order.get
        agenda = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            at = agenda.index(best)
            symbols[at] = pair = symbols[at] + symbols.pop(at + 1)
            del agenda[at]
            if at < len(agenda):
                agenda[at] = get(pair + symbols[at + 1], NEVER)
            if at:
                agenda[at - 1] = get(symbols[at - 1] + pair, NEVER)
        return symbols

    def _long(self, symbols: list[str | None]) -> list[str]:
        """The agenda as a heap; entries whose symbols have merged meanwhile are stale and skipped."""
        n, order = len(symbols), self.order
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(order[pair], at, pair) for at in range(n - 1) if (pair := symbols[at] + symbols[at + 1]) in order]
        heapq.heapify(agenda)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] is None or right >= n or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, None
            end = after[left] = after[right]
            if end < n:
                before[end] = left
                if (grown := pair + symbols[end]) in order:
                    heapq.heappush(agenda, (order[grown], left, grown))
            if (start := before[left]) >= 0 and (grown := symbols[start] + pair) in order:
                heapq.heappush(agenda, (order[grown], start, grown))
        return [s for s in symbols if s is not None]

    def _segment(self, segment: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text with its leading space) of a segment."""
        ids = self.agenda(segment)
        names = self.names
        value = (",".join([names[i] for i in ids]), self.decode_part(ids))
        if self.check:
            self.unchecked.append((segment, ids, value[1]))
        return value

    def _word(self, word: str) -> tuple[str, str]:
        """The same of a word, from its segments."""
        joined = self.joined
        if joined.issuperset(zip(word, word[1:])):
            return self.segments[word]
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in joined]
        parts = [self.segments[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)])]
        return ",".join([p[0] for p in parts]), "".join([p[1] for p in parts])

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids without the handling of the start: spaces for U+2581, byte runs as UTF-8."""
        out = [self.text_of[i] for i in ids]
        if None not in out:
            return "".join(out)
        text, run = [], bytearray()
        for i, own in zip(ids, out):
            if own is None:
                run.append(self.byte_of[i])
                continue
            if run:
                text.append(_utf8(run))
                run = bytearray()
            text.append(own)
        if run:
            text.append(_utf8(run))
        return "".join(text)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_part(ids)
        return text[1:] if self.prefix and ids and self.pieces[ids[0]].startswith(SPACE) else text

    def split(self, text: str) -> list[str]:
        """Words of the normalised text; no merge crosses from one to the next."""
        if not text:
            return []
        if self.crosses:
            return [self.prefix + text.replace(" ", SPACE)]
        if self.prefix and "  " not in text and SPACE not in text and text[0] != " ":
            words = text.split(" ")
            if words[-1]:
                return [SPACE + w for w in words]
        return self.parts.findall(self.prefix + text.replace(" ", SPACE))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids = [int(i) for w in self.split(text) for i in self.words[w][0].split(",")]
        self.compare()
        return ids

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        words = self.split(text or "")
        own = self.words
        values = [own[w] for w in words]
        ids = ",".join([v[0] for v in values])
        decoded = "".join([v[1] for v in values])
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return (ids.count(",") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def compare(self) -> None:
        """Compare the segments met since the last call with the library; ValueError if any differs.

        A segment without a leading space is encoded behind a line feed, which
        no piece joins to anything.
        """
        lead = self.library.encode("\n")
        for begins in (True, False):
            held = [u for u in self.unchecked if (u[0][0] == SPACE and bool(self.prefix)) is begins and u[0] != self.prefix]
            behind = "" if begins or not self.prefix else "\n"
            drop = len(lead) if behind else 0
            theirs = self.library.encode([s[1:] if begins else behind + s for s, _, _ in held], num_threads=1)
            for (segment, ids, _), found in zip(held, theirs, strict=True):
                if ids != (found[drop:] if drop else found):
                    raise ValueError(f"the agenda and the library differ on {segment!r}: {ids} and {found[drop:]}")
            # Segments are decoded in one call; they are whole characters, so the texts only stand side by side.
            every = [i for found in theirs for i in found[drop:]]
            text = "".join([decoded for _, _, decoded in held])
            if every and self.library.decode(every) != (text[1:] if self.prefix and self.pieces[every[0]].startswith(SPACE) else text):
                raise ValueError(f"decoding and the library differ on one of {[s for s, _, _ in held][:50]!r}")
        self.unchecked = []


def _utf8(run: bytearray) -> str:
    """A run of byte pieces; each byte that is no part of valid UTF-8 is one replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at : at + size]).decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def codec(model: bytes, check: bool = True) -> Codec:
    """The codec of this worker for these bytes."""
    return worker_cache(("codec", hashlib.md5(model).digest(), check), lambda: Codec(model, check))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, check: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids
    array<int> and decoded string. Rows stay as they are: a null id stays null,
    repeated rows give repeated results, null and empty texts have no ids and
    decode to the empty text, other columns are dropped. There is no shuffle; a
    lost executor repeats its own splits only.
    """
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    schema = SCHEMA + (", ids array<int>, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value, check)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                found = list(zip(*map(own.digest, texts)))
                own.compare()
                columns = [part.column(0), pa.array(found[0], pa.int64()), pa.array(found[1]), pa.array(found[2])]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    ids = [own.encode(t) for t in texts]
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run, "codec"), schema).withColumnRenamed("id", id_col)
