"""SentencePiece ids of whole texts for merge-type (BPE) vocabularies, and texts from ids.

A text gets a space in front, spaces become the mark ``▁``, and its letters are joined by an agenda of adjacent symbol
pairs: the pair whose joined piece has the best score comes first, among equal ones the leftmost, and each join puts
the pairs with its two neighbours on the agenda.  What is no piece in the end falls back to its bytes.

No piece of such a vocabulary has a mark behind another symbol, or a letter beside a symbol that is neither letter nor
mark, so no join crosses those places: the text is cut there and every different chunk is solved once.  Each new chunk
is checked against the ``sentencepiece`` library, one call for an Arrow slice; a difference raises.  A vocabulary that
breaks the rule, or has no bytes to fall back to, is solved without cuts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from warmtrace.llm.common import slices
from warmtrace.llm.tokens import Remembered

MARK = "▁"
# A worker remembers the ids of at most twice this many chunks, and of none longer than this.
CACHED, LONGEST = 200_000, 64


class PieceEncoder:
    """The ids of texts with one model file, as little-endian signed 32-bit numbers."""

    def __init__(self, path: str, cached: int = CACHED):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.vocab_size())
        if any(library.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        special = {i for i in ids if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        self.ids = {library.id_to_piece(i): i for i in ids if i not in special}
        self.scores = {p: -library.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=0)
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(library.is_byte, ids)) else None
        # Numbers that regular expressions take for letters, as ², are none.
        numbers = "".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        self.letter = re.compile(rf"[^\W\d_{numbers}]")
        # A piece that is one chunk by itself crosses no cut, wherever it stands.
        self.chunks = re.compile(rf"{MARK}*(?:[^\W\d_{numbers}]+|(?:[^\w{MARK}]|[\d_{numbers}])+)|{MARK}+").findall
        if self.bytes is None or any(self.chunks(p) != [p] for p in self.ids):
            self.chunks = re.compile("(?s).+").findall
        self.known = Remembered(cached)
        for probe in ("a", " a  b ", "ﬁ①ａ\t\n", "▁", " "):
            if self.agenda(MARK + probe.replace(" ", MARK)) != library.encode(probe):
                raise ValueError("only merge-type vocabularies that leave letters as they are and put a space in front are supported")

    def agenda(self, chunk: str) -> list[int]:
        """The ids of a chunk by its score-ordered agenda."""
        symbols, scores, longest = list(chunk), self.scores, self.longest
        last = len(chunk) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        heap = [(scores[pair], at, pair) for at, pair in enumerate(map(add, symbols, symbols[1:])) if pair in scores]
        heapq.heapify(heap)
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left]
            # One of the two has gone, or has grown, since the pair was proposed.
            if right > last or symbols[left] + symbols[right] != joined or not symbols[left]:
                continue
            symbols[left], symbols[right] = joined, ""
            right = after[left] = after[right]
            if right <= last:
                before[right] = left
                pair = joined + symbols[right] if len(joined) < longest else ""
                if pair in scores:
                    heapq.heappush(heap, (scores[pair], left, pair))
            left = before[left]
            if left >= 0:
                pair = symbols[left] + joined if len(joined) < longest else ""
                if pair in scores:
                    heapq.heappush(heap, (scores[pair], left, pair))
        out: list[int] = []
        unknown = self.library.unk_id()
        for symbol in filter(None, symbols):
            if symbol in self.ids:
                out.append(self.ids[symbol])
            elif self.bytes is not None:
                out.extend(self.bytes[b] for b in symbol.encode())
            elif not out or out[-1] != unknown:
                out.append(unknown)
        return out

    def solved(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, each checked against the library."""
        ids = [self.agenda(c) for c in chunks]
        # The library puts a mark in front of every text but an empty one.  Other chunks are told behind a full stop or an a.
        lead = ["" if c[0] == MARK else "." if self.letter.match(c) else "a" for c in chunks]
        begun = {"": [], ".": self.library.encode("."), "a": self.library.encode("a")}
        theirs = self.library.encode([x + c if x else c[1:] for x, c in zip(lead, chunks)], num_threads=1)
        for x, chunk, own, other in zip(lead, chunks, ids, theirs):
            if begun[x] + own != other and chunk != MARK:
                raise ValueError(f"the library encodes {x + chunk!r} as {other}, not as {begun[x] + own}")
        return [np.array(i, "<i4").tobytes() for i in ids]

    def encode(self, texts: list[str | None], end: bytes = b"") -> Iterator[bytes]:
        """The ids of each text, and ``end`` behind them; null and empty texts have none."""
        cut = [self.chunks(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        new = known.missing(set().union(*cut))
        known.young.update(zip(new, self.solved(new)))
        for chunks in cut:
            yield b"".join(map(known.young.__getitem__, chunks)) + end
        for chunk in new:
            if len(chunk) > LONGEST:
                del known.young[chunk]


_loaded: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker and file."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def _schema(df: DataFrame, kept: list[str], *made: StructField) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in df.select(*[F.col(f"`{c}`") for c in kept]).schema] + list(made))


def encode(docs: DataFrame, *, model: str, end: bool = True, decoded: bool = False, text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and ids array<int>; with ``decoded`` also the text that the ids give.

    ``model`` is the path of a sentencepiece model file.  ``end`` puts the model's end id behind each text.  A null
    text is an empty one and has no other id.  Rows are encoded on their own, repeated ones too; an empty table gives
    no rows.  Other columns stay, whatever their names, but for ids (and decoded), which are replaced.
    """
    made = ["ids", "decoded"] if decoded else ["ids"]
    kept = [c for c in docs.columns if c not in [*made, text_column]]
    schema = _schema(docs, kept, StructField("ids", ArrayType(IntegerType(), False)),
                     *[StructField("decoded", StringType())] * decoded)

    def ids_of(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        last = np.array([encoder.library.eos_id()] if end else [], "<i4").tobytes()
        for batch in source:
            for some in slices(batch, batch.schema.names[-1], size=1 << 20):
                raw = list(encoder.encode(some.column(len(kept)).to_pylist(), last))
                ends = np.cumsum([0, *map(len, raw)]) // 4
                flat = np.frombuffer(b"".join(raw), "<i4")
                columns = [*some.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([encoder.library.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    plain = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_column}`").cast("string").alias("text"))
    return plain.mapInArrow(ids_of, schema)


def decode(rows: DataFrame, *, model: str, ids_column: str = "ids") -> DataFrame:
    """The columns of ``rows`` but its ids, and text: what the library makes of the ids.

    A null list gives a null text, an empty one an empty text.  A column ``text`` is replaced.
    """
    kept = [c for c in rows.columns if c not in ["text", ids_column]]
    schema = _schema(rows, kept, StructField("text", StringType()))

    def texts_of(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = piece_encoder(model).library
        for batch in source:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                texts = [None if ids is None else library.decode(ids) for ids in some.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_column}`").cast("array<int>")).mapInArrow(texts_of, schema)
