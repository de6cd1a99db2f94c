"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model holds a whitespace marker after another character, so no
merge crosses the place where a marker follows a character that is not one.
The text, marked as the library marks it, therefore falls into chunks (markers,
then other characters) that the library segments independently: each distinct
chunk is segmented once per worker, and a text's ids are its chunks' ids joined
by position.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.common import slices, strings

MARK = "▁"
#: Distinct chunks that a worker holds, and the length beyond which a chunk is not held.
TABLE_SIZE, TABLE_CHARS = 200_000, 64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def marked_chunks(text: str, pattern: re.Pattern = re.compile(f"{MARK}+[^{MARK}]*")) -> list[str]:
    """The marked text in chunks; the empty text has none."""
    return pattern.findall(MARK + text.replace(" ", MARK)) if text else []


class ChunkTable:
    """Segments chunks with the library, each distinct one once while it stays in the table.

    The model must be BPE with identity normalisation, a dummy prefix and no
    removal of extra white space, and no piece may hold a marker after another
    character; ``ValueError`` otherwise, as the chunks would not be independent.
    """

    def __init__(self, path: str, size: int = TABLE_SIZE) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.sp.encode("a  b ", out_type=str)[-1] != MARK:
            raise ValueError(f"{path}: pieces cross whitespace markers or white space is removed")
        self.size, self.table = size, {}
        self.mark_ids = [self.sp.piece_to_id(MARK)]

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk, straight from the library (which adds the first marker itself)."""
        out = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        return [x or self.mark_ids for x in out]

    def entries(self, chunks: list[str]) -> list:
        """What ``segmented`` makes of each chunk, in the order of ``chunks``."""
        if len(self.table) > self.size:
            self.table.clear()
        known, large = self.table, {}
        missing = list({c for c in chunks if c not in known})
        for c, entry in zip(missing, self.segmented(missing), strict=True):
            (known if len(c) <= TABLE_CHARS else large)[c] = entry
        return list(map((known | large if large else known).__getitem__, chunks))

    def segmented(self, chunks: list[str]) -> list:
        return self.ids(chunks)


class CodecTable(ChunkTable):
    """Entries: a chunk's ids as little-endian unsigned 32-bit integers, and its decoded text."""

    def __init__(self, path: str, **options) -> None:
        super().__init__(path, **options)
        sp, n = self.sp, self.sp.get_piece_size()
        #: What an ordinary piece decodes to; the library decodes chunks with any other piece.
        self.plain = {i: sp.id_to_piece(i).replace(MARK, " ") for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}

    def segmented(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        plain, out = self.plain, []
        for x in self.ids(chunks):
            try:
                out.append((array("I", x).tobytes(), "".join([plain[i] for i in x])))
            except KeyError:
                out.append((array("I", x).tobytes(), " " + self.sp.decode(x)))
        return out

    def encode(self, text: str, begin: bool = True, end: bool = True) -> tuple[bytes, str]:
        """``text`` as ids, and what these ids decode to."""
        found = self.entries(marked_chunks(text))
        edge = [array("I", [x]).tobytes() for x in (self.sp.bos_id(), self.sp.eos_id())]
        ids = b"".join([edge[0] * begin, *(x for x, _ in found), edge[1] * end])
        return ids, "".join([x for _, x in found])[1:]


# ids are written as the machine holds them
assert sys.byteorder == "little" and array("I").itemsize == 4


def encode_decode(docs: DataFrame, text: str = "text", model: str | None = None, begin: bool = True, end: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but ``text`` by default) of each row with ``ids`` and ``decoded``.

    ``ids`` (binary) holds little-endian unsigned 32-bit ids as the library's
    ``encode`` gives them, ``decoded`` the library's ``decode`` of them. A null
    text counts as empty: only the begin and end ids, decoded to ''. Repeated
    rows are kept; an empty table gives an empty result. Columns named ``ids``
    or ``decoded`` in the input are replaced. One narrow pass without shuffle; a
    worker holds one slice of rows and a bounded table.
    """
    path = model or model_path()
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in (text, "ids", "decoded")]
    source = docs.select(*keep, text)
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != text), "ids binary", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = CodecTable(path)
        for batch in slices(batches, text):
            pairs = [codec.encode(x, begin, end) for x in strings(batch.column(text))]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([i for i, _ in pairs], pa.binary()), pa.array([d for _, d in pairs], pa.string())], [*keep, "ids", "decoded"])

    return source.mapInArrow(run, out_schema)
