"""SentencePiece ids by a distinct-chunk table.

SentencePiece marks every space with U+2581 and puts one mark before the text.  If no piece of
the vocabulary has a mark behind another character (``_model`` refuses a model where one has),
no merge joins a character and a mark behind it, so a text is the concatenation of its chunks:
a run of marks with the characters up to the next mark.  Chunks repeat; each task keeps a table
chunk -> ids, asks the library once for every distinct chunk, and joins the ids back by position.
Decoding needs no table: the library's own decoder walks over the ids of a whole text.

Plan: two map-only steps (``mapInArrow``); nothing is shuffled, collected or broadcast, and a lost
task is run again from its input split.  New chunks are collected over blocks of ``BLOCK`` characters
(or one longer text, in slices of ``SLICE`` chunks) and segmented in one call.  The table is begun
anew beyond ``TABLE_ROWS`` chunks or ``TABLE_CHARS`` characters, which costs time and changes no result.

Defined results: a null text is empty, an empty text is the begin and the end id; repeated rows and
null ids stay as they are; an empty table gives no rows; other columns of the input are not read.
Ids are little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import functools
import re
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE_ROWS = 300_000
TABLE_CHARS = 20_000_000
BLOCK = 2_000_000
SLICE = 300_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@functools.lru_cache(maxsize=2)
def _model(path: str):
    """The library's processor, checked for what the chunks rely on."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece has a whitespace mark behind another character: chunks would not be independent")
    probe = " ﬁ  x² \n\tÉ　 "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model normalises texts: chunks would not be parts of the text")
    return sp


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Table:
    """Distinct chunks of the texts that a task has seen, and their ids."""

    def __init__(self, sp):
        self.sp, self.ids, self.chars = sp, {}, 0
        # The library adds no mark to an empty text, so the chunk of one mark is read from a text that ends with it.
        self.mark = _packed(sp.encode("a ")[len(sp.encode("a")):])

    def learn(self, keys: set[str]) -> None:
        """Segment the keys that are not in the table, each once."""
        new = [k for k in keys if k not in self.ids]
        if len(self.ids) + len(new) > TABLE_ROWS or self.chars > TABLE_CHARS:
            self.ids, self.chars, new = {"": self.mark}, 0, [k for k in keys if k]
        elif "" in new:
            self.ids[""] = self.mark
            new.remove("")
        if new:
            self.chars += sum(map(len, new))
            self.ids.update(zip(new, map(_packed, self.sp.encode(new, num_threads=1))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, without begin and end."""
        parts = [chunks(t) for t in texts]
        if sum(map(len, parts)) <= SLICE:
            self.learn(set().union(*parts))
            return [b"".join(map(self.ids.__getitem__, p)) for p in parts]
        return [b"".join(self._slices(p)) for p in parts]

    def _slices(self, part: list[str]):
        for i in range(0, len(part), SLICE):
            own = part[i:i + SLICE]
            self.learn(set(own))
            yield b"".join(map(self.ids.__getitem__, own))


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first mark (which is the one that the library adds)."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    return _Table(_model(path)).encode


def _decoder(path: str):
    """ids of texts as bytes -> the texts."""
    import numpy as np

    sp = _model(path)
    return lambda data: sp.decode([np.frombuffer(d, "<u4").tolist() for d in data], num_threads=1)


def _mapped(df: DataFrame, source: str, target: str, kind: str, function) -> DataFrame:
    """``df`` with ``target``: ``function()`` applied to the list of values of ``source`` of a block of rows."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        apply = function()
        for batch in batches:
            sizes, at, values = pc.fill_null(pc.binary_length(batch.column(source)), 0).to_pylist(), 0, []
            while at < len(sizes):
                end, total = at + 1, sizes[at]
                while end < len(sizes) and total + sizes[end] <= BLOCK:
                    total += sizes[end]
                    end += 1
                values += apply(batch.column(source).slice(at, end - at).to_pylist())
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary() if kind == "binary" else pa.string())],
                                             [*batch.schema.names, target])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{target}` {kind}")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the begin id, the text's ids, the end id."""
    def function():
        sp, pieces = _model(model), _encoder(model)
        begin, end = _packed([sp.bos_id()]), _packed([sp.eos_id()])
        return lambda texts: [begin + ids + end for ids in pieces([t or "" for t in texts])]

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _mapped(d, "text", "ids", "binary", function).select("doc_id", "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: what the library's ``decode`` gives for ``ids``."""
    return _mapped(encoded.select("doc_id", "ids"), "ids", "decoded", "string",
                   lambda: lambda data, texts=_decoder(model): texts([d or b"" for d in data]))


def n_ids(ids: Column) -> Column:
    """Number of ids in a binary value."""
    return (F.octet_length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row."""
    return decode(encode(docs, model), model)
