"""SentencePiece encoding and decoding of whole texts as maps over the table (see piece_transducer).

Scale: no shuffle. Each Python worker compiles the model once and remembers a
bounded number of units.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import piece_transducer

_loaded: dict[str, piece_transducer.PieceTransducer] = {}


def _machine(path: str) -> piece_transducer.PieceTransducer:
    if path not in _loaded:
        _loaded[path] = piece_transducer.load(path)
    return _loaded[path]


def _mapped(df: DataFrame, added: list[tuple[str, T.DataType, pa.DataType]], of_row, source: str) -> DataFrame:
    kept = df.drop(*(n for n, _, _ in added if n != source))
    replaced = [n for n, _, _ in added if n == source]
    fields = [f for f in kept.schema.fields if f.name not in replaced]
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(source)
            made = [of_row(x.as_py()) for x in b.column(at)]
            new = [pa.array([m[k] for m in made], kind) for k, (_, _, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), *new], names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (signed 32-bit little-endian bytes) and ``n_pieces``. Null and '' have no pieces."""

    def of_row(text):
        ids = _machine(model_path).encode(text)
        return ids.tobytes(), len(ids)

    return _mapped(docs, [("ids", T.BinaryType(), pa.binary()), ("n_pieces", T.LongType(), pa.int64())], of_row, text_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids. Null ids give ''."""

    def of_row(raw):
        ids = array("i")
        ids.frombytes(raw or b"")
        return (_machine(model_path).decode(ids),)

    return _mapped(encoded, [(text_col, T.StringType(), pa.string())], of_row, ids_col)


def encode_and_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_pieces, ids and exact (the text comes back; null counts as '')."""
    others = [c for c in docs.columns if c not in (text_col, "ids", "n_pieces", "exact")]
    docs = docs.select(*others, text_col)

    def of_row(text):
        machine = _machine(model_path)
        ids = machine.encode(text)
        return len(ids), ids.tobytes(), machine.decode(ids) == (text or "")

    added = [("n_pieces", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary()), ("exact", T.BooleanType(), pa.bool_())]
    return _mapped(docs, added, of_row, text_col).drop(text_col)
