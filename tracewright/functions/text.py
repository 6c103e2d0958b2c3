"""Words for retrieval: the simple configuration (lower case; letters, marks and digits of all scripts) and an English one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed as packing
from .porter2 import stem

#: Letters, the marks that belong to them, and digits; Java's and RE2's dialects read it alike.
WORD = r"[\pL\pM\pN]+"
#: The words that the English configuration leaves out.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def lexemes(text: Column) -> Column:
    """The words of a text in order, lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def english(rows: DataFrame, column: str = "lexeme") -> DataFrame:
    """rows without stop words, the others stemmed. Each different word of an Arrow batch is stemmed once, and nothing is
    shuffled: a vocabulary to be joined back would move every posting once more."""
    rows = rows.filter(~F.col(column).isin(*STOP_WORDS))
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            words = pc.dictionary_encode(batch.column(at))
            if len(known) > 1 << 20:
                known.clear()
            stems = pa.array([known.get(w) or known.setdefault(w, stem(w)) for w in words.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([stems.take(words.indices) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def tokenize(df: DataFrame, text: str, config: str = "simple", keep: tuple[str, ...] = ("uuid",)) -> DataFrame:
    """keep columns, lexeme and pos (from 0). `english` leaves stop words out, keeping the places of the others, and stems."""
    rows = df.select(*keep, F.posexplode(lexemes(F.col(text))).alias("pos", "lexeme"))
    return rows if config == "simple" else english(rows)


def _grouped(config: str, wanted: list[str] | None, packed: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (group, id, words): for each group of a batch and each of its different words (of wanted ones only, if they are given)
    the ids of the rows that hold it, and its places in each, as lists or packed. A row's places are in one batch, so that nothing
    is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if wanted is None else pa.array(wanted, pa.string())
        for batch in batches:
            group, ids, lists = batch.columns
            off = lists.offsets.to_numpy().astype(np.int64)
            n = np.diff(off)
            row, pos = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(off[:-1] - off[0], n)
            words = pc.dictionary_encode(lists.flatten())
            code, names = words.indices.to_numpy().astype(np.int64), words.dictionary
            keep, to = np.ones(len(names), bool), np.arange(len(names))
            if config != "simple":
                keep = ~pc.is_in(names, pa.array(STOP_WORDS, pa.string())).to_numpy(zero_copy_only=False)
                stems = pc.dictionary_encode(pa.array([stem(w) if k else w for w, k in zip(names.to_pylist(), keep, strict=True)], pa.string()))
                to, names = stems.indices.to_numpy().astype(np.int64), stems.dictionary
            if asked is not None:
                keep = keep & pc.is_in(names, asked).to_numpy(zero_copy_only=False)[to]
            if not keep.all():
                row, pos, code = (x[keep[code]] for x in (row, pos, code))
            if not len(row):
                continue
            kinds = pc.fill_null(pc.dictionary_encode(group).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            block = kinds[row] * len(names) + to[code]
            order = np.argsort(block * len(n) + row, kind="stable")
            block, row = block[order], row[order]
            new = np.append(True, block[1:] != block[:-1])
            held = np.flatnonzero(new | np.append(True, row[1:] != row[:-1]))
            first = np.flatnonzero(new)
            keys = [group.take(pa.array(row[first])), names.take(pa.array(block[first] % len(names)))]
            if packed:
                counts = np.diff(held, append=len(row))
                some = packing.Postings(np.diff(np.searchsorted(held, first), append=len(held)), packing.ids_of(ids.take(pa.array(row[held]))), counts, pos[order])
                yield pa.RecordBatch.from_arrays([*keys, *packing.pack(some)], names=[batch.schema.names[0], "lexeme", *packing.NAMES])
                continue
            ends = pa.array(np.append(np.searchsorted(held, first), len(held)).astype(np.int32))
            places = pa.ListArray.from_arrays(pa.array(np.append(held, len(row)).astype(np.int32)), pa.array(pos[order].astype(np.int32)))
            columns = [*keys, pa.ListArray.from_arrays(ends, ids.take(pa.array(row[held]))), pa.ListArray.from_arrays(ends, places)]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "lexeme", "ids", "places"])

    return run


def word_blocks(df: DataFrame, text: str, config: str = "simple", group: str = "namespace", name: str = "uuid", wanted: list[str] | None = None, packed: bool = False) -> DataFrame:
    """group, lexeme, ids and places: of each batch of rows, which of them hold a lexeme, and where (ascending; see tokenize).
    A lexeme has a row for each batch that holds it. wanted: the only lexemes that are asked for. packed: with the columns of
    functions.packed instead of lists."""
    rows = df.select(group, name, lexemes(F.col(text)).alias("__words"))
    if packed:
        kind = T.StructType([rows.schema[group], T.StructField("lexeme", T.StringType()), *T._parse_datatype_string(packing.FIELDS)])
        return rows.mapInArrow(_grouped(config, wanted, True), kind)
    kind = T.StructType([rows.schema[group], T.StructField("lexeme", T.StringType()), T.StructField("ids", T.ArrayType(rows.schema[name].dataType)), T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType())))])
    return rows.mapInArrow(_grouped(config, wanted), kind)


def preview(text: Column, n: int | Column) -> Column:
    """The first n characters."""
    return F.substring(text, F.lit(1), n if isinstance(n, Column) else F.lit(n))
