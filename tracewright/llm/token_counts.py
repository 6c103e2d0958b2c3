"""Token counts of whole texts under a SentencePiece BPE model, with huge texts encoded in overlapping chunks.

A chunk is encoded with offsets. Two neighbours are spliced at the first place in their overlap that both of them cut and
that is proven stable: no piece of the vocabulary holds the two characters beside it next to each other, so that no merge
can ever span it and both sides are encoded as they would be in the whole text. Where an overlap has no such place, the
document is encoded again with chunks and overlaps WIDEN times as large, in the end as a whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, staged, tidied, without

CHUNK, OVERLAP, WIDEN = 32_768, 512, 8
#: Characters of chunks that a task hands on together.
HANDED = 2 << 20
_SPACE = "▁"
_loaded: dict[str, tuple] = {}


def _model(path: str):
    """The processor, and all pairs of characters that stand side by side in a piece of its vocabulary."""
    if path not in _loaded:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (p.id_to_piece(i) for i in range(p.get_piece_size()))
        _loaded[path] = p, {x[i : i + 2] for x in pieces for i in range(len(x) - 1)}
    return _loaded[path]


def provable(path: str) -> bool:
    """Whether the stability proof holds: a BPE model that takes the text as it is, but for a space before it."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(_model(path)[0].serialized_model_proto())
    norm, kind = model.normalizer_spec, model.trainer_spec
    return kind.model_type == kind.BPE and not kind.treat_whitespace_as_suffix and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces


def _cut(text: str, at: int, overlap: int, pairs: set[str], begins: set[int]) -> int | None:
    """The first stable place from at on (or the text's end) where a token begins."""
    for i in range(at, min(at + overlap, len(text))):
        if text[i - 1 : i + 1].replace(" ", _SPACE) not in pairs and len(text[:i].encode()) in begins:
            return i
    return None


def _spans(path: str, overlap: int):
    """(key, chunk, start, end, n_tokens) of chunk rows (key, chunk, from, nominal start, nominal end, length, text)."""

    def run(batches):
        p, pairs = _model(path)
        for batch in batches:
            out = []
            for key, chunk, begin, start, end, length, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = [x.begin for x in p.encode(text, return_type="proto").pieces]
                known = set(starts)
                a = 0 if start == 0 else _cut(text, start - begin, overlap, pairs, known)
                b = length - begin if end >= length else _cut(text, end - begin, overlap, pairs, known)
                if a is None or b is None:
                    out.append((key, chunk, None, None, None))
                    continue
                low, high = len(text[:a].encode()), len(text[:b].encode())
                n = sum(low <= x < high for x in starts) if end < length else sum(low <= x for x in starts)
                out.append((key, chunk, begin + a, begin + b, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(zip(*out, strict=True))], names=["key", "chunk", "start", "end", "n"])

    return run


def _slices(chunk: int, overlap: int):
    """Chunk rows of rows (key, text), each text cut in one pass over it."""
    names = ["key", "chunk", "from", "nominal", "end", "length", "text"]

    def run(batches):
        out, held = [], 0
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, start in enumerate(range(0, max(len(text), 1), chunk)):
                    begin = max(start - 1, 0)
                    out.append((key, k, begin, start, start + chunk, len(text), text[begin : start + chunk + overlap]))
                    held += len(out[-1][-1])
                    if held >= HANDED:
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(list(zip(*out, strict=True))[:6])), pa.array([x[6] for x in out], pa.string())], names=names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(list(zip(*out, strict=True))[:6])), pa.array([x[6] for x in out], pa.string())], names=names)

    return run


def _chunked(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """key, n_tokens of texts (key, text), in as many rounds as alignments ask for."""
    done = None
    todo = staged(long.distinct(), "huge")
    while True:
        rows = todo.mapInArrow(tidied(_slices(chunk, overlap)), "key string, chunk long, from long, nominal long, end long, length long, text string")
        spans = rows.repartition("key", "chunk").mapInArrow(tidied(_spans(path, overlap)), "key string, chunk long, start long, end long, n long")
        whole = (F.count("*") == F.count("n")) & (F.sum(F.col("end") - F.col("start")) == F.max("end"))
        found = staged(spans.groupBy("key").agg(F.when(whole, F.sum("n")).alias("n_tokens")), "spliced")
        good = found.filter("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        todo = todo.join(found.filter("n_tokens is null").select("key"), "key", "left_semi")
        if todo.isEmpty():
            return done
        todo = staged(todo, "huge")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), as the library counts each whole text: no begin,
    end or added special tokens, special strings as ordinary text, nothing cut off.

    Null and empty texts have no tokens; repeated rows are each counted; columns with these names are replaced. Texts of at
    most `chunk` characters are encoded where they are; only longer ones are shuffled, as chunks. Under a model that changes
    texts before it cuts them, or that isn't BPE, the stability proof doesn't hold and all texts are encoded whole.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    docs = without(docs, names)
    huge = F.char_length(text) > chunk if provable(model_file) else F.lit(False)

    def whole():
        p, _ = _model(model_file)
        return lambda batch, col: {"n_tokens": pa.array([len(x) for x in p.encode([t or "" for t in col.to_pylist()], num_threads=1)], pa.int64())}

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    short = append_columns(docs.filter(~F.coalesce(huge, F.lit(False))).withColumn("n_bytes", size), text, [T.StructField("n_tokens", T.LongType())], whole)
    if not provable(model_file):
        return short.withColumn("over_limit", F.col("n_tokens") > limit)
    long = docs.filter(huge).withColumn("n_bytes", size).withColumn("__key", F.sha2(F.encode(F.col(text), "UTF-8"), 256))
    counts = _chunked(long.select(F.col("__key").alias("key"), F.col(text).alias("text")), model_file, chunk, overlap)
    long = long.join(counts.withColumnRenamed("key", "__key"), "__key").select(*docs.columns, "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
