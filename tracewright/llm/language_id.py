"""Language identification with interpolated Kneser-Ney character models, one per language.

Counts of character 4-grams come from Spark; the smoothed models, made from a sample of bounded size, are sorted arrays of
n-gram hashes with one column of log-probabilities per language, so that one bisection serves SLICE languages. A text gets
the language of least cross-entropy per character; texts above a calibrated cross-entropy are rejected.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, shards, slices, staged, tidied
from .words import mix

ORDER = 4
#: Texts per language that a model is fitted on, drawn by a hash of their id; this bounds the driver's share.
SAMPLE_DOCS = 400
#: Languages whose models share arrays. Every language is learned; more languages make more arrays, not wider ones.
SLICE = 8
#: A text is rejected if its cross-entropy exceeds that of nearly all (REJECT_QUANTILE) of its language's calibration texts
#: by this many nats. These are drawn like the sample, a quarter as many, from texts that the model has not seen.
REJECT_QUANTILE, REJECT_MARGIN, CALIBRATION = 0.995, 1.0, 0.25
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
_SALT = 0x9FB21C651E98DF25
_tables: list[np.ndarray] = []


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case."""
    if not _tables:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                letter[c] = True
                if len(y := x.lower()) == 1:
                    lower[c] = ord(y)
        _tables.extend((letter, lower))
    return _tables[0], _tables[1]


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of texts with one space for each run of anything else, ORDER - 1 spaces before each text; where
    each text begins; how many letters it has."""
    letter, lower = _characters()
    pad = " " * (ORDER - 1)
    joined = [pad + (t or "") for t in texts]
    raw = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)
    is_letter = letter[raw]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    for k in range(ORDER - 1):
        keep[off[:-1] + k] = True
    chars = np.where(is_letter, lower[raw], 32)[keep].astype(np.uint64)
    before = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(is_letter)])
    return chars, before[off], letters[off[1:]] - letters[off[:-1]]


def _hashes(chars: np.ndarray) -> list[np.ndarray]:
    """Hash of the k characters that end at each place, for k = 0 .. ORDER."""
    out = [np.zeros(len(chars), np.uint64)]
    for k in range(1, ORDER + 1):
        prev = np.zeros(len(chars), np.uint64)
        prev[1:] = out[-1][:-1]
        out.append(mix(prev + np.uint64(_SALT * k & (1 << 64) - 1) + chars * np.uint64(0x9E3779B97F4A7C15)))
    return out


def _find(keys: np.ndarray, index: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted hashes among sorted keys, -1 if absent; index holds where each 16-bit prefix begins."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    top = (wanted >> np.uint64(48)).astype(np.int64)
    low, high = index[top], index[top + 1]
    while True:
        open_ = low < high
        if not open_.any():
            break
        mid = (low + high) >> 1
        less = keys[np.minimum(mid, len(keys) - 1)] < wanted
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return np.where(keys[np.minimum(low, len(keys) - 1)] == wanted, low, -1)


@dataclasses.dataclass
class Model:
    """grams[k]: sorted hashes of the n-grams of k characters that any language has, their log-probabilities by language,
    and an index; contexts[k]: likewise for contexts of k characters, with the log of the mass left to shorter ones."""

    languages: list[str]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    unknown: np.ndarray

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character for each text and language, and each text's number of letters."""
        chars, begin, letters = folded(texts)
        return self.of(chars, begin, _hashes(chars)), letters

    def of(self, chars: np.ndarray, begin: np.ndarray, h: list[np.ndarray]) -> np.ndarray:
        real = np.ones(len(chars), bool)
        for k in range(ORDER - 1):
            real[begin[:-1] + k] = False
        at = np.flatnonzero(real)
        total = np.zeros((len(chars), len(self.languages)), np.float32)
        for k in range(ORDER, 0, -1):
            keys, logp, index = self.grams[k]
            place = _find(keys, index, h[k][at])
            seen = place >= 0
            total[at[seen]] += logp[place[seen]]
            at = at[~seen]
            if not len(at):
                break
            if k > 1:
                keys, left, index = self.contexts[k - 1]
                place = _find(keys, index, h[k - 1][at - 1])
                known = place >= 0
                total[at[known]] += left[place[known]]
            else:
                total[at] += self.unknown
        n = np.maximum(begin[1:] - begin[:-1] - (ORDER - 1), 1)
        sums = np.add.reduceat(total, begin[:-1], axis=0, dtype=np.float64) if len(chars) else np.zeros((0, len(self.languages)))
        return -sums / n[:, None]


@dataclasses.dataclass
class Models:
    """The models of all languages, SLICE of them in each part, and by language the cross-entropy above which a text is
    rejected."""

    parts: list[Model]
    limits: np.ndarray = dataclasses.field(default_factory=lambda: np.zeros(0))

    @property
    def languages(self) -> list[str]:
        return [x for part in self.parts for x in part.languages]

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As Model has it, for all languages."""
        chars, begin, letters = folded(texts)
        h = _hashes(chars)
        return np.concatenate([part.of(chars, begin, h) for part in self.parts], axis=1), letters


def _index(keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.int64)


def smooth(languages: list[str], lang: np.ndarray, grams: list[str], count: np.ndarray, alphabet: int | None = None) -> Model:
    """Interpolated Kneser-Ney models from counts of (language, ORDER characters). Shorter n-grams count the different
    characters seen before them; the discount of each order and language is n1 / (n1 + 2 n2). alphabet: how many characters
    there are, where these languages are not all."""
    n_lang = len(languages)
    chars = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, ORDER)
    probs: dict[int, tuple] = {}
    contexts: dict[int, tuple] = {}
    levels = {ORDER: (chars, lang, count.astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):
        up, up_lang, _ = levels[k + 1]
        rows, n = np.unique(np.column_stack([up_lang.astype(np.uint64), up[:, 1:]]), axis=0, return_counts=True)
        levels[k] = (rows[:, 1:], rows[:, 0].astype(np.int64), n.astype(np.float64))
    hashed = lambda c: _hash_rows(c)
    alphabet = alphabet or len(np.unique(levels[1][0]))
    base = np.log(1.0 / (alphabet + 1))
    left1 = np.zeros(n_lang)
    for k in range(1, ORDER + 1):
        c, where, n = levels[k]
        key, ctx = hashed(c), hashed(c[:, :-1])
        keys, inv = np.unique(key, return_inverse=True)
        ctxs, cinv = np.unique(ctx, return_inverse=True)
        n1, n2 = (np.bincount(where[n == x], minlength=n_lang) for x in (1, 2))
        discount = np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.9)
        mass, kinds = np.zeros((len(ctxs), n_lang)), np.zeros((len(ctxs), n_lang))
        np.add.at(mass, (cinv, where), n)
        np.add.at(kinds, (cinv, where), 1)
        left = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
        first = np.unique(inv, return_index=True)[1]
        p = np.zeros((len(keys), n_lang))
        p[inv, where] = np.maximum(n - discount[where], 0) / mass[cinv, where]
        if k == 1:
            lower = np.exp(base)
            left1 = left[0]
        else:
            low_keys, low_logp, low_index = probs[k - 1]
            lower = np.exp(low_logp[_find(low_keys, low_index, hashed(c[first][:, 1:]))])
        probs[k] = (keys, np.log(p + left[cinv[first]] * lower).astype(np.float32), _index(keys))
        if k > 1:
            contexts[k - 1] = (ctxs, np.log(left).astype(np.float32), _index(ctxs))
    return Model(languages, probs, contexts, (np.log(left1) + base).astype(np.float32))


def _hash_rows(c: np.ndarray) -> np.ndarray:
    """As _hashes has it, for rows of characters."""
    h = np.zeros(len(c), np.uint64)
    for k in range(1, c.shape[1] + 1):
        h = mix(h + np.uint64(_SALT * k & (1 << 64) - 1) + c[:, k - 1] * np.uint64(0x9E3779B97F4A7C15))
    return h


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Models:
    """Models of all languages in docs, from at most about sample_docs whole texts of each, drawn by a hash of their id.

    Rows with a null text or language teach nothing. Without any teaching row the models know no language. A language of
    too few texts to spare any is calibrated on those it was learned from, and one of which none was told right by the
    largest limit of the others.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return Models([])
    share = spark.createDataFrame([(r["lang"], min(1.0, sample_docs / r["count"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / (1 << 30)
    drawn = labelled.join(F.broadcast(share), "lang").withColumn("draw", draw)
    sample = drawn.filter("draw < share").select("lang", "text")
    spare = F.col("share") * (1 + CALIBRATION) <= 1
    unseen = drawn.filter(F.when(spare, F.col("draw") >= 1 - F.col("share") * CALIBRATION).otherwise(F.col("draw") < F.col("share"))).select("lang", "text")

    def count(batches):
        for batch in slices(batches):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(names)):
                chars, begin, letters = folded([t for n, t in zip(names, texts, strict=True) if n == name])
                real = np.ones(len(chars), bool)
                for k in range(ORDER - 1):
                    real[begin[:-1] + k] = False
                at = np.flatnonzero(real)
                rows, n = np.unique(np.stack([chars[at - k] for k in range(ORDER - 1, -1, -1)], 1).astype(np.uint32), axis=0, return_counts=True) if len(at) else (np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64))
                joined = np.ascontiguousarray(rows).tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array([joined[i : i + ORDER] for i in range(0, len(joined), ORDER)], pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = staged(sample.mapInArrow(tidied(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return Models([])
    alphabet = counts.agg(F.countDistinct(F.substring("gram", ORDER, 1))).first()[0]
    parts = []
    for i in range(0, len(languages), SLICE):
        some = languages[i : i + SLICE]
        number = {x: k for k, x in enumerate(some)}
        rows = counts.filter(F.col("lang").isin(some)).toArrow()
        parts.append(smooth(some, np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64), rows.column("gram").to_pylist(), rows.column("n").to_numpy(), alphabet))
    models = Models(parts, np.full(len(languages), np.inf))
    right = identify(unseen, models, "text").filter("lang_pred = lang")
    found = {r["lang"]: r["ce"] for r in right.groupBy("lang").agg(F.percentile_approx("cross_entropy", REJECT_QUANTILE, 10_000).alias("ce")).collect()}
    most = max(found.values(), default=float("inf"))
    return dataclasses.replace(models, limits=np.array([found.get(x, most) + REJECT_MARGIN for x in languages]))


def identify(docs: DataFrame, model: Models, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1: the best language's share of exp(-cross-entropy)), cross_entropy (nats per
    character under the best language) and rejected.

    A null text, one without letters, and any text if the model is empty get `und`, 0, null and true. Ties go to the first
    language in order. Whole texts count; equal texts get equal results; columns with these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        m = held.value
        languages = m.languages

        def f(batch, col):
            n = len(col)
            best, score, least = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
            texts = col.to_pylist()
            sizes = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])]).astype(np.int64)
            if languages:
                for i, j in shards(sizes, max(1 << 14, (1 << 20) // min(len(languages), SLICE))):
                    ce, letters = m.cross_entropies(texts[i:j])
                    best[i:j] = ce.argmin(1)
                    low = ce.min(1)
                    score[i:j] = np.where(letters > 0, 1.0 / np.exp(low[:, None] - ce).sum(1), 0.0)
                    least[i:j] = np.where(letters > 0, low, np.inf)
            none = np.isinf(least)
            return {
                "lang_pred": pa.array(["und" if x else languages[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)], pa.string()),
                "score": pa.array(score),
                "cross_entropy": pa.array(np.where(none, 0, least), mask=none),
                "rejected": pa.array(none | (least > m.limits[best] if languages else none)),
            }

        return f

    return append_columns(docs, text, FIELDS, compute)


def teaching(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows that may teach: four fifths, by a checksum of their id."""
    return docs.filter(F.crc32(F.col(doc_id).cast("string")) % 5 != 0)
