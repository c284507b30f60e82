"""Language identification with interpolated Kneser-Ney character models.

Characters are lower-cased; letters stand for themselves, each run of others is
one space. Per language a model of order 4 is estimated from n-gram counts that
Spark sums over a bounded sample of labelled rows (``rows_per_lang`` rows of
each language in expectation, whole texts, chosen by a hash of the id). The
models are kept together in sorted arrays of n-gram hashes, one row of log
probabilities per hash and one column per language. Every letter of the sample
has a name of its own; letters that no sampled row has are one class. A text gets the language of
lowest cross-entropy per character. Rejection is calibrated on further labelled
rows: a text is rejected if it has no letters, or if its cross-entropy is more
than ``slack`` bits and ``sigmas`` standard errors for its length above the mean
of its language. Of languages with equal cross-entropy the first by name counts.

Scale: training moves counts of a bounded sample. Prediction is one map over
whole texts, with no shuffle; the model is some megabytes, bounded by the
sample and the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash as W
from .common import fresh_name, materialise

ORDER = 4
ROWS_PER_LANG = 2000
SLICE_CHARS = 1 << 17
_PAD = "\U0010ffff"
#: Names of characters: 0 for what is no letter, a letter of the sample its code point, padding and all other letters numbers that no letter has.
_PAD_CODE, _OTHER = 0x10FFFF, 0x10FFFE
_BITS = np.uint64(21)
_letters: list[np.ndarray] = []


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1. A null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes_of(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all characters, each text after ORDER - 1 paddings, and where each text begins; the total is last."""
    low = [_PAD * (ORDER - 1) + (t or "").lower() for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in low])))
    c = table[np.minimum(code, 0x10FFFF)]
    gap = c == 0
    keep = np.ones(len(c), bool)
    keep[1:] = ~(gap[1:] & (gap[:-1] | (c[:-1] == _PAD_CODE)))
    at = np.concatenate(([0], np.cumsum(keep)))
    return c[keep], at[begin]


def key_of(context: np.ndarray, last: np.ndarray, order: int) -> np.ndarray:
    """Up to three characters are packed, four are hashed."""
    return W.mix(W.mix(context) + last) if order == ORDER else (context << _BITS) | last


def grams_of(c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order from 1: (key, context) of the n-gram that ends at each character but the first ORDER - 1; paddings count as 0."""
    v = np.where(c == _PAD_CODE, 0, c).astype(np.uint64)
    n = max(0, len(v) - ORDER + 1)
    last, out, context = v[ORDER - 1 : ORDER - 1 + n], [], np.zeros(n, np.uint64)
    for k in range(1, ORDER + 1):
        if k > 1:  # one character more in front
            context = context | (v[ORDER - k : ORDER - k + n] << np.uint64(21 * (k - 2)))
        out.append((key_of(context, last, k), context))
    return out


def _table(alphabet: list[str]) -> np.ndarray:
    out = np.where(letter_table(), _OTHER, 0).astype(np.uint32)
    own = np.array([ord(x) for x in alphabet], np.int64)
    out[own] = own
    out[ord(_PAD)] = _PAD_CODE
    return out


@dataclass
class Model:
    """Sorted key arrays by order, log2 probabilities [key, language], and log2 back-off weights by context."""

    languages: list[str]
    alphabet: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    mean: np.ndarray
    sigma: np.ndarray
    slack: float = 2.0
    sigmas: float = 6.0

    def log_probs(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """log2 P(last character | those before) of each language, of n-grams as by ``grams_of``."""
        if not grams:
            raise ValueError("no n-grams")
        order, (key, ctx) = len(grams), grams[-1]
        known = self.keys[order]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        out = self.logp[order][at]
        miss = np.flatnonzero(known[at] != key)
        if len(miss):
            if order == 1:
                low = np.full((len(miss), len(self.languages)), -np.log2(len(self.alphabet) + 2), np.float32)
            else:
                low = self.log_probs([(k[miss], x[miss]) for k, x in grams[:-1]])
            ctx = ctx[miss]
            at = np.minimum(np.searchsorted(self.contexts[order], ctx), len(self.contexts[order]) - 1)
            out[miss] = low + np.where((self.contexts[order][at] == ctx)[:, None], self.back[order][at], 0)
        return out

    def cross_entropies(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per character [text, language], characters, letters."""
        c, begin = codes_of(texts, table)
        grams = grams_of(c)
        at = begin[:-1]  # the first key of a text ends at its first character, after the paddings
        n = begin[1:] - begin[:-1] - (ORDER - 1)
        bits = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts), np.int64)
        full = np.flatnonzero(n > 0)
        if len(full):
            scored = c[ORDER - 1 :] != _PAD_CODE
            logs = self.log_probs([(k[scored], x[scored]) for k, x in grams])
            before = np.concatenate(([0], np.cumsum(scored)))
            lo = before[at[full]]
            bits[full] = -np.add.reduceat(logs, lo, axis=0, dtype=np.float64) / n[full, None]
            is_letter = (c[ORDER - 1 :][scored] != 0).astype(np.int64)
            letters[full] = np.add.reduceat(is_letter, lo)
        return bits, n, letters

    def predict(self, texts: list[str | None], table: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected)."""
        bits, n, letters = self.cross_entropies(texts, table)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        # Posterior of the best under equal priors, with the evidence of 24 characters at most so that it keeps some range.
        score = 1 / np.exp2((low[:, None] - bits) * np.clip(n, 1, 24)[:, None]).sum(axis=1)
        none = letters == 0
        score[none] = 0
        limit = self.mean[best] + self.slack + self.sigmas * self.sigma[best] / np.sqrt(np.maximum(n, 1))
        return ["und" if x else self.languages[i] for i, x in zip(best, none, strict=True)], score, none | (low > limit)


def _fit_counts(counted: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], languages: list[str], n_alphabet: int) -> tuple[list, list, list, list]:
    """Interpolated Kneser-Ney from (context, last character, count) of the n-grams of the highest order."""
    per: dict[str, list] = {}
    for lang in languages:
        ctx, last, n = counted[lang]
        levels = [(ctx, last, n.astype(float))]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many characters come before
            ctx, last, _ = levels[-1]
            short = ctx & np.uint64((1 << 21 * (k - 1)) - 1)
            packed, n = np.unique((short << _BITS) | last, return_counts=True)
            levels.append((packed >> _BITS, packed & np.uint64((1 << 21) - 1), n.astype(float)))
        per[lang] = [None, *levels[::-1]]
    keys: list = [None]
    logp: list = [None]
    contexts: list = [None]
    back: list = [None]
    uniform = 1 / (n_alphabet + 2)
    for k in range(1, ORDER + 1):
        all_ctx, all_last = (np.concatenate([per[x][k][i] for x in languages]) for i in (0, 1))
        joint, at = np.unique(key_of(all_ctx, all_last, k), return_index=True)
        of_joint, last = all_ctx[at], all_last[at]
        if len(np.unique(np.stack([all_ctx, all_last]), axis=1).T) != len(joint):
            raise ValueError("two n-grams share a hash")
        ctx = np.unique(of_joint)
        p, b = np.zeros((len(joint), len(languages))), np.ones((len(ctx), len(languages)))
        if k > 1:
            at_low = np.searchsorted(keys[k - 1], key_of(of_joint & np.uint64((1 << 21 * (k - 2)) - 1), last, k - 1))
        at_ctx = np.searchsorted(ctx, of_joint)
        for j, lang in enumerate(languages):
            own_ctx, own_last, c = per[lang][k]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            of = np.searchsorted(ctx, own_ctx)
            total, kinds = np.bincount(of, c, len(ctx)), np.bincount(of, None, len(ctx))
            b[:, j] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1)
            low = uniform if k == 1 else np.exp2(logp[k - 1][at_low, j].astype(float))
            p[:, j] = b[at_ctx, j] * low
            p[np.searchsorted(joint, key_of(own_ctx, own_last, k)), j] += (c - d) / total[of]
        keys.append(joint)
        logp.append(np.log2(p).astype(np.float32))
        contexts.append(ctx)
        back.append(np.log2(b).astype(np.float32))
    return keys, logp, contexts, back


def _sample(labelled: DataFrame, rows_per_lang: int) -> DataFrame:
    """A share of each language's rows by a hash of the id, so that ``rows_per_lang`` are expected at most; none is dropped if there are fewer."""
    counts = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "lang-counts")
    at = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    # One row a language on the other side, written, so that its size is known before texts are moved.
    return labelled.withColumn("at", at).join(counts, "lang").filter(F.col("at") < F.lit(float(rows_per_lang)) / F.col("rows")).select(*labelled.columns)


def fit(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG, slack: float = 2.0, sigmas: float = 6.0) -> Model | None:
    """A model from (doc_id, text, lang) rows; rows without language or letters teach nothing. None if nothing is left."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    if rows.isEmpty():
        return None
    sample = materialise(_sample(rows, rows_per_lang).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5))), "lang-sample")
    chars = sample.select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c")).groupBy("c").count()
    # As many rows as Unicode has letters at most.
    alphabet = sorted(r["c"] for r in chars.select("c").collect() if len(r["c"]) == 1 and r["c"].isalpha())
    if not alphabet:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(alphabet)
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                c, _ = codes_of([t for t, x in zip(texts, langs, strict=True) if x == lang], table)
                key, ctx = grams_of(c)[-1]
                real = np.flatnonzero(c[ORDER - 1 :] != _PAD_CODE)
                _, at, n = np.unique(key[real], return_index=True, return_counts=True)
                seen = ctx[real[at]], c[ORDER - 1 :][real[at]].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(seen[0].view(np.int64)), pa.array(seen[1].view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "ctx", "last", "n"])

    # A table of the sample's n-grams: bounded by the sample, whatever the corpus.
    taught = sample.filter("part > 0").union(sample.join(sample.filter("part > 0").select("lang").distinct(), "lang", "left_anti").select(*sample.columns))
    counts = taught.select("lang", "text").mapInArrow(count, "lang string, ctx long, last long, n long").groupBy("lang", "ctx", "last").agg(F.sum("n").alias("n"))
    got = counts.orderBy("lang", "ctx", "last").toPandas()
    languages = sorted(got["lang"].unique())
    by = {x: (g["ctx"].to_numpy().astype(np.uint64), g["last"].to_numpy().astype(np.uint64), g["n"].to_numpy()) for x, g in got.groupby("lang")}
    model = Model(languages, alphabet, *_fit_counts(by, languages, len(alphabet)), np.zeros(len(languages)), np.zeros(len(languages)), slack, sigmas)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(alphabet)
        for b in batches:
            langs = b.column(0).to_pylist()
            bits, n, letters = model.cross_entropies(b.column(1).to_pylist(), table)
            ok = [i for i, x in enumerate(langs) if letters[i] > 0 and x in languages]
            own = [float(bits[i, languages.index(langs[i])]) for i in ok]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in ok], pa.string()), pa.array(own, pa.float64()), pa.array([int(n[i]) for i in ok], pa.int64())], names=["lang", "bits", "n"])

    # Weighted by length; the spread of a character from the spread of texts.
    seen = sample.filter("part = 0").select("lang", "text").mapInArrow(measure, "lang string, bits double, n long")
    seen = seen.withColumn("mean", F.expr("sum(bits * n) over (partition by lang) / sum(n) over (partition by lang)"))
    for r in seen.groupBy("lang").agg(F.first("mean").alias("mean"), F.sqrt(F.avg(F.pow(F.col("bits") - F.col("mean"), 2) * F.col("n"))).alias("sigma")).collect():
        j = languages.index(r["lang"])
        model.mean[j], model.sigma[j] = r["mean"], r["sigma"]
    for j in np.flatnonzero(model.mean == 0):  # nothing to calibrate with: nothing is rejected
        model.mean[j] = np.inf
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with lang_pred, score and rejected; the second value gives the names of these columns.

    Without a model, or for a null text or one without letters: 'und', 0.0, rejected.
    Repeated rows get the same answer each; whole texts are read, in slices of
    rows of about ``SLICE_CHARS`` characters, a longer text alone.
    """
    names = {x: fresh_name(docs, x) for x in ("lang_pred", "score", "rejected")}
    if model is None:
        return docs.select("*", F.lit("und").alias(names["lang_pred"]), F.lit(0.0).alias(names["score"]), F.lit(True).alias(names["rejected"])), names
    schema = T.StructType([*docs.schema.fields, T.StructField(names["lang_pred"], T.StringType()), T.StructField(names["score"], T.DoubleType()), T.StructField(names["rejected"], T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        table = _table(known.alphabet)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            langs: list[str] = []
            scores, rejected = [], []
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= SLICE_CHARS):
                    size += len(texts[hi] or "")
                    hi += 1
                x = known.predict(texts[lo:hi], table)
                langs += x[0]
                scores.append(x[1])
                rejected.append(x[2])
                lo = hi
            new = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(rejected) if rejected else [], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), *new], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema), names


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> tuple[DataFrame, dict[str, str]]:
    """Fit on the rows that aren't held out, predict every row."""
    taught = docs.filter(~held_out(F.col(id_col))).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(docs, fit(taught, **kw), text_col)


def drop_rejected(docs: DataFrame, **kw) -> DataFrame:
    out, names = identify(docs, **kw)
    return out.filter(~F.col(names["rejected"])).select(*docs.columns)
