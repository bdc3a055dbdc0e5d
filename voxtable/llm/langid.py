"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased, everything that is no letter becomes one space, and each character is predicted from the three
before it. Per language, four-gram counts are summed by Spark over the training documents; continuation counts, discounts
and interpolation weights follow from the distinct four-grams. All languages share sorted hash arrays, so one look-up
of a four-gram gives its log probability in every language, and only unseen ones go to lower orders. The language with
the least cross-entropy per character wins, ties to the first name. A document is rejected if its cross-entropy lies
above a limit of that language and its class of length, a power of two.

The model is fitted on at most about ``train_rows`` documents per language, taken by hash when there are more, which
bounds its size; every document is scored whole. The limits come from all labelled documents that were not counted, a
fifth of a language being held back: the language's median cross-entropy and, per class, the ``HIGH`` quantile of the
surplus over it, so single unlike documents do not move them. Classes with fewer than ``LEAST`` such documents borrow
from the next shorter class, else from the next longer one. A language with fewer has no part held back and goes by the
widest limit of the others; without others, by that of a uniform draw over all letters. Null texts and texts without a letter
are ``und`` with score 0 and are rejected; so is everything when there is nothing to learn from. Repeated rows are scored one by
one, very long texts whole. The added column of ``keep_identified`` starts with two underscores and a random word, so other columns
may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import bounded, hash_rest, stored

ORDER = 4
TRAIN_ROWS = 3000
SLACK = 1.25                 # of the calibrated limits
HOLD = 5                     # one in so many labelled documents is not counted
LEAST, HIGH = 20, 0.95       # documents that make a limit, and their quantile that does
CLASSES = 32                 # of length, by powers of two
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, and 32 for everything else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normal_codes(texts) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, ends)``: per text three spaces, then letters with single spaces between words, then a space."""
    raw = [("   " + (t or "") + " ").encode("utf-32-le", "surrogatepass") for t in texts]
    codes = _letters()[np.frombuffer(b"".join(raw), np.uint32)]
    ends = np.cumsum([len(r) // 4 for r in raw]) if raw else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    for k in range(3):
        keep[starts + k] = True
    lead = starts + 3                              # a text that starts with a space needs no fourth one
    keep[lead] = codes[lead] != 32
    total = np.cumsum(keep)
    return codes[keep], (total[ends - 1] if len(ends) else ends)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ (h >> np.uint64(29))) * _M


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of grams given as one array of code points per place."""
    h = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h + p.astype(np.uint64) + np.uint64(1)) * _P
    return mixed(h)


class HashTable:
    """Sorted 64-bit keys with a directory of their leading bits; values by row."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, min(22, int(len(keys)).bit_length() + 1)))
        slots = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.float64)
        self.first = np.searchsorted((self.keys >> self.shift).astype(np.float64), slots).astype(np.int32)
        self.widest = int(np.diff(self.first).max(initial=0))

    def rows(self, h: np.ndarray) -> np.ndarray:
        """Row of every key, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        found = np.full(len(h), -1, np.int32)
        open_ = np.flatnonzero(at < stop)
        for step in range(self.widest):
            here = at[open_] + step
            hit = self.keys[here] == h[open_]
            found[open_[hit]] = here[hit]
            open_ = open_[~hit & (here + 1 < stop[open_])]
            if not len(open_):
                break
        return found


class Model:
    """Interpolated Kneser-Ney tables of all languages."""

    def __init__(self, langs: list[str], grams: np.ndarray, lang: np.ndarray, count: np.ndarray):
        """``grams``: code points of distinct four-grams, one row per (gram, language)."""
        self.langs = langs
        self.limits = None
        n = len(langs)
        self.size = max(1, len(np.unique(grams[:, -1]))) if len(grams) else 1
        tables = []
        level, owner, weight = grams, lang, count.astype(float)
        for order in range(ORDER, 0, -1):
            tables.append((level, owner, weight))
            # Types of this order are the continuation counts of the next lower one.
            if order > 1:
                keyed = np.column_stack([owner, level[:, 1:]])
                types, inverse = np.unique(keyed, axis=0, return_inverse=True)
                level, owner = types[:, 1:], types[:, 0]
                weight = np.bincount(inverse.ravel(), minlength=len(types)).astype(float)
        self.grams, self.backs = {}, {}
        self.floor = np.log(np.full(n, 1.0 / (self.size + 1)))
        for order, (level, owner, weight) in zip(range(1, ORDER + 1), reversed(tables)):
            self._add(order, level, owner, weight, n)

    def _add(self, order, level, owner, weight, n):
        ones = np.bincount(owner[weight == 1], minlength=n)
        twos = np.bincount(owner[weight == 2], minlength=n)
        discount = np.where(ones > 0, ones / np.maximum(1, ones + 2.0 * twos), 0.5)
        discount = np.clip(discount, 0.1, 0.95)
        contexts, place = np.unique(level[:, :-1], axis=0, return_inverse=True)
        place = place.ravel()
        total = np.zeros((len(contexts), n))
        types = np.zeros((len(contexts), n))
        np.add.at(total, (place, owner), weight)
        np.add.at(types, (place, owner), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, discount * types / total, 1.0)
        distinct, where = np.unique(level, axis=0, return_inverse=True)
        where = where.ravel()
        own = np.zeros((len(distinct), n))
        own[where, owner] = np.maximum(weight - discount[owner], 0) / total[place, owner]
        context_of = np.zeros(len(distinct), np.int64)
        context_of[where] = place
        lower = np.exp(self._logs(order - 1, [distinct[:, i] for i in range(1, order)]))
        probs = own + back[context_of] * lower
        self.grams[order] = HashTable(gram_hash([distinct[:, i] for i in range(order)]), np.log(probs))
        self.backs[order] = HashTable(gram_hash([contexts[:, i] for i in range(order - 1)]) if order > 1
                                      else np.zeros(len(contexts), np.uint64), np.log(back))

    def _logs(self, order: int, parts: list[np.ndarray]) -> np.ndarray:
        """Log probability of the last character given the others, one column per language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(parts[0]) if parts else 1, len(self.langs))).astype(np.float32)
        rows = self.grams[order].rows(gram_hash(parts))
        out = self.grams[order].values[rows]
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            less = [p[miss] for p in parts]
            back = self.backs[order]
            seen = back.rows(gram_hash(less[:-1]) if order > 1 else np.zeros(len(miss), np.uint64))
            weight = np.where(seen[:, None] >= 0, back.values[seen], np.float32(0))
            lower = self._logs(order - 1, less[1:]) if order > 1 else self.floor.astype(np.float32)[None, :]
            out[miss] = weight + lower
        return out

    def cross_entropies(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(per text and language: nats per character, characters, whether it has a letter)``."""
        codes, ends = normal_codes(texts)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sums = np.zeros((len(ends), len(self.langs)))
        doc = np.repeat(np.arange(len(ends)), ends - starts)
        inside = np.arange(len(codes)) - starts[doc] >= 3
        step = max(1 << 14, (1 << 20) // max(1, len(self.langs)))
        for a in range(3, len(codes), step):
            z = min(len(codes), a + step)
            at = np.flatnonzero(inside[a:z]) + a
            logs = self._logs(ORDER, [codes[at - 3], codes[at - 2], codes[at - 1], codes[at]])
            own = doc[at]
            if len(own):
                for j in range(len(self.langs)):
                    lo = own[0]
                    got = np.bincount(own - lo, weights=logs[:, j])
                    sums[lo:lo + len(got), j] += got
        n = np.maximum(ends - starts - 3, 1)
        letters = np.bincount(doc[codes != 32], minlength=len(ends)) > 0
        return -sums / n[:, None], n, letters

    def highest(self, n: np.ndarray) -> np.ndarray:
        """Cross-entropy above which a text of ``n`` characters is rejected, one column per language."""
        middle, spread, most = self.limits
        kind = length_class(n)
        out = middle + spread[:, kind].T / np.sqrt(np.minimum(n[:, None], most[:, kind].T))
        known = ~np.isnan(middle)
        widest = out[:, known].max(axis=1) if known.any() else np.full(len(n), np.log(self.size + 1.0) / SLACK)
        return SLACK * np.where(known, out, widest[:, None])

    def identify(self, texts) -> pd.DataFrame:
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "cross_entropy": np.nan,
                                 "rejected": True})
        ce, n, letters = self.cross_entropies(texts)
        best = ce.argmin(axis=1)
        least = ce[np.arange(len(ce)), best]
        score = 1 / np.exp(np.clip((least[:, None] - ce) * np.sqrt(n)[:, None], -700, 0)).sum(axis=1)
        rejected = ~letters
        if self.limits is not None:
            rejected = rejected | (least > self.highest(n)[np.arange(len(n)), best])
        names = np.array([*self.langs, "und"], object)
        return pd.DataFrame({"lang_pred": names[np.where(letters, best, len(self.langs))],
                             "score": np.where(letters, score, 0.0), "cross_entropy": least, "rejected": rejected})


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n)[1] - 1, CLASSES - 1)


def _training_rows(docs: DataFrame, train_rows: int) -> DataFrame:
    """All rows with ``learn``: whether they are counted, at most about ``train_rows`` documents per language by hash."""
    fold = F.pmod(F.xxhash64(F.lit("langid-limit"), "doc_id", "text"), F.lit(HOLD)) == 0
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.count_if(fold).alias("_f"))
    counts = stored(counts, "langid-counts")       # of known size, so that few languages move no texts
    held = (F.col("_f") >= LEAST) & (2 * F.col("_f") <= F.col("_n"))
    share = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rest = F.col("_n") - F.when(held, F.col("_f")).otherwise(0)
    return docs.join(counts, "lang").withColumn(
        "learn", ~(held & fold) & (share * rest < train_rows))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model from ``docs(doc_id, text, lang)``; rows without text or language are not learned from."""
    docs = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    rows = _training_rows(docs, train_rows)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = [t for t, own in zip(b.column("text").to_pylist(), langs) if own == lang]
                codes, ends = normal_codes(texts)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                inside = np.ones(len(codes), bool)
                for k in range(3):
                    inside[starts + k] = False
                at = np.flatnonzero(inside)
                places = [codes[at - 3 + k] for k in range(ORDER)]
                _, first, n = np.unique(gram_hash(places), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(first)), *[pa.array(p[first].astype(np.int32)) for p in places],
                     pa.array(n.astype(np.int64))], names=["lang", "a", "b", "c", "d", "n"])

    found = (rows.filter("learn").select("text", "lang").mapInArrow(grams, "lang string, a int, b int, c int, d int, n long")
             .groupBy("lang", "a", "b", "c", "d").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(found["lang"].unique())
    model = Model(langs, found[["a", "b", "c", "d"]].to_numpy(np.int64).reshape(-1, ORDER),
                  np.searchsorted(np.array(langs, object), found["lang"].to_numpy(object)) if langs
                  else np.zeros(0, np.int64), found["n"].to_numpy(np.int64)) if langs else Model.__new__(Model)
    if not langs:
        model.langs, model.limits = [], None
        return model
    return calibrated(model, rows.filter("not learn"))


def calibrated(model: Model, labelled: DataFrame) -> Model:
    """Set the rejection limits from the cross-entropies of documents that were not counted in their own language."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    names = {lang: i for i, lang in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            ce, n, letters = shared.value.cross_entropies(b.column("text").to_pylist())
            own = np.array([names.get(x, -1) for x in b.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array(ce[np.arange(len(ce)), own]), pa.array(n.astype(float)),
                 pa.array(length_class(n).astype(np.int32)), pa.array(letters & (own >= 0))],
                names=["lang", "ce", "n", "kind", "ok"])

    seen = stored(labelled.select("text", "lang").mapInArrow(run, "lang int, ce double, n double, kind int, ok boolean")
                  .filter("ok"), "calibration")
    middles = seen.groupBy("lang").agg(F.percentile_approx("ce", 0.5).alias("middle"), F.count(F.lit(1)).alias("all"),
                                       F.percentile_approx("kind", 0.5).alias("usual"))
    over = F.percentile_approx((F.col("ce") - F.col("middle")) * F.sqrt("n"), HIGH).alias("spread")
    marked = seen.join(middles.filter(F.col("all") >= LEAST), "lang")
    middle = np.full(len(model.langs), np.nan)
    spread = np.full((len(model.langs), CLASSES), np.nan)
    most = np.full((len(model.langs), CLASSES), np.inf)
    for r in marked.groupBy("lang", "kind").agg(over, F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LEAST).collect():
        spread[r["lang"], r["kind"]] = max(0.0, r["spread"])
    for r in marked.groupBy("lang").agg(over, F.first("middle").alias("middle"), F.first("usual").alias("usual")).collect():
        own = spread[r["lang"]]
        middle[r["lang"]] = r["middle"]
        if np.isnan(own).all():
            own[r["usual"]] = max(0.0, r["spread"])
        full = np.flatnonzero(~np.isnan(own))
        for k in np.flatnonzero(np.isnan(own)):
            shorter = full[full < k]
            if len(shorter):                           # no narrower than at the longest text of that class
                own[k], most[r["lang"], k] = own[shorter[-1]], 2.0 ** (shorter[-1] + 1)
            else:
                own[k] = own[full[0]]
    model.limits = middle, spread, most
    return model


def identified(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct column ``lang_pred, score, cross_entropy, rejected`` of a text column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size > 2 << 20:
                    parts.append(shared.value.identify(part))
                    part, size = [], 0
            if part:
                parts.append(shared.value.identify(part))
            yield pd.concat(parts, ignore_index=True)

    return run(F.col(text))


def language_report(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, rejected``; held-out rows are not learned from."""
    held_out = hash_rest("doc_id", 5) == 0
    model = train(docs.filter(~held_out), train_rows)
    rows = docs.select("doc_id", "text").withColumn("r", identified(docs, model))
    return rows.select("doc_id", held_out.alias("held_out"), "r.*")


def keep_identified(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are not rejected; columns as given."""
    model = train(docs, train_rows)
    name = f"__lang_{uuid.uuid4().hex[:8]}"
    return (docs.withColumn(name, identified(docs, model)).filter(~F.col(f"{name}.rejected"))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
