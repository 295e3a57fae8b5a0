"""Same or near-same records across splits.

Method: a text is a unit vector over shingles of five words, weighted by rarity and
damped frequency.  A weighted cosine join between the splits finds all pairs of cosine
0.8 or more.  One global order of terms, rarest first and then by hash, holds for all
vectors; each enters the inverted lists with its first terms in that order until the
norm of what is left is INDEX_SLACK below the threshold.  A pair's products over shared
listed terms are summed.  Of two vectors the one whose list ends first in the global
order has all other shared terms in its rest, so these add at most its residual norm and
at most l1(rest) times the other's maximum weight; the larger of both sides' bounds is
taken.  Pairs whose bound stays below the threshold are pruned, the others get exact dot
products.

Rarity comes from document counts of all texts in a table of 2^24 hash cells, one byte
each once turned into weights: 16 MB whatever the corpus.  A term's weight is a function
of its cell, so cosines are exact for these weights, and standard clauses weigh little
at any scale.  The table also tells which listed terms are hot: their lists are split by
salt on one side.  Texts are read once, their terms are kept.  Texts equal after
normalisation are one vector; copies are expanded only in the end, and only counted in
the report.

Results by case: null and blank texts, null splits and other splits take no part; texts
under five words are one shingle; copies within a split are no pair; ties in rarity are
ordered by term; a document is paired with every partner, without a cap; texts are
compared whole at any length.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPLITS, split_name
from docloom.session import written

WORDS = 5
SIMILARITY = 0.8
INDEX_SLACK = 0.1
CELL_BITS = 24
CELLS = 1 << CELL_BITS
BLOCK = 1 << 16
#: Weights are stored in steps of 1/WEIGHT_STEPS.
WEIGHT_STEPS = 8
#: Up to so many ids are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: A listed term of more texts than this is split into lists of about so many, at most MOST_SALTS.
HOT_TEXTS, MOST_SALTS = 20_000, 256

HYPHEN = re.compile(r"[-‐¬­]\s*\n\s*")
INVISIBLE = re.compile("[­​-‍⁠﻿]+")
NO_WORD = re.compile(r"[\W_]+")
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


# Korean vowel pairs across a silent initial and the vowel they contract to (하여/해, 되어/돼, 보아/봐, 주어/줘, 지어/져).
CONTRACTED = {"ㅏㅕ": "ㅐ", "ㅚㅓ": "ㅙ", "ㅗㅏ": "ㅘ", "ㅜㅓ": "ㅝ", "ㅣㅓ": "ㅕ"}
_VOWELS = {v: chr(0x1161 + i) for i, v in enumerate("ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ")}
CONTRACTION = {_VOWELS[k[0]] + "\u110b" + _VOWELS[k[1]]: _VOWELS[v] for k, v in CONTRACTED.items()}
PAIR = re.compile("|".join(CONTRACTION))


def word_of(token: str) -> str:
    """A token's letters and digits in lower case; full and contracted Korean forms are one."""
    word = NO_WORD.sub("", token).lower()
    return word if word.isascii() else PAIR.sub(lambda m: CONTRACTION[m[0]], unicodedata.normalize("NFD", word))


class _Hashes(dict):
    """Hash of a token's word; 0 for tokens without letters or digits."""

    def __missing__(self, token):
        if len(self) > 1_000_000:
            self.clear()
        word = word_of(token)
        h = self[token] = xxhash.xxh64_intdigest(word) or 1 if word else 0
        return h


_hash = _Hashes()


def hashes_of(text: str) -> np.ndarray:
    """Hashes of the words, without differences of character form, layout and scan marks."""
    text = HYPHEN.sub("", text)
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = INVISIBLE.sub("", text)
    h = np.array(list(map(_hash.__getitem__, text.split())), dtype=np.uint64)
    return h[h != 0]


def terms_of(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(fingerprint of all words, distinct 64-bit terms in ascending order, how often each occurs)."""
    h = hashes_of(text)
    fingerprint = xxhash.xxh64_intdigest(h.tobytes()) & ~1
    if len(h) < WORDS:
        terms = np.array([fingerprint], dtype=np.uint64) if len(h) else np.array([], dtype=np.uint64)
    else:
        n = len(h) - WORDS + 1
        terms = np.zeros(n, dtype=np.uint64)
        for i in range(WORDS):
            terms += h[i : i + n] * MULTIPLIERS[i]
        terms ^= terms >> np.uint64(31)
        terms *= np.uint64(0xBF58476D1CE4E5B9)
        terms ^= terms >> np.uint64(29)
    terms, times = np.unique(terms, return_counts=True)
    return fingerprint, terms, times


def _cells(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


SURVEY = "doc_id long, split string, source string, fp long, terms binary, times binary, block int, cells binary, counts binary"


def _survey(batches):
    """Rows of documents (doc_id, split, source, fingerprint, terms, repeats) and, at a task's end, its cell counts in blocks of sparse pairs."""
    counts = np.zeros(CELLS, dtype=np.int32)
    for pdf in batches:
        found = [terms_of(text) for text in pdf["text"]]
        if found:
            np.add.at(counts, np.concatenate([np.unique(_cells(t)) for _, t, _ in found]), 1)
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"], "split": pdf["split"], "source": pdf["source"], "fp": _signed(np.array([p for p, _, _ in found], dtype=np.uint64)),
            "terms": [t.tobytes() for _, t, _ in found], "times": [None if (k == 1).all() else k.astype(np.int32).tobytes() for _, _, k in found], "block": None, "cells": None, "counts": None})
    for b in range(CELLS // BLOCK):
        part = counts[b * BLOCK : (b + 1) * BLOCK]
        at = np.flatnonzero(part)
        if len(at):
            empty = {c: [None] for c in ("doc_id", "split", "source", "fp", "terms", "times")}
            yield pd.DataFrame({**empty, "block": [b], "cells": [at.astype(np.uint16).tobytes()], "counts": [part[at].tobytes()]})


def _stored(terms: bytes, times: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    t = np.frombuffer(terms, dtype=np.uint64)
    return t, np.ones(len(t)) if times is None else np.frombuffer(times, dtype=np.int32)


def _weigh_blocks(n_texts):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, dtype=np.int64)
        for cells, counts in zip(pdf["cells"], pdf["counts"]):
            total[np.frombuffer(cells, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.int32)
        weights = np.clip(np.round(np.log1p(n_texts / np.maximum(1, total)) * WEIGHT_STEPS), 1, 255).astype(np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "weights": [weights.tobytes()]})

    return run


def vector(terms: np.ndarray, times: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Unit vector of rarity times damped frequency."""
    w = weight[_cells(terms)] * (1.0 + np.log(times))
    return w / np.sqrt(np.dot(w, w))


def global_order(terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the terms, rarest first, then by hash: the same order in every text, whatever repeats in it."""
    return np.lexsort((terms, -weight[_cells(terms)].astype(np.int16)))


def prefix_length(weights: np.ndarray, below: float) -> int:
    """How many of the ordered weights must be listed so that the norm of the rest is under `below`."""
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.cumsum(weights * weights)))
    rest[-1] = 0.0
    return int(np.argmax(rest < below)) + 1


#: A posting's weight, the rest's norm and l1 norm and the vector's maximum weight, 16 bits each, rounded up; an l1 norm of L1_OPEN or more is no bound.
UNIT, L1_UNIT, L1_OPEN = 65_535, 256, 65_535


def packed(w: np.ndarray, rest: float, rest_l1: float, peak: float) -> np.ndarray:
    up = lambda x, unit: np.minimum(np.ceil(np.asarray(x) * unit + 1e-6), 65_535).astype(np.uint64)
    return (up(w, UNIT) << np.uint64(48)) | (up(rest, UNIT) << np.uint64(32)) | (up(rest_l1, L1_UNIT) << np.uint64(16)) | up(peak, UNIT)


def listed(terms: np.ndarray, times: np.ndarray, weight: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(listed terms, packs) of a vector."""
    w = vector(terms, times, weight)
    order = global_order(terms, weight)
    w = w[order]
    k = prefix_length(w, similarity - INDEX_SLACK)
    tail = w[k:]
    return terms[order[:k]], packed(w[:k], float(np.sqrt(np.dot(tail, tail))), float(tail.sum()), float(w.max()))


def salts_of(terms: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """Into how many lists a term's postings are split, from the number of texts its cell's weight stands for."""
    texts = n_texts / np.expm1(weight[_cells(terms)] / WEIGHT_STEPS)
    return np.clip(np.ceil(texts / HOT_TEXTS), 1, MOST_SALTS).astype(np.int64)


POSTINGS = "term long, salt int, owner long, pack long"


def _postings(table, n_texts, similarity, spread):
    """Postings; where spread, a hot term's posting goes to the list that its owner's hash names, else to all of the term's lists."""

    def run(batches):
        weight = np.frombuffer(table.value, dtype=np.uint8)
        for pdf in batches:
            out = []
            for fp, stored, times in zip(pdf["fp"], pdf["terms"], pdf["times"]):
                if not len(stored):
                    continue
                terms, packs = listed(*_stored(stored, times), weight, similarity)
                salts, owner = salts_of(terms, weight, n_texts), np.int64(fp)
                if spread:
                    salt = (np.uint64(owner.view(np.uint64)) >> np.uint64(8)).astype(np.int64) % salts
                else:
                    terms, packs = np.repeat(terms, salts), np.repeat(packs, salts)
                    salt = np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
                out.append((terms, salt, np.full(len(terms), owner), packs))
            if out:
                terms, salt, owner, packs = map(np.concatenate, zip(*out))
                yield pd.DataFrame({"term": _signed(terms), "salt": salt.astype(np.int32), "owner": owner, "pack": _signed(packs)})

    return run


def _dots(table):
    def run(batches):
        weight = np.frombuffer(table.value, dtype=np.uint8)
        for pdf in batches:
            out = np.zeros(len(pdf))
            for i, (ta, ka, tb, kb) in enumerate(zip(pdf["ta"], pdf["ka"], pdf["tb"], pdf["kb"])):
                (a, na), (b, nb) = _stored(ta, ka), _stored(tb, kb)
                _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                out[i] = np.dot(vector(a, na, weight)[x], vector(b, nb, weight)[y])
            yield pd.DataFrame({"fa": pdf["fa"], "fb": pdf["fb"], "cosine": out})

    return run


def bounded(met: DataFrame, similarity: float) -> DataFrame:
    """met(fa, fb, xa, xb), a row per shared listed term -> (fa, fb) whose bound reaches the similarity."""
    part = lambda x, shift: f"(shiftright({x}, {shift}) & 65535L)"
    sums = met.groupBy("fa", "fb").agg(
        F.expr(f"sum({part('xa', 48)} * {part('xb', 48)})").alias("dot"),
        *[F.expr(f"max({part('x' + side, shift)})").alias(name + side) for side in "ab" for name, shift in (("rest_", 32), ("l1_", 16), ("peak_", 0))])

    def rest(mine, other):
        norm = F.col("rest_" + mine) / UNIT
        return F.when(F.col("l1_" + mine) >= L1_OPEN, norm).otherwise(F.least(norm, F.col("l1_" + mine) / L1_UNIT * F.col("peak_" + other) / UNIT))

    return sums.where(F.col("dot") / (UNIT * UNIT) + F.greatest(rest("a", "b"), rest("b", "a")) >= similarity).select("fa", "fb")


def similar_texts(documents: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id, split, source, fp of every text taking part; fa (DEV), fb (evaluation), cosine of similar texts."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text", "source", split_name(F.col("split")).alias("split")).where(F.col("split").isin(*SPLITS) & (F.length(F.trim("text")) > 0))
    surveyed = written(texts.mapInPandas(_survey, SURVEY), "survey")
    kept = surveyed.where("block is null").withColumn("dev", F.col("split") == SPLITS[0])
    members = kept.select("doc_id", "split", "source", "fp")
    n = max(1, members.count())
    blocks = surveyed.where("block is not null").select("block", "cells", "counts").groupBy("block").applyInPandas(_weigh_blocks(n), "block int, weights binary")
    weights = np.full(CELLS, 255, dtype=np.uint8)
    for r in blocks.toLocalIterator():  # 256 blocks of 64 KB at most
        weights[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["weights"], dtype=np.uint8)
    table = spark.sparkContext.broadcast(weights.tobytes())  # 16 MB

    # Copies within a side are listed once.
    first = kept.groupBy("fp", "dev").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = written(kept.select("doc_id", "fp", "dev").join(first, ["fp", "dev"]).where("doc_id <> first").select("doc_id"), "copies")
    few = copies.count() <= BROADCAST_IDS
    single = kept.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti").select("fp", "dev", "terms", "times")
    a = single.where("dev").select("fp", "terms", "times").mapInPandas(_postings(table, n, similarity, True), POSTINGS).select("term", "salt", F.col("owner").alias("fa"), F.col("pack").alias("xa"))
    b = single.where("not dev").select("fp", "terms", "times").mapInPandas(_postings(table, n, similarity, False), POSTINGS).select("term", "salt", F.col("owner").alias("fb"), F.col("pack").alias("xb"))
    pairs = written(bounded(a.join(b, ["term", "salt"]).where("fa <> fb"), similarity), "candidates")
    va = single.where("dev").select(F.col("fp").alias("fa"), F.col("terms").alias("ta"), F.col("times").alias("ka"))
    vb = single.where("not dev").select(F.col("fp").alias("fb"), F.col("terms").alias("tb"), F.col("times").alias("kb"))
    light = pairs.count() <= BROADCAST_IDS  # then only the vectors asked for are shuffled
    if light:
        va = va.join(F.broadcast(pairs.select("fa").distinct()), "fa", "left_semi")
        vb = vb.join(F.broadcast(pairs.select("fb").distinct()), "fb", "left_semi")
    exact = pairs.join(va, "fa").join(vb, "fb").mapInPandas(_dots(table), "fa long, fb long, cosine double").where(F.col("cosine") >= similarity)
    return members, exact


def overlaps(documents: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links): fa (DEV), fb (evaluation), cosine of texts that are the same or similar, copies not expanded."""
    members, exact = similar_texts(documents, similarity)
    sides = members.groupBy("fp").agg(F.max((F.col("split") == SPLITS[0]).cast("int")).alias("dev"), F.max((F.col("split") != SPLITS[0]).cast("int")).alias("other"))
    same = sides.where("dev = 1 and other = 1").select(F.col("fp").alias("fa"), F.col("fp").alias("fb"), F.lit(1.0).alias("cosine"))
    return members, written(exact.unionByName(same), "links")


def cross_split_pairs(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id_a, doc_id_b, dev_id, other_id, split, source, cosine) of all overlaps; split and source are the evaluation record's."""
    members, links = overlaps(documents, similarity)
    dev = members.where(F.col("split") == SPLITS[0]).select(F.col("doc_id").alias("dev_id"), F.col("fp").alias("fa"))
    other = members.where(F.col("split") != SPLITS[0]).select(F.col("doc_id").alias("other_id"), "split", "source", F.col("fp").alias("fb"))
    out = links.join(other, "fb").join(dev, "fa")
    return out.select(F.least("dev_id", "other_id").alias("doc_id_a"), F.greatest("dev_id", "other_id").alias("doc_id_b"), "dev_id", "other_id", "split", "source", "cosine")


def found(documents: DataFrame) -> DataFrame:
    return cross_split_pairs(documents).select("doc_id_a", "doc_id_b")


def report(documents: DataFrame) -> DataFrame:
    """Overlaps per evaluation split and source of the evaluation record, counted by classes of equal texts."""
    members, links = overlaps(documents)
    dev = members.where(F.col("split") == SPLITS[0]).groupBy(F.col("fp").alias("fa")).agg(F.count("*").alias("n_dev"))
    other = members.where(F.col("split") != SPLITS[0]).groupBy("split", "source", F.col("fp").alias("fb")).agg(F.count("*").alias("n_other"))
    met = written(links.join(other, "fb").join(dev, "fa"), "classes")
    key = lambda side, n, name: met.groupBy("split", "source", side).agg(F.max(n).alias("k")).groupBy("split", "source").agg(F.sum("k").alias(name))
    counts = met.groupBy("split", "source").agg(F.sum(F.col("n_dev") * F.col("n_other")).alias("n_pairs"))
    for extra in (key("fb", "n_other", "n_evaluation_docs"), key("fa", "n_dev", "n_dev_docs")):
        extra = extra.withColumnsRenamed({"split": "_split", "source": "_source"})
        counts = counts.join(extra, (F.col("split") == F.col("_split")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_split", "_source")
    return counts
