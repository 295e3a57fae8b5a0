"""Text cut off by field limits or in transfer.

Method: for every source a right-censored log-normal length distribution is fitted by
maximum likelihood, over characters and over bytes; lengths with far more values than
the fit explains are candidate limits, and a value there gets the posterior probability
of being censored.  It is combined with evidence from the ending: how often the last
word ends a paragraph of its kind against how often it stands inside one (counted over
all texts), marks left behind by a cut, and closing punctuation.

Results by case: null and blank texts are no case; a text that ends with a list item,
table row, date line, note, heading or a sentence without full stop is complete; page
furniture at the end is looked past; a null source is a source of its own; repeated
rows are judged alike; very long texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import written

SALTS = 8
#: A short line is a heading if it is a whole paragraph in this share of texts, and 3 times at least.
HEADING_SHARE = 3e-4
#: Log-odds from which a text counts as cut.
CUT_AT = 0.8

CLOSED = re.compile(r"[.!?。]['\"”’)\]]*$|[)\]][.]?$")
#: What a cut leaves behind: ellipses, broken or whole entities and tags, replacement characters.
MARK = re.compile(r"(?:\.{3,}|\\u[0-9a-f]{0,4}|\\x[0-9a-f]{0,2}|…|�+|&[a-z]{1,7};?|&#x?[0-9a-f]{0,6};?|<[a-z/!][^<>]*>?|&|<|\[\s*(?:\.\.\.|…)\s*\]|(?:더\s*보기|read\s+more|continued))\s*$", re.I)
NUMBER_POINT = re.compile(r"(?:^|[\s(])\d[\d.,]*\.$")
DATE = r"[\dOlISB]{4}\s*[-./년]\s*[\dOlISB]{1,2}\s*[-./월]\s*[\dOlISB]{1,2}\s*[.일]?"
DATE_LINE = re.compile(rf"^\W*{DATE}(?:\s+\S+)?$")
#: English date lines: 12 October 2026, then at most three words.
DATE_LINE_EN = re.compile(r"^\W*\d{1,2}\s+[A-Z][a-z]+\s+\d{4}(?:,?\s+\S+){0,3}$")
DATE_AT_END = re.compile(rf"[.다함임것음]\s+{DATE}\s+\S+장$")
LIST = re.compile(r"^\s*(?:[-–·•*▪◦○●□■◇◆ㅇ※]|[가-하]\.|\d{1,2}[.)]|\(\d{1,2}\)|[①-⑳])\s+\S")
PAGE = re.compile(r"^\W*(?:p(?:age|\.)?\s*)?(?:제\s*)?[\dlIOSB]{1,4}(?:\s*/\s*[\dlIOSB]{1,4})?\s*(?:쪽|페이지|면|page)?\W*$", re.I)
PAGE_IN_LINE = re.compile(r"\s[-–]?\s*\d{1,4}\s*[-–]?$")
NOTE = re.compile(r"^\W*(?:붙임|별첨|첨부|attachments?|enclosures?|note)\b", re.I)
DIGITS = re.compile(r"\d+")


def kind_of(line: str) -> str:
    if "|" in line:
        return "table"
    if LIST.match(line):
        return "list"
    if NOTE.match(line):
        return "note"
    return "sentence"


def key_of(word: str) -> str:
    return DIGITS.sub("0", word).rstrip(".!?")


def body_lines(text: str) -> list[str]:
    """Lines of the text without page furniture at its end: page numbers and lines that come again on other pages."""
    lines = [x.strip() for x in text.rstrip().split("\n")]
    shapes = Counter(_shape(x) for x in lines if x)
    paged = False
    while lines:
        last, alone = lines[-1], len(lines) < 2 or not lines[-2] or bool(PAGE.match(lines[-2]))
        if not last:
            lines.pop()
        elif PAGE.match(last):
            paged = True
            lines.pop()
        elif alone and kind_of(last) != "list" and len(last) <= 60 and (
            shapes[_shape(last)] > 1 or ((paged or PAGE_IN_LINE.search(last)) and not CLOSED.search(last) and _like_an_earlier(last, lines, shapes))):
            lines.pop()
        else:
            break
    return lines


def _shape(line: str) -> str:
    """A line without what differs from page to page: numbers and stray signs."""
    return re.sub(r"[\W\d_]+", "", line)


def _like_an_earlier(line: str, lines: list[str], shapes: Counter) -> bool:
    """Is this a misread copy of a line that stands alone earlier in the text?"""
    shape = _shape(line)
    for i, other in enumerate(lines[:-1]):
        if 0 < len(other) <= 60 and (i == 0 or not lines[i - 1] or PAGE.match(lines[i - 1])) and abs(len(other) - len(line)) <= 8:
            if SequenceMatcher(None, shape, _shape(other), autojunk=False).ratio() >= 0.7:
                return True
    return False


def ending(text: str) -> tuple:
    """(kind, last word, line key, closed, mark) of a text's end."""
    lines = body_lines(text)
    line = unicodedata.normalize("NFC", lines[-1]) if lines else ""
    mark = MARK.search(text.rstrip())
    tail = MARK.sub("", line).rstrip() if mark else line
    words = tail.split()
    last = words[-1] if words else ""
    plain = re.sub(r"[^\w\s.,:/년월일-]", "", tail)
    dated = bool(DATE_LINE.match(plain) or DATE_LINE_EN.match(plain) or DATE_AT_END.search(plain))
    closed = bool(CLOSED.search(tail)) and not NUMBER_POINT.search(tail) or dated
    if tail.endswith(")") and tail.count("(") < tail.count(")"):
        closed = False
    return kind_of(line), key_of(last), key_of(line), closed, bool(mark)


def _count_words(batches):
    """Per task: how often each word ends a paragraph of a kind, stands inside one, and how often each short line is a whole paragraph."""
    ends, inside, whole = Counter(), Counter(), Counter()

    def flush():
        out = [("end", k, w, n) for (k, w), n in ends.items()] + [("in", "", w, n) for w, n in inside.items()] + [("line", "", w, n) for w, n in whole.items()]
        ends.clear(), inside.clear(), whole.clear()
        return pd.DataFrame(out, columns=["what", "kind", "word", "n"])

    for pdf in batches:
        for text in pdf["text"]:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            blocks = DIGITS.sub("0", text).split("\n\n")
            times = Counter(blocks)
            for block in blocks[:-1]:
                block, again = block.strip(), times[block] > 1
                if not block or again:  # repeated blocks are page headings
                    continue
                lines = block.split("\n")
                if len(block) <= 60:
                    whole[block] += 1
                if "|" in block or LIST.match(block):
                    for line in lines:
                        words = line.split()
                        if words:
                            ends[kind_of(line), words[-1].rstrip(".!?")] += 1
                else:
                    words = block.split()
                    if len(words) >= 5:  # fewer are headings
                        ends["sentence", words[-1].rstrip(".!?")] += 1
                    inside.update(words[:-1])
            inside.update(blocks[-1].split()[:-1])
        # A word with a full stop inside a paragraph ends a sentence.
        for word in [w for w in inside if w[-1] in ".!?"]:
            ends["sentence", word.rstrip(".!?")] += inside.pop(word)
        if len(inside) + len(whole) > 500_000:
            yield flush()
    yield flush()


def _endings(batches):
    for pdf in batches:
        parts = [ending(t) for t in pdf["text"]]
        out = pd.DataFrame(parts, columns=["kind", "word", "line", "closed", "mark"])
        yield pdf[["doc_id", "source", "n_chars", "n_bytes"]].reset_index(drop=True).join(out)


def fit_censored(x: np.ndarray, n: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood mean and deviation of ln(length) where some values are only lower bounds (EM)."""
    y, w = np.log(x), n.astype(float)
    mu, sd = float(np.average(y, weights=w)), 1.0
    sd = max(1e-3, math.sqrt(np.average((y - mu) ** 2, weights=w)))
    for _ in range(60):
        z = (y - mu) / sd
        tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        hazard = np.where(tail > 1e-12, np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-12), z)
        first = np.where(censored, mu + sd * hazard, y)
        second = np.where(censored, mu**2 + sd**2 + sd * (mu + y) * hazard, y**2)
        new = float(np.average(first, weights=w))
        sd_new = math.sqrt(max(1e-6, float(np.average(second, weights=w)) - new**2))
        done = abs(new - mu) + abs(sd_new - sd) < 1e-7
        mu, sd = new, sd_new
        if done:
            break
    return mu, sd


def _limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Histogram of one source and measure -> candidate limits with their censoring posterior."""
    pdf = pdf.sort_values("length")
    x, n = pdf["length"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)
    width = 3 if pdf["measure"].iloc[0] == "bytes" else 1  # a byte limit falls within a character
    total, up_to = n.sum(), np.append(0.0, np.cumsum(n))

    def span(reach):
        return np.searchsorted(x, x - reach, "left"), np.searchsorted(x, x + reach, "right")

    (lo, hi), (far_lo, far_hi) = span(width), span(60)
    seen = up_to[hi] - up_to[lo]
    local = (up_to[far_hi] - up_to[far_lo] - seen) / 120.0
    beyond = total - up_to[hi]  # a field limit is hardly ever exceeded
    censored = np.zeros(len(x), bool)
    rows = []
    for _ in range(3):  # candidates change the fit, the fit the candidates
        mu, sd = fit_censored(x, n, censored)
        rows, again = [], np.zeros(len(x), bool)
        dens = np.exp(-0.5 * ((np.log(x) - mu) / sd) ** 2) / (x * sd * math.sqrt(2 * math.pi))
        expected = (2 * width + 1) * np.maximum(np.maximum(total * dens, local), 1e-9)
        fits = (n >= 4) & (beyond <= seen) & (seen >= 4 * expected + 4)
        for i in np.argsort(-n):
            if not fits[i] or again[lo[i] : hi[i]].any():
                continue
            again[lo[i] : hi[i]] = True
            rows.append((pdf["source"].iloc[0], pdf["measure"].iloc[0], int(x[i]), width, float(1 - expected[i] / seen[i]), mu, sd, float(seen[i])))
        if (again == censored).all():
            break
        censored = again
    return pd.DataFrame(rows, columns=["source", "measure", "limit", "width", "posterior", "mu", "sigma", "n_at_limit"])


LIMITS = "source string, measure string, limit long, width int, posterior double, mu double, sigma double, n_at_limit double"


def length_limits(lengths: DataFrame) -> DataFrame:
    """lengths(source, n_chars, n_bytes) -> candidate limits per source and measure."""
    long = lengths.select("source", F.explode(F.create_map(F.lit("chars"), "n_chars", F.lit("bytes"), "n_bytes")).alias("measure", "length")).where("length > 0")
    # Exact lengths: texts of T bytes in all have at most sqrt(2 T) different ones, so a histogram stays small.
    return long.groupBy("source", "measure", "length").agg(F.count("*").alias("n")).groupBy("source", "measure").applyInPandas(_limits, LIMITS)


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ..., posterior, ending, log_odds, cut) for every non-blank text."""
    texts = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "source", "text", F.char_length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"))
    counts = texts.select("text").mapInPandas(_count_words, "what string, kind string, word string, n long").groupBy("what", "kind", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    ends = written(texts.mapInPandas(_endings, "doc_id long, source string, n_chars long, n_bytes long, kind string, word string, line string, closed boolean, mark boolean"), "endings")
    limits = written(length_limits(ends.select("source", "n_chars", "n_bytes")), "limits")
    # Only words that end some text are looked up, once each.
    asked = ends.select("kind", "word").distinct()
    stat = asked.join(counts.where("what = 'end'").select("kind", "word", F.col("n").alias("end")), ["kind", "word"], "left").join(
        counts.where("what = 'in'").select("word", F.col("n").alias("inside")), "word", "left")
    lines = ends.select("line").distinct().join(counts.where("what = 'line'").select(F.col("word").alias("line"), F.col("n").alias("as_line")), "line")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = ends.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(stat.select("kind", "word", "end", "inside", salts), ["kind", "word", "salt"], "left").join(lines.select("line", "as_line", salts), ["line", "salt"], "left")
    at = limits.select(F.col("source").alias("_s"), "measure", "limit", "width", F.col("posterior").alias("p"), salts)
    length = F.when(F.col("measure") == "chars", F.col("n_chars")).otherwise(F.col("n_bytes"))
    hits = rows.join(at.withColumnRenamed("salt", "_salt"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("salt") == F.col("_salt"))).where(F.abs(length - F.col("limit")) <= F.col("width")).groupBy("doc_id").agg(F.max("p").alias("posterior"))
    rows = rows.join(hits, "doc_id", "left").fillna({"end": 0, "inside": 0, "as_line": 0, "posterior": 0.0})
    share = (F.col("end") + 0.5) / (F.col("end") + F.when(F.col("kind") == "sentence", F.col("inside")).otherwise(0) + 6.0)
    learned = F.log((1 - share) / share)
    often = max(3, int(HEADING_SHARE * ends.count()))
    evidence = F.when(F.col("mark"), 6.0).when(F.col("closed"), -6.0).when(F.col("as_line") >= often, -5.0).when(
        F.col("kind").isin("list", "table", "note"), F.when(F.col("posterior") > 0.5, learned).otherwise(-5.0)).otherwise(learned)
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("posterior")))
    censor = F.when(F.col("posterior") > 0, F.greatest(F.lit(0.0), F.log(p / (1 - p)))).otherwise(0.0)
    return rows.withColumn("ending", evidence).withColumn("log_odds", evidence + censor).withColumn("cut", F.col("log_odds") > CUT_AT).select(
        "doc_id", "source", "n_chars", "n_bytes", "kind", "word", "posterior", "ending", "log_odds", "cut")


def found(documents: DataFrame) -> DataFrame:
    return judged(documents).where("cut").select("doc_id")


def rates(documents: DataFrame) -> DataFrame:
    """Cut documents and their rate per source, with the strongest limit found."""
    rows = written(judged(documents), "judged")
    return rows.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.avg(F.col("cut").cast("int")).alias("cut_rate"),
        F.sum((F.col("posterior") > 0.5).cast("int")).alias("n_at_limit"))
