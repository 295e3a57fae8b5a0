"""Noise in text from scanned pages.

Method: skip-gram vectors are learned from all parsed texts by factorising the positive
shifted PMI matrix of words and their neighbours, the matrix that skip-gram training
with negative sampling factorises (Levy and Goldberg 2014): counts and marginals are
summed in the JVM, neighbours are hashed to CELLS columns, and the eigenvectors of the
CELLS x CELLS Gram matrix give words and neighbours their vectors.  Rare words are linked
to frequent ones that are one plausible glyph edit (or a misread number) away and near in
vector space.  Every occurrence of a linked word is decided by its own context: the
candidate that its neighbours predict best corrects it, or none.  Which signs are stray
is learned too: a sign is stray where taking it out of a word mostly leaves a frequent
word.  Then page furniture is removed and lines are reflowed into paragraphs.

Counts, links, vectors and occurrences are tables joined on words.  A Bloom filter of
bounded size spares work; the joins decide, so its size never changes a row.  No rule
depends on a count of its own: frequencies are compared with each other, shares are
shrunk towards the corpus.

A heading is one line of 3 to 60 characters (70 with what scanning adds); a single
character is no word to link.

Results by case: null and blank texts have no noise; a text of any length is read
whole; records delivered again count once; deleted blocks count; a block without
document takes it from its block_id; an occurrence without neighbours is decided by its
word's link; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.lookalike import TABLE
from docloom.llm.truncation import MARK
from docloom.session import canonical_id, written

#: Columns of neighbour hashes and dimensions of the vectors.
CELLS, DIMENSIONS = 512, 48
WINDOW = 2
#: A word linked to a rare one is at least so many times as frequent.
RATIO = 20
#: Bloom filter: bits per word, and the bits at which it stops to grow (16 MB).
BITS_PER_WORD, MOST_BITS = 16, 1 << 27
#: Least share of a linked word's records with other noise, shrunk by SHRINK records towards the share of all.
AMONG_NOISE, SHRINK = 0.3, 2.0
#: Least cosine between the vectors of linked words, and least prediction of a word by the neighbours of an occurrence.
CONTEXT, FIT = 0.05, 0.02
#: A sign is stray where taking it out leaves a frequent word in this share of its occurrences.
STRAY_SHARE = 0.5

HYPHENS = "-‐‑¬­"
SPLIT_WORD = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][^\S\n]*\n[^\S\n]*(?=[^\W\d_])")
#: A line that ends within a word; the rest may follow after page furniture.
SPLIT_LINE = re.compile(rf"[^\W\d_][{HYPHENS}]$")
NUM = r"[\dlIOSBoZ]{1,4}"
PAGE_LINE = re.compile(
    rf"^\s*(?:[-–—]\s*{NUM}\s*[-–—]|[(〈<\[]\s*{NUM}\s*[)〉>\]]|p\.?\s*{NUM}|page\s*{NUM}(?:\s*(?:/|of)\s*{NUM})?|제\s*{NUM}\s*(?:쪽|면|페이지)|{NUM}\s*(?:쪽|페이지)|{NUM}\s*/\s*{NUM}|\d{{1,4}})\s*$", re.I)
# A page line with a stray sign or two in it is still one.
NOISE_SIGNS = re.compile(r"(?<=\S)[^\w\s.,/:()\[\]<>〈〉–—-]|[^\w\s.,/:()\[\]<>〈〉–—-](?=\S)")
EDGE = ".,;:!?()[]{}<>〈〉「」『』\"'“”‘’…·"
MARKED = re.compile(r"^\s*(?:[-–·•*▪◦○●□■◇◆ㅇ※]|[가-하]\.|\d{1,2}[.)](?!\d))\s*\S")
DIGIT = re.compile(r"\d")
#: Letters that scanners take for digits.
FOR_DIGITS = str.maketrans("OoDlIiSsBZzgq", "0" * 13)
AS_DIGITS = str.maketrans("OoDlIiSsBZzgq", "0001115582299")


def clean_word(token: str) -> str:
    """A token without edge punctuation, digits as 0."""
    token = token.strip(EDGE)
    if not token.isascii():
        token = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", token).translate(TABLE))
    return DIGIT.sub("0", token)


class _Words(dict):
    """Cache of cleaned tokens."""

    def __missing__(self, token):
        if len(self) > 500_000:
            self.clear()
        w = self[token] = clean_word(token)
        return w


_word = _Words()


def words_of(text: str, strays: frozenset = frozenset()) -> list[str]:
    """Words of a text in order, divided words joined; the last one is left out where a mark shows that it is cut."""
    tokens = SPLIT_WORD.sub("", text).split()
    if MARK.search(text[-80:].rstrip()):
        tokens.pop()
    return [_word[without_strays(t, strays)] for t in tokens] if strays else [_word[t] for t in tokens]


def _count(batches, wanted=None):
    counts = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            counts.update(words_of(text) if wanted is None else filter(wanted, words_of(text)))
        if len(counts) > 500_000:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
            counts = Counter()
    if counts:  # a task without texts gives no frame: its columns would have no type
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})


# ---- stray signs ----


LETTERS, DIGITS = re.compile(r"[^\W\d_]{2,}"), re.compile(r"\d{2,}")


def _side(char: str) -> str:
    return "edge" if not char or char in EDGE else "digit" if char.isdigit() else "letter" if char.isalpha() else "sign"


def signs_in(word: str) -> list[tuple[str, str, str, int]]:
    """(sign, kind of what stands before, after, place) of the signs in a word; hyphens divide or join and are none."""
    out = []
    for i, c in enumerate(word):
        if not c.isalnum() and c not in HYPHENS and unicodedata.category(c)[0] in "PSCZ":
            out.append((c, _side(word[i - 1 : i]), _side(word[i + 1 : i + 2]), i))
    return out


def _signed(batches):
    """(sign, before, after, word left without it, n); an empty sign counts the places between two letters and between two digits."""
    for pdf in batches:
        rows = [(c, a, b, w[:i] + w[i + 1 :], n) for w, n in zip(pdf["word"], pdf["n"]) if len(w) > 2 and not w.isalnum() for c, a, b, i in signs_in(w)]
        for side, pair in (("letter", LETTERS), ("digit", DIGITS)):
            rows.append(("", side, side, "", int(sum(n * (len(x) - 1) for w, n in zip(pdf["word"], pdf["n"]) for x in pair.findall(w)))))
        yield pd.DataFrame(rows, columns=["sign", "before", "after", "word", "n"])


def _count_with_signs(batches):
    yield from _count(batches, lambda w: len(w) > 2 and not w.isalnum())


def stray_signs(counts: DataFrame, blocks: DataFrame | None = None) -> frozenset:
    """(sign, before, after) that are stray; there are at most as many as signs times 16, whatever the data.

    A place with few occurrences is judged like its sign elsewhere.  Between digits any
    sign leaves a frequent number: there the sign is stray as far as it is no more
    frequent, for the places there are, than between letters.
    """
    words = counts
    if blocks is not None:  # signs that stand in the words of blocks only
        words = counts.unionByName(blocks.select("text").mapInPandas(_count_with_signs, "word string, n long"))
    signed = words.mapInPandas(_signed, "sign string, before string, after string, word string, n long")
    base = counts.select("word", F.col("n").alias("base"))
    met = signed.join(base, "word", "left").withColumn("good", F.when((F.coalesce("base", F.lit(0)) >= F.col("n") * RATIO) & F.col("word").rlike(r"[^0-9.,]"), F.col("n")).otherwise(0))
    got = met.groupBy("sign", "before", "after").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toPandas()
    places = got[got["sign"] == ""].set_index("before")["n"]
    got = got[got["sign"] != ""].astype({"good": float})
    numeric = (got["before"] == "digit") & (got["after"] == "digit")
    by_letters = got[(got["before"] == "letter") & (got["after"] == "letter")].set_index("sign")["good"] / max(1, places.get("letter", 1))
    got.loc[numeric, "good"] = np.minimum(got["n"], got["sign"].map(by_letters).fillna(0.0) * places.get("digit", 0))[numeric]
    of_sign = got[~numeric].groupby("sign")[["good", "n"]].sum()
    elsewhere = got["sign"].map(of_sign["good"] / of_sign["n"]).fillna(0.0)
    share = (got["good"] + SHRINK * elsewhere * ~numeric) / (got["n"] + SHRINK * ~numeric)
    return frozenset(got.loc[share >= STRAY_SHARE, ["sign", "before", "after"]].itertuples(index=False, name=None))


def without_strays(token: str, strays: frozenset) -> str:
    """The token without stray signs; the same string where it has none."""
    if not strays or len(token) < 2 or token.isalnum():
        return token
    out = [c for i, c in enumerate(token) if c.isalnum() or (c, _side(token[i - 1 : i] if i else ""), _side(token[i + 1 : i + 2])) not in strays]
    return "".join(out) if len(out) < len(token) else token


# ---- links of rare words to frequent ones ----

_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def patterns(word: str) -> list[int]:
    """Hashes of the word with each letter (of a Hangul syllable: each part) in turn left open, digraphs that look like
    one letter also as one; of the whole word; and of the word with letters for digits read as digits."""
    units = unicodedata.normalize("NFD", word)
    ahead, behind, power = [0], [0], [1]
    for c in units:
        ahead.append((ahead[-1] * _BASE + ord(c)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    for k, c in enumerate(reversed(units)):
        behind.append((behind[-1] + ord(c) * power[k]) % _PRIME)
    behind.reverse()

    def open_at(i, j):  # the hash of units[:i] + "*" + units[j:]
        return (((ahead[i] * _BASE + 42) % _PRIME) * power[len(units) - j] + behind[j]) % _PRIME

    out = [open_at(i, i + 1) for i in range(len(units))]
    for pair in ("rn", "cl", "li", "vv", "nn"):
        at = units.find(pair)
        while at >= 0:
            out.append(open_at(at, at + 2))
            at = units.find(pair, at + 1)
    out.append(ahead[-1] + _PRIME)
    read = reading(word)
    if read != word:
        out.append(patterns(read)[-1])
    return out


def reading(word: str) -> str:
    """A word that holds a digit with the letters for digits read as digits."""
    return word.translate(FOR_DIGITS) if "0" in word else word


# Parts of letters that scanning takes for one another; each line is a group.
GLYPHS = """
ㅡ ㅗ ㅜ ㅠ ㅛ
ㅏ ㅑ ㅣ ㅓ ㅕ
ㅐ ㅔ ㅒ ㅖ ㅢ
ㅘ ㅚ ㅙ ㅝ ㅟ
ㄱ ㅋ ㄲ ㅂ ㅈ
ㄴ ㄷ ㄹ ㅌ ㅁ ㅂ
ㅅ ㅈ ㅊ ㅆ ㅉ
ㅇ ㅎ ㅁ ㅂ
e c o
h b n li
l i I 1 t 0
m rn nn
d cl
w vv
a o s
u v n
g q 9
f t
r n
O 0 o D
S 5 s
B 8 3
Z 2 z
"""
_JAMO = {}
for _first, _kind in ((0x1100, "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"), (0x1161, "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"), (0x11A8, "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ")):
    _JAMO.update({chr(_first + _i): _c for _i, _c in enumerate(_kind)})
_ALIKE = {frozenset((a, b)) for line in GLYPHS.strip().split("\n") for a in line.split() for b in line.split() if a != b}


def plausible(rare: str, common: str) -> bool:
    """Does one glyph confusion, or letters for digits in a number, turn the common word into the rare one?"""
    if reading(rare) == common:
        return True
    a, b = unicodedata.normalize("NFD", rare), unicodedata.normalize("NFD", common)
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    x, y = "".join(_JAMO.get(c, c) for c in x), "".join(_JAMO.get(c, c) for c in y)
    return frozenset((x, y)) in _ALIKE or (x + y).isdigit() is False and DIGIT.sub("0", x + y).strip("0OlISBZ") == "" and x != y


def _patterns(batches):
    for pdf in batches:
        rows = [(p, w, n) for w, n in zip(pdf["word"], pdf["n"]) if len(w) > 1 for p in patterns(w)]
        yield pd.DataFrame(rows, columns=["pattern", "word", "n"])


def _plausible(batches):
    for pdf in batches:
        yield pdf[[plausible(a, b) for a, b in zip(pdf["rare"], pdf["common"])]]


def glyph_links(counts: DataFrame) -> DataFrame:
    """(rare, common, n_rare, n_common) with one plausible glyph edit between them."""
    keyed = counts.mapInPandas(_patterns, "pattern long, word string, n long")
    rare = keyed.select("pattern", F.col("word").alias("rare"), F.col("n").alias("n_rare"))
    # A pattern fixes all units but one, so the alphabet bounds its words however large the data are: each is compared with all frequent ones.
    common = keyed.where(F.col("n") >= RATIO).select("pattern", F.col("word").alias("common"), F.col("n").alias("n_common"))
    return rare.join(common, "pattern").where((F.col("rare") != F.col("common")) & (F.col("n_rare") * RATIO <= F.col("n_common"))).select("rare", "common", "n_rare", "n_common").distinct().mapInPandas(
        _plausible, "rare string, common string, n_rare long, n_common long")


# ---- a filter of words ----

BLOCK_BITS = 1 << 19


class Filter:
    """Bits of word hashes: what it lacks is certainly not wanted."""

    def __init__(self, bits: int):
        self.bits = bits
        self.data = np.zeros(max(1, bits >> 3), dtype=np.uint8)

    def put(self, h: int) -> None:
        at = h % self.bits
        self.data[at >> 3] |= 1 << (at & 7)

    def __contains__(self, h: int) -> bool:
        at = h % self.bits
        return bool(self.data[at >> 3] >> (at & 7) & 1)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _any_bit(pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in pdf["data"]])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [out.tobytes()]})


def word_filter(words: DataFrame, bits: int | None = None) -> Filter:
    """A filter of words(word); tasks set bits, blocks of bits are joined by or, at most 16 MB come to the driver."""
    if bits is None:
        bits = 1 << 16
        wanted = words.count() * BITS_PER_WORD
        while bits < min(wanted, MOST_BITS):
            bits *= 2

    def set_bits(batches):
        mine = Filter(bits)
        for pdf in batches:
            for w in pdf["word"]:
                mine.put(_hash(w))
        step = BLOCK_BITS >> 3
        for b in range(0, len(mine.data), step):
            part = mine.data[b : b + step]
            if part.any():
                yield pd.DataFrame({"block": [b], "data": [part.tobytes()]})

    out = Filter(bits)
    for r in words.mapInPandas(set_bits, "block int, data binary").groupBy("block").applyInPandas(_any_bit, "block int, data binary").toLocalIterator():
        part = np.frombuffer(r["data"], dtype=np.uint8)
        out.data[r["block"] : r["block"] + len(part)] = part
    return out


# ---- skip-gram vectors ----


def _neighbours(wanted):
    """Per task: (key, cell, n), how often words of the filter have a neighbour of each cell; key 0 counts all words together."""

    def run(batches):
        words, ids, keys = wanted.value, {}, []
        cache: dict[str, tuple[int, int]] = {}
        total = np.zeros(CELLS, dtype=np.int64)
        codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        waiting: list[np.ndarray] = []

        def look(w):
            c = cache.get(w)
            if c is None:
                if len(cache) > 500_000:
                    cache.clear()
                h = _hash(w)
                own = -1
                if h in words:
                    own = ids.setdefault(h, len(ids))
                    if own == len(keys):
                        keys.append(h)
                c = cache[w] = (h % CELLS, own)
            return c

        def settle():
            nonlocal codes, counts
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)

        size = 0
        for pdf in batches:
            for text in pdf["text"]:
                ws = words_of(text)
                if len(ws) < 2:
                    continue
                looked = np.array([look(w) for w in ws])
                cell, own = looked[:, 0], looked[:, 1]
                for off in range(1, WINDOW + 1):
                    for mid, ctx in ((slice(off, None), slice(None, -off)), (slice(None, -off), slice(off, None))):
                        m, c = own[mid], cell[ctx]
                        total += np.bincount(c, minlength=CELLS)
                        keep = m >= 0
                        waiting.append(m[keep] * CELLS + c[keep])
                        size += len(waiting[-1])
            if size > 4_000_000:
                settle()
                size = 0
        if waiting:
            settle()
        names = np.array(keys, dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"key": np.append(names[codes // CELLS], np.zeros(CELLS, dtype=np.int64)), "cell": np.append(codes % CELLS, np.arange(CELLS)).astype(np.int32), "n": np.append(counts, total)})

    return run


def _pmi(pdf: pd.DataFrame, share: np.ndarray) -> np.ndarray:
    """Rows of positive PMI; the cells' shares are smoothed by the power 0.75, as negative samples are drawn."""
    rows = np.zeros((len(pdf), CELLS), dtype=np.float32)
    for i, row in enumerate(pdf["row"]):
        cells = np.fromiter((r["cell"] for r in row), dtype=np.int64)
        n = np.fromiter((r["n"] for r in row), dtype=np.float64)
        rows[i, cells] = np.maximum(0.0, np.log(n / n.sum() / share[cells]))
    return rows


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["data"].iloc[0]) // 8)
    for b in pdf["data"]:
        total += np.frombuffer(b, dtype=np.float64)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [total.tobytes()]})


def skipgram_vectors(texts: DataFrame, words: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(key, vector) of the words, key being the word's hash, and the vectors of the neighbour cells (CELLS x DIMENSIONS).

    The driver gets CELLS shares and the CELLS x CELLS Gram matrix (2 MB), whatever the data.
    """
    wanted = texts.sparkSession.sparkContext.broadcast(word_filter(words))
    pairs = written(texts.mapInPandas(_neighbours(wanted), "key long, cell int, n long").groupBy("key", "cell").agg(F.sum("n").alias("n")), "neighbours")
    share = np.zeros(CELLS)
    for r in pairs.where("key = 0").collect():
        share[r["cell"]] = r["n"]
    share = np.maximum(share, 1.0) ** 0.75
    share /= share.sum()
    keys = words.select(F.col("word")).mapInPandas(_keys, "key long").distinct()
    rows = written(pairs.where("key <> 0").join(keys, "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("cell", "n")).alias("row")), "rows")  # at most CELLS entries each

    def gram(batches):
        out = np.zeros((CELLS, CELLS))
        for pdf in batches:
            m = _pmi(pdf, share).astype(np.float64)
            out += m.T @ m
        for b in range(0, CELLS, 64):
            yield pd.DataFrame({"block": [b], "data": [out[b : b + 64].tobytes()]})

    total = np.zeros((CELLS, CELLS))
    for r in rows.mapInPandas(gram, "block int, data binary").groupBy("block").applyInPandas(_sum_blocks, "block int, data binary").collect():
        total[r["block"] : r["block"] + 64] = np.frombuffer(r["data"]).reshape(64, CELLS)
    cells = np.linalg.eigh(total)[1][:, ::-1][:, :DIMENSIONS].astype(np.float32)

    def project(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "vector": [v.tobytes() for v in _pmi(pdf, share) @ cells]})

    return rows.mapInPandas(project, "key long, vector binary"), cells


def _keys(batches):
    for pdf in batches:
        yield pd.DataFrame({"key": np.array([_hash(w) for w in pdf["word"]], dtype=np.uint64).view(np.int64)})


def _keyed(batches):
    for pdf in batches:
        for side in ("rare", "common"):
            pdf["k_" + side] = np.array([_hash(w) for w in pdf[side]], dtype=np.uint64).view(np.int64)
        yield pdf


def _similar(batches):
    for pdf in batches:
        cos = []
        for a, b in zip(pdf["va"], pdf["vb"]):
            x, y = np.frombuffer(a, dtype=np.float32), np.frombuffer(b, dtype=np.float32)
            cos.append(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-12)))
        number = [reading(a) == b for a, b in zip(pdf["rare"], pdf["common"])]
        yield pdf[["rare", "common", "n_rare", "n_common"]].assign(context=cos, vector=pdf["vb"], number=number)


#: number: letters for digits in a number, which can't be read otherwise; what stands around numbers says little.
LINKS = "rare string, common string, n_rare long, n_common long, context double, vector binary, number boolean"


def candidate_links(texts: DataFrame, counts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """All links that glyphs and vectors support, with the frequent word's vector; and the vectors of neighbours."""
    pairs = written(glyph_links(counts).mapInPandas(_keyed, "rare string, common string, n_rare long, n_common long, k_rare long, k_common long"), "glyphs")
    both = pairs.select(F.col("rare").alias("word")).unionByName(pairs.select(F.col("common").alias("word"))).distinct()
    vectors, cells = skipgram_vectors(texts, both)
    vectors = written(vectors, "vectors")
    va = vectors.select(F.col("key").alias("k_rare"), F.col("vector").alias("va"))
    vb = vectors.select(F.col("key").alias("k_common"), F.col("vector").alias("vb"))
    scored = pairs.join(va, "k_rare").join(vb, "k_common").mapInPandas(_similar, LINKS).where((F.col("context") >= CONTEXT) | F.col("number"))
    return written(scored, "links"), cells


def word_counts(texts: DataFrame) -> DataFrame:
    return written(texts.mapInPandas(_count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "counts")


def links(documents: DataFrame) -> DataFrame:
    """(rare, common, n_rare, n_common, context): per rare word the nearest of the frequent words that it may stand for."""
    texts = documents.where("text_raw is not null").select(F.col("text_raw").alias("text"))
    found, _ = candidate_links(texts, word_counts(texts))
    best = F.max(F.struct(F.col("context"), F.col("n_common"), F.col("common"), F.col("n_rare"))).alias("b")
    return found.groupBy("rare").agg(best).select("rare", "b.common", "b.n_rare", "b.n_common", "b.context")


# ---- page furniture ----


def is_page_line(line: str) -> bool:
    return bool(PAGE_LINE.match(NOISE_SIGNS.sub("", line)))


NO_LETTER = re.compile(r"[\W\d_]+")
NO_WORD = re.compile(r"\W+")


def shape(line: str) -> str:
    """What stays of a running heading from page to page: letters, without digits, blanks and signs; of a line of digits these."""
    return NO_LETTER.sub("", line) or NO_WORD.sub("", line)


def alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 3:
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.75


def running_headings(text: str, title: str | None = None, agency: str | None = None) -> list[str]:
    """Shapes of the page headings of a text: short lines that come again where pages begin."""
    lines = [x.strip() for x in text.split("\n")]
    filled = [i for i, x in enumerate(lines) if x]
    spots: dict[str, list[int]] = {}
    for i in filled:
        x = lines[i]
        if not 3 <= len(x) <= 60 or is_page_line(x) or MARKED.match(x):
            continue
        before = lines[i - 1] if i else ""
        after = lines[i + 1] if i + 1 < len(lines) else ""
        if "|" in x and ("|" in before or "|" in after):
            continue  # a table's row
        starts = i == filled[0] or not before or is_page_line(before)
        ends = not after or is_page_line(after)
        if starts or ends:
            spots.setdefault(shape(x), []).append(i)
    spots.pop("", None)
    out = []
    known = [shape(unicodedata.normalize("NFC", x)) for x in (title, agency) if x]
    first = shape(lines[filled[0]]) if filled else ""
    opens = {s: sum(_opens_page(lines, i) for i in at) for s, at in spots.items()}
    # Misread copies are looked for only among lines that could open a page.
    likely = [s for s in spots if len(spots[s]) > 1 or opens[s] or s == first]
    for s in likely:
        if len(s) < 3:
            continue
        n, opening = len(spots[s]), opens[s]
        for t in likely:
            if t != s and alike(s, t):
                n, opening = n + len(spots[t]), opening + opens[t]
        if n < 2:
            continue
        about = any(k and (k in s or s in k or alike(s, k[: len(s)])) for k in known)
        if about or opening >= 2 or (opening and alike(s, first)):
            out.append(s)
    return out


def _opens_page(lines: list[str], i: int) -> bool:
    """Does a page number stand in the nearest filled line before or after?"""
    j = i - 1
    while j >= 0 and not lines[j]:
        j -= 1
    if j >= 0 and is_page_line(lines[j]):
        return True
    return False


IN_LINE = re.compile(r"(?:^|\s)[-–(]?\s*(\d{1,3})\s*[-–)]?$|^[-–(]?\s*(\d{1,3})\s*[-–)]?\s")


def is_furniture(line: str, headings: list[str]) -> bool:
    return bool(line) and (is_page_line(line) or bool(headings) and len(line) <= 70 and any(alike(shape(line), h) for h in headings))


def noise_of(text: str, headings: list[str], strays: frozenset = frozenset()) -> set[str]:
    """Kinds of noise that show without the word links."""
    kinds = set()
    plain = [x.strip() for x in text.rstrip().rstrip("�").split("\n")]
    numbers = set()
    for x in plain:
        if not x:
            continue
        if strays and any(w != t for _, t, w in _tokens(x, strays)):
            kinds.add("misread")
        if is_page_line(x):
            kinds.add("page_number")
            continue
        if x[-1] in HYPHENS and SPLIT_LINE.search(x):
            kinds.add("hyphenation")
        if is_furniture(x, headings):
            kinds.add("running_header")
            m = IN_LINE.search(x)
            if m:
                numbers.add(m[1] or m[2])
    if numbers:
        kinds.add("page_number")
    return kinds


TOKEN = re.compile(r"\S+")
#: A token with the rest of it where a line end divides it.
WHOLE = re.compile(rf"(?:{SPLIT_WORD.pattern}|\S)+")


def _tokens(line: str, strays: frozenset):
    """(place, token, token without stray signs) of a line; a sign that opens the line is a list mark."""
    for m in TOKEN.finditer(line):
        t = m[0]
        if m.start() == 0 and len(t) > 1 and not t[0].isalnum():
            yield m.start(), t, t[0] + without_strays(t[1:], strays)
        else:
            yield m.start(), t, without_strays(t, strays)


NOISE = "table_name string, record_id string, noise_kind string, word string, at int, neighbours array<int>"


def _scan(wanted, strays, name):
    """Rows of the kinds found, and each occurrence of a word that may be linked, with its neighbours' cells (noise_kind null)."""

    def run(batches):
        words = wanted.value
        cache: dict[str, tuple[bool, int]] = {}

        def look(w):
            c = cache.get(w)
            if c is None:
                if len(cache) > 500_000:
                    cache.clear()
                h = _hash(w)
                c = cache[w] = (h in words, h % CELLS)
            return c

        for pdf in batches:
            rows = []
            for record, text, heads in zip(pdf["record_id"], pdf["text"], pdf["headings"]):
                rows.extend((name, record, k, None, None, None) for k in noise_of(text, [] if heads is None else list(heads), strays))
                ws = words_of(text, strays)
                looked = [look(w) for w in ws]
                for i, (hit, _) in enumerate(looked):
                    if hit:
                        around = [looked[j][1] for j in range(max(0, i - WINDOW), min(len(ws), i + WINDOW + 1)) if j != i]
                        rows.append((name, record, None, ws[i], i, around))
            yield pd.DataFrame(rows, columns=["table_name", "record_id", "noise_kind", "word", "at", "neighbours"])

    return run


def heading_rest(line: str, title: str | None, agency: str | None) -> str | None:
    """What a line's shape holds besides parts of the document's title or agency; null where it holds none of either."""
    rest, about = shape(line), False
    for known in (title, agency):
        k = shape(unicodedata.normalize("NFC", known)) if known else ""
        if len(k) < 3 or not rest:
            continue
        if alike(rest, k[: len(rest)]):
            return ""
        m = SequenceMatcher(None, rest, k, autojunk=False).find_longest_match()
        if m.size >= 4 or m.size == len(k):
            rest, about = rest[: m.a] + rest[m.a + m.size :], True
    return rest if about else None


def _first_line(text: str) -> str | None:
    """The line that opens a text and stands alone above a blank line, if it could be a heading."""
    lines = [x.strip() for x in text.split("\n")]
    at = next((i for i, x in enumerate(lines) if x), None)
    if at is None or not 3 <= len(lines[at]) <= 60 or MARKED.match(lines[at]) or is_page_line(lines[at]):
        return None
    return lines[at] if at + 1 < len(lines) and not lines[at + 1] else None


HEADED = "record_id string, text string, headings array<string>, rests array<string>, first string, first_rest string, first_numbered boolean"


def _headings(batches):
    for pdf in batches:
        found = [running_headings(t, a, b) for t, a, b in zip(pdf["text"], pdf["title"], pdf["agency"])]
        rests = [[r for h in hs if (r := heading_rest(h, a, b)) is not None] for hs, a, b in zip(found, pdf["title"], pdf["agency"])]
        first = [None if hs else _first_line(t) for hs, t in zip(found, pdf["text"])]
        first_rest = [None if x is None else heading_rest(x, a, b) for x, a, b in zip(first, pdf["title"], pdf["agency"])]
        yield pdf[["record_id", "text"]].assign(
            headings=found, rests=rests, first=[None if x is None else shape(x) for x in first], first_rest=first_rest, first_numbered=[None if x is None else bool(IN_LINE.search(x)) for x in first])


#: What stands in a running heading beside title and agency is a form of the corpus from this share of the repeated headings on.
FORM_SHARE = 0.01


def with_headings(documents: DataFrame) -> DataFrame:
    """(record_id, text, headings) of parsed documents, written.

    Headings are lines that come again where pages begin.  A document of one page shows
    its heading once: the line that opens it is one if it holds title or agency and
    otherwise only what repeated headings of other documents hold; a bare title must
    bear a page number.
    """
    rows = documents.where("text_raw is not null").select(F.col("document_id").alias("record_id"), F.col("text_raw").alias("text"), "title", "agency")
    rows = written(rows.mapInPandas(_headings, HEADED), "parsed")
    forms = rows.select(F.explode("rests").alias("rest")).groupBy("rest").agg(F.count("*").alias("n"))
    total = forms.agg(F.sum("n")).first()[0] or 0
    known = [r["rest"] for r in forms.where(F.col("n") >= FORM_SHARE * total).collect()]  # at most 1 / FORM_SHARE
    opens = F.col("first_rest").isin(known) & ((F.col("first_rest") != "") | F.col("first_numbered"))
    return rows.select("record_id", "text", F.when((F.size("headings") == 0) & opens, F.array("first")).otherwise(F.col("headings")).alias("headings"))


def _with_document(blocks: DataFrame) -> DataFrame:
    """Blocks, one row per block_id and text, with the key of their document."""
    named = F.regexp_extract(canonical_id(F.col("block_id")), r"^(.+)-B\d+$", 1)
    key = F.when(named != "", named).otherwise(canonical_id(F.col("document_id")))
    return blocks.where("text_normalized is not null").select(F.col("block_id").alias("record_id"), F.col("text_normalized").alias("text"), key.alias("key"))


def _decide(cells):
    """fit of every (occurrence, candidate): how well the neighbours predict the candidate; null without neighbours."""

    def run(batches):
        for pdf in batches:
            fit = [float(np.mean(cells[np.asarray(a)] @ np.frombuffer(v, dtype=np.float32))) if a is not None and len(a) else None for a, v in zip(pdf["neighbours"], pdf["vector"])]
            yield pdf.drop(columns=["neighbours", "vector"]).assign(fit=pd.array(fit, dtype="Float64"))

    return run


OCCURRENCES = "table_name string, record_id string, word string, at int, common string, context double, number boolean, fit double"


def _detected(documents: DataFrame, blocks: DataFrame, bits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, frozenset]:
    """(kinds, occurrences, docs, parts, strays): kinds of noise per record; misread occurrences, each with its correction; the texts."""
    docs = with_headings(documents)
    texts = docs.select("text")
    counts = word_counts(texts)
    strays = stray_signs(counts, _with_document(blocks))
    known, cells = candidate_links(texts, counts)
    wanted = documents.sparkSession.sparkContext.broadcast(word_filter(known.select(F.col("rare").alias("word")).distinct(), bits))
    heads = docs.where(F.size("headings") > 0).select(canonical_id(F.col("record_id")).alias("key"), "headings").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("headings"))).alias("headings"))
    parts = _with_document(blocks).join(written(heads, "headings"), "key", "left").select("record_id", "text", "headings")
    rows = written(docs.mapInPandas(_scan(wanted, strays, "documents"), NOISE).unionByName(parts.mapInPandas(_scan(wanted, strays, "blocks"), NOISE)), "noise")
    kinds = rows.where("noise_kind is not null").select("table_name", "record_id", "noise_kind")
    met = rows.where("noise_kind is null").select("table_name", "record_id", "word", "at", "neighbours").join(known.select(F.col("rare").alias("word"), "common", "context", "vector", "number"), "word")
    scored = met.mapInPandas(_decide(cells), OCCURRENCES).where((F.col("fit") >= FIT) | F.col("fit").isNull() | F.col("number"))
    best = F.max_by(F.col("common"), F.struct(F.coalesce("fit", F.lit(0.0)) + F.col("context"), "common")).alias("common")
    chosen = written(scored.groupBy("table_name", "record_id", "at", "word").agg(best), "occurrences")
    # A real word that merely resembles a frequent one occurs in clean records too: records with other noise are counted.
    docs_only = chosen.where("table_name = 'documents'").select("record_id", "word").distinct()
    noisy = kinds.where("table_name = 'documents'").select("record_id", F.lit(3).alias("n")).distinct().unionByName(docs_only.groupBy("record_id").agg(F.count("*").cast("int").alias("n")))
    noisy = noisy.groupBy("record_id").agg((F.max("n") > 2).cast("int").alias("noisy"))
    where = written(docs_only.join(noisy, "record_id").groupBy("word").agg(F.count("*").alias("records"), F.sum("noisy").alias("among")), "among")
    overall = where.agg(F.sum("among") / F.sum("records")).first()[0] or 0.0
    real = where.where((F.col("among") + SHRINK * overall) / (F.col("records") + SHRINK) < AMONG_NOISE).select("word")
    return kinds, written(chosen.join(real, "word", "left_anti"), "misread"), docs, parts, strays


def noise(documents: DataFrame, blocks: DataFrame, bits: int | None = None) -> DataFrame:
    """(table_name, record_id, noise_kind), one row per record and kind."""
    kinds, misread, *_ = _detected(documents, blocks, bits)
    return kinds.unionByName(misread.select("table_name", "record_id", F.lit("misread").alias("noise_kind"))).distinct()


def repaired_text(text: str, headings: list[str], fixes: dict[tuple[int, str], str], strays: frozenset = frozenset()) -> str:
    """Continuous paragraphs: misread words corrected, furniture out, divided words joined, lines reflowed.

    fixes: (place in words_of(text), word) -> the word it stands for.
    """
    if fixes or strays:
        out, last = [], 0
        for i, m in enumerate(WHOLE.finditer(text)):
            t = m[0]
            first = (m.start() == 0 or text[m.start() - 1] == "\n") and not t[0].isalnum()
            put = t[0] + without_strays(t[1:], strays) if first and len(t) > 1 else without_strays(t, strays)
            to = fixes.get((i, _word[SPLIT_WORD.sub("", put)])) if fixes else None
            if to is not None:
                put = _fixed(put, to)
            out += [text[last : m.start()], put]
            last = m.end()
        text = "".join(out) + text[last:]
    lines, after_page = [], False
    for raw in text.split("\n"):
        x = raw.strip()
        if is_furniture(x, headings):
            while lines and not lines[-1]:
                lines.pop()
            after_page = True
            continue
        if not x and after_page:
            continue
        if after_page and lines and x and (re.search(r"[.!?]$|[함음임것됨]$", lines[-1]) or MARKED.match(lines[-1])):
            lines.append("")  # a sentence or a list item ends with the page
        after_page = False
        lines.append(x)
    joined = SPLIT_WORD.sub("", "\n".join(lines))
    paragraphs = []
    for block in re.split(r"\n\s*\n", joined):
        flow: list[str] = []
        for line in block.split("\n"):
            if flow and not MARKED.match(line) and "|" not in line and "|" not in flow[-1]:
                flow[-1] += " " + line.strip()
            elif line.strip():
                flow.append(line.strip())
        if flow:
            paragraphs.append("\n".join(flow))
    return re.sub(r"[ \t\xa0]+", " ", "\n\n".join(paragraphs))


def _fixed(token: str, to: str) -> str:
    """The token with its word replaced, its own digits and the punctuation around it kept."""
    token = SPLIT_WORD.sub("", token)
    core = token.strip(EDGE)
    if not core:
        return token
    if len(core) == len(to):  # place by place: a digit, or the digit that a letter was taken for
        mended = "".join(x.translate(AS_DIGITS) if c == "0" else c for c, x in zip(to, core))
    else:
        digits = iter(DIGIT.findall(core))
        mended = "".join(next(digits, c) if c == "0" else c for c in to)
    return token.replace(core, mended, 1)


def repaired_records(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(table_name, record_id, text) of parsed documents and of blocks as continuous readable paragraphs; a block delivered again with another text has a row for each."""
    _, misread, docs, parts, strays = _detected(documents, blocks)
    fixes = misread.groupBy("table_name", "record_id").agg(F.collect_set(F.struct("at", "word", "common")).alias("fixes"))

    def mend(batches):
        for pdf in batches:
            done = [repaired_text(t, [] if h is None else list(h), {(r["at"], r["word"]): r["common"] for r in f} if f is not None else {}, strays) for t, h, f in zip(pdf["text"], pdf["headings"], pdf["fixes"])]
            yield pdf[["table_name", "record_id"]].assign(text=done)

    texts = docs.withColumn("table_name", F.lit("documents")).unionByName(parts.dropDuplicates(["record_id", "text"]).withColumn("table_name", F.lit("blocks")))
    return texts.join(fixes, ["table_name", "record_id"], "left").mapInPandas(mend, "table_name string, record_id string, text string")


def repaired(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, text) of parsed documents alone."""
    return repaired_records(documents, blocks.limit(0)).select(F.col("record_id").alias("document_id"), "text")


def noise_report(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records per table and kind of noise."""
    return noise(documents, blocks).groupBy("table_name", "noise_kind").agg(F.count("*").alias("n_records"))
