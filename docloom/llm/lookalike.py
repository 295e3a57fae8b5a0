"""Visually identical text with different characters.

Method: the tokens of all values form a vocabulary.  Tokens written consistently (their
letters of one script wherever scripts look alike, no ignorable characters, no
presentation forms) are spellings and are kept in tries; every token that shares its
looks with another, or isn't consistent, walks the trie of its shard with a weighted
edit automaton.  A unit may follow every branch that looks like it: look-alikes and
ignorable characters cost nothing, a change of case or of an accent costs MINOR, any
other visible change 1, and the budget is zero.  Of the spellings reached, the cheapest
and then the most frequent is canonical, so a mixed word takes the script that its
vocabulary uses, not the one of the table; a token that reaches none is normalised by
the table.  Tokens are sharded by a hash of their character classes: spellings at cost
zero share all classes, so a shard holds every spelling that can match, and shards stay
even whatever tokens are common.

Results by case: null values stay null and are no case; an empty value is its own
form; blanks keep their number, only their kind changes; letter case and visible
characters are kept; values of any length are treated whole; repeated rows are
separate documents with identical strings, which are no case.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import written

FIELDS = ("title", "source_filename_raw", "source_filename_nfc")
BLANK = r"[\s\x{0085}\p{Z}]"
TOKENS_PER_SHARD = 50_000
SALTS = 4
#: Cost of a change that readers see but may not mind: letter case, an accent.
MINOR = 0.5

# Letters and marks that look like the first character of their line (after NFD and width folding).
LOOKALIKES = """
A ΑАᎪꓮ
B ΒВᏴꓐⲂ
C СϹᏟⅭꓚⲤ
D ᎠⅮꓓ
E ΕЕᎬꓰ
F Ϝꓝ
G ԌᏀꓖ
H ΗНᎻꓧⲎ
I ΙІӀⅠꓲⲒ
J ЈᎫꓙ
K ΚКᏦKꓗⲔ
L ᏞⅬꓡ
M ΜМᎷϺⅯꓟⲘ
N ΝꓠⲚ
O ΟОՕꓳⲞ
P ΡРᏢꓑⲢ
Q Ԛ
R Ꭱꓣ
S ЅՏᏚꓢ
T ΤТᎢꓔⲦ
U Սꓴ
V ѴᏙⅤꓦ
W ԜᎳꓪ
X ΧХⅩꓫⲬ
Y ΥҮУꓬ
Z ΖᏃꓜ
a аɑα
c сϲⅽⲥ
d ԁⅾ
e е
g ɡ
h һ
i іι
j јϳ
l ⅼ
m ⅿ
n ո
o οоօⲟ
p рρⲣ
q ԛ
s ѕ
u υս
v νѵⅴ
w ԝ
x хⅹ
y у
- ‐‑‒–−﹣
· ‧⋅ㆍ・∙•
' ‘’ʼ′
" “”″
: ∶ː
/ ⁄∕
~ ∼〜
, ‚
. ․
| ∣
* ∗
_ ˍ
口 ロ囗
力 カ
工 エ
二 ニ
八 ハ
卜 ト
夕 タ
"""


GROUPS = [line.replace(" ", "", 1) for line in LOOKALIKES.split("\n") if line]
#: Presentation forms, by their own decomposition to one character: width forms, letters in mathematical fonts, radicals.
PRESENTED = {}
for _first, _last in ((0xFF01, 0xFFEE), (0x2100, 0x214F), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEFF), (0xFB20, 0xFB29), (0x2E80, 0x2FD5)):
    for _code in range(_first, _last + 1):
        _kind, _, _to = unicodedata.decomposition(chr(_code)).partition(" ")
        if _kind in ("<wide>", "<narrow>", "<font>", "<compat>") and " " not in _to:
            PRESENTED[_code] = chr(int(_to, 16))


def _table() -> dict[int, str]:
    table = {ord(c): group[0] for group in GROUPS for c in group[1:]}
    for code, plain in PRESENTED.items():
        plain = chr(next(iter({ord(plain)} & PRESENTED.keys()), ord(plain)))
        table[code] = table.get(ord(plain), plain)
    return table


TABLE = _table()
#: Invisible besides the category Cf: variation selectors, joiners and fillers.
FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800, *range(0xFE00, 0xFE10)}


#: Presentation forms alone: look-alikes stay what they are.
FOLD = {code: TABLE[ord(plain)] if ord(plain) in PRESENTED else plain for code, plain in PRESENTED.items()}


@lru_cache(maxsize=100_000)
def ignorable(char: str) -> bool:
    return unicodedata.category(char) in ("Cf", "Cc") or ord(char) in FILLERS


def classes(token: str) -> str:
    """The decomposed character classes of a token, ignorables left out."""
    out = unicodedata.normalize("NFD", token).translate(TABLE)
    out = unicodedata.normalize("NFD", out)  # width folding may give composed characters
    return "".join(c for c in out if not ignorable(c))


def by_table(token: str) -> str:
    return unicodedata.normalize("NFC", classes(token))


@lru_cache(maxsize=100_000)
def script(char: str) -> str:
    """The script of a letter, as the first word of its name; '' for other characters."""
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


#: The scripts whose letters look like a letter.
SCRIPTS = {c: frozenset(script(x) for x in group) for group in GROUPS if group[0].isalpha() for c in group}


def consistent_spelling(token: str) -> bool:
    """Is the token written in composed plain characters, its letters of one script wherever scripts look alike?"""
    if unicodedata.normalize("NFC", token) != token:
        return False
    own, shared = set(), set()
    for c in token:
        if ignorable(c) or ord(c) in PRESENTED or (ord(c) in TABLE and c not in SCRIPTS):
            return False
        if c in SCRIPTS:
            shared.add(c)
        elif c.isalpha():
            own.add(script(c))
    if len({script(c) for c in shared}) > 1 and not all(script(c) in own for c in shared):
        return False
    return all(script(c) in own or not own & SCRIPTS[c] for c in shared)


@lru_cache(maxsize=100_000)
def _class(unit: str) -> str:
    return TABLE.get(ord(unit), unit)


class Trie:
    """Decomposed spellings; a node is a dict of children, its spellings lie under the empty key."""

    def __init__(self):
        self.root: dict = {}

    def add(self, spelling: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", spelling):
            node = node.setdefault(c, {})
        node.setdefault("", []).append((-count, spelling))

    def nearest(self, token: str, budget: float = 0.0) -> str | None:
        """The best spelling within the budget: least cost, then most frequent, then smallest."""
        frontier: dict[int, tuple[dict, float]] = {}

        def reach(step, node, cost):
            if cost <= budget and step.get(id(node), (None, budget + 1))[1] > cost:
                step[id(node)] = (node, cost)
                for c, child in node.items() if cost < budget else ():  # a unit that the token lacks
                    if c:
                        reach(step, child, cost + (MINOR if unicodedata.combining(c) else 1))

        reach(frontier, self.root, 0.0)
        for unit in unicodedata.normalize("NFD", unicodedata.normalize("NFD", token).translate(FOLD)):
            step: dict[int, tuple[dict, float]] = {}
            free, looks = ignorable(unit), _class(unit)
            for node, cost in frontier.values():
                if free:
                    reach(step, node, cost)
                    continue
                for c, child in node.items():
                    if c and (c == unit or _class(c) == looks):
                        reach(step, child, cost)
                    elif c and cost < budget:
                        reach(step, child, cost + (MINOR if c.lower() == unit.lower() or _class(c.lower()) == _class(unit.lower()) else 1))
                if cost < budget:
                    reach(step, node, cost + (MINOR if unicodedata.combining(unit) else 1))
            frontier = step
            if not frontier:
                return None
        ends = [(cost, *min(node[""])) for node, cost in frontier.values() if "" in node]
        return min(ends)[2] if ends else None


def _mark(batches):
    """token, n -> with the hash of its classes; clean where it is spelled consistently."""
    for pdf in batches:
        shape = [zlib.crc32(classes(t).encode("utf-8", "surrogatepass")) for t in pdf["token"]]
        yield pd.DataFrame({"token": pdf["token"], "n": pdf["n"], "clean": [consistent_spelling(t) for t in pdf["token"]], "shape": shape})


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    clean = pdf[pdf["clean"]]
    for t, n in zip(clean["token"], clean["n"]):
        trie.add(t, int(n))
    found = [trie.nearest(t) for t in pdf["token"]]
    spelling = [f if f is not None else t if ok else by_table(t) for t, f, ok in zip(pdf["token"], found, pdf["clean"])]
    return pd.DataFrame({"token": list(pdf["token"]), "spelling": spelling, "in_vocabulary": [f is not None for f in found]})


def _tokens(col):
    return F.split(col, BLANK, -1)


def spellings(values: DataFrame) -> DataFrame:
    """values(value) -> (token, spelling, in_vocabulary) of every token whose canonical spelling is another."""
    counted = values.select(F.explode(_tokens(F.col("value"))).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    marked = written(counted.mapInPandas(_mark, "token string, n long, clean boolean, shape long"), "vocabulary")
    shards = -(-marked.count() // TOKENS_PER_SHARD) or 1
    marked = marked.withColumn("shard", F.pmod(F.xxhash64("shape"), F.lit(shards)))
    several = marked.groupBy("shape").agg(F.count("*").alias("k"), F.min("clean").alias("all_clean")).where("k > 1 or not all_clean").select("shape")
    needed = marked.join(several, "shape", "left_semi")
    return needed.groupBy("shard").applyInPandas(lambda pdf: _resolve(pdf), "token string, spelling string, in_vocabulary boolean").where("token <> spelling")


def canonical_values(values: DataFrame) -> DataFrame:
    """values(value, distinct) -> (value, form): every value in consistent characters."""
    values = written(values.select("value", F.sha2("value", 256).alias("value_key")), "values")
    known = written(spellings(values), "spellings").select("token", "spelling")
    words = values.select("value_key", F.explode(F.array_distinct(_tokens(F.col("value")))).alias("token"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    words = words.withColumn("salt", F.pmod(F.xxhash64("value_key"), F.lit(SALTS)).cast("int"))
    changed = words.join(known.select("token", "spelling", salts), ["token", "salt"]).groupBy("value_key").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("map"))
    put = F.array_join(F.transform(_tokens(F.col("value")), lambda t: F.coalesce(F.try_element_at("map", t), t)), " ")
    return values.join(changed, "value_key", "left").select("value", put.alias("form"))


def _long(documents: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS]))
    return documents.select("doc_id", pairs.alias("x")).select("doc_id", "x.*").where("value is not null")


def forms(documents: DataFrame) -> DataFrame:
    """(doc_id, field_name, value, form) of every non-null value."""
    rows = _long(documents)
    return rows.join(canonical_values(rows.select("value").distinct()), "value").select("doc_id", "field_name", "value", "form")


def consistent(documents: DataFrame) -> DataFrame:
    """Documents' names in one consistent form; nulls stay null."""
    return documents.select("doc_id").join(
        forms(documents).groupBy("doc_id").pivot("field_name", list(FIELDS)).agg(F.first("form")), "doc_id", "left")


def alike_pairs(documents: DataFrame) -> DataFrame:
    """(field_name, doc_id_a, doc_id_b): values that look the same but aren't the same string."""
    rows = written(forms(documents), "forms")
    mixed = rows.groupBy("field_name", "form").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi").select("field_name", "form")
    mine = written(rows.join(mixed, ["field_name", "form"], "left_semi"), "mixed")
    a = mine.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).withColumnsRenamed({"doc_id": "doc_id_a", "value": "va"})
    b = mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"doc_id": "doc_id_b", "value": "vb"})
    return a.join(b, ["field_name", "form", "salt"]).where("doc_id_a < doc_id_b and va <> vb").select("field_name", "doc_id_a", "doc_id_b")


def spelling_report(documents: DataFrame) -> DataFrame:
    """Per field: values, values changed, forms, and forms stored in more than one spelling."""
    rows = forms(documents)
    per = rows.groupBy("field_name", "form").agg(F.count("*").alias("n"), F.sum(F.col("value").eqNullSafe(F.col("form")).cast("int")).alias("same"), (F.min("value") < F.max("value")).alias("mixed"))
    return per.groupBy("field_name").agg(F.sum("n").alias("n_values"), F.sum(F.col("n") - F.col("same")).alias("n_changed"), F.count("*").alias("n_forms"), F.sum(F.col("mixed").cast("int")).alias("n_mixed_forms"))
