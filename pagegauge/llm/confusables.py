"""One consistent form for texts that look the same, after the public model of confusable scripts.

Each letter belongs to a class of look-alikes with one spelling for each script.  The classes are
those of the published table of confusables as the JVM's ICU library holds it (``load_look_alikes``):
letters of several scripts with one skeleton.  For every token the script sets of its letters are
intersected: a token whose letters share a script is spelled in it (the document's own script where
that is among them), which resolves mixed-script tokens and whole-script look-alikes; a token whose
letters share none is spelled letter by letter.  The document's own script is that of its letters
without look-alikes, which is the same for all texts that look the same, so equal forms mean equal
looks.  Remaining forms are normalised: full-width and half-width characters, composed and
decomposed accents, invisible characters, kinds of blanks.

Kept apart, because a reader can see it: letter case, digits, raised, circled and styled letters and
digits, accents, punctuation, symbols, the number of blanks, line breaks, and letters of one script
that resemble each other (a dotless i and an i).  Phonetic letters count as a script of their own.

Defined results: NULL has no form and is in no pair; empty and wholly invisible texts have the
empty form; exact copies are no pair; repeated rows of a document count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.session import cut_lineage

#: which script is taken first where several fit
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "HAN", "HIRAGANA", "KATAKANA")
_PHONETIC = ((0x250, 0x2AF), (0x1D00, 0x1DBF))
_TOKEN = re.compile(r"(?:[^\W\d_]|[̀-ͯⅠ-ⅿ])+")


def script_of(letter: str) -> str:
    """The script that a letter's name begins with; empty for what is no letter."""
    name = unicodedata.name(letter, "")
    if "ROMAN NUMERAL" in name:
        return "ROMAN"
    if unicodedata.category(letter)[0] != "L":
        return ""
    if any(a <= ord(letter) <= b for a, b in _PHONETIC):
        return "PHONETIC"
    return "HAN" if name.startswith("CJK") else name.partition(" ")[0]


def load_look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letter to skeleton, of all letters that share their skeleton with a letter of another script.

    The table is bounded by Unicode, not by the data.  Styled, raised, circled and wide forms are left
    out: a reader sees them, or they are normalised.  Capital I and small l have one skeleton in the
    published table and are told apart here, as letter case counts.
    """
    letters = [chr(c) for c in range(0x41, 0x30000) if not 0xD800 <= c <= 0xDFFF and (unicodedata.category(chr(c))[0] == "L" or unicodedata.category(chr(c)) == "Nl")]
    letters = [c for c in letters if unicodedata.normalize("NFD", c) == c and (d := unicodedata.decomposition(c)) is not None and (not d or d.startswith("<compat>"))]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\x1f".join(letters)).split("\x1f")
    scripts: dict[str, set[str]] = {}
    keys: dict[str, str] = {}
    for c, skeleton in zip(letters, skeletons):
        key = "I" if skeleton == "l" and c.isupper() else skeleton
        keys[c] = key
        scripts.setdefault(key, set()).add(script_of(c))
    return {c: key for c, key in keys.items() if len(scripts[key]) > 1}


_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
_BLANKS = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]


def _simple() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: None for c in _INVISIBLE}
    table.update({c: " " for c in _BLANKS})
    for c in [*range(0xFF01, 0xFFBF), *range(0xFFE0, 0xFFE7)]:
        wide = unicodedata.normalize("NFKC", chr(c))
        if wide != chr(c):
            table[c] = wide
    # half-width sound marks join the letter before them
    table[0xFF9E], table[0xFF9F] = "゙", "゚"
    return table


_SIMPLE = _simple()


class LookAlikes:
    """Forms by a table of look-alike letters (letter to class)."""

    def __init__(self, class_of: dict[str, str]) -> None:
        self.class_of = class_of
        self.spellings: dict[str, dict[str, str]] = {}
        for c in sorted(class_of):
            self.spellings.setdefault(class_of[c], {}).setdefault(script_of(c), c)
        order = {s: i for i, s in enumerate(SCRIPTS)}
        self.rank = lambda script: (order.get(script, len(order)), script)
        self.first = {k: v[min(v, key=self.rank)] for k, v in self.spellings.items()}
        #: what a token must hold to be spelled anew: any look-alike, or one of another script than Latin
        self.member = re.compile(f"[{''.join(map(re.escape, sorted(class_of)))}]") if class_of else re.compile(r"(?!)")
        foreign = [c for c in sorted(class_of) if script_of(c) != "LATIN"]
        self.foreign = re.compile(f"[{''.join(map(re.escape, foreign))}]") if foreign else re.compile(r"(?!)")
        self.scripts: dict[str, str] = {}

    def script(self, letter: str) -> str:
        found = self.scripts.get(letter)
        if found is None:
            found = self.scripts[letter] = script_of(letter)
        return found

    def token_scripts(self, token: str) -> set[str]:
        """The scripts that have all letters of a token, look-alikes included."""
        scripts: set[str] | None = None
        for c in token:
            key = self.class_of.get(c)
            if key is not None:
                have = self.spellings[key].keys()
            else:
                script = self.script(c)
                if not script:
                    continue
                have = {script}
            scripts = set(have) if scripts is None else scripts & have
            if not scripts:
                break
        return scripts or set()

    def own_script(self, text: str) -> str:
        """Script of most letters that can be of one only, by themselves or by their token; Latin where there is none."""
        letters = Counter(text)
        if all(self.script(c) in ("LATIN", "") for c in letters):
            return "LATIN"
        counts: dict[str, int] = {}
        for c, n in letters.items():
            if c not in self.class_of:
                script = self.script(c)
                counts[script] = counts.get(script, 0) + n
        for token, n in Counter(_TOKEN.findall(text)).items():
            if all(c in self.class_of for c in token):
                scripts = self.token_scripts(token)
                if len(scripts) == 1:
                    (script,) = scripts
                    counts[script] = counts.get(script, 0) + n * len(token)
        counts.pop("", None)
        return min(counts, key=lambda s: (-counts[s], self.rank(s))) if counts else "LATIN"

    def spell(self, token: str, own: str) -> str:
        scripts = self.token_scripts(token)
        if not scripts:
            # no script has all letters: each by itself, in the own script where its class has one
            return "".join(c if (k := self.class_of.get(c)) is None or self.script(c) == own else self.spellings[k].get(own, self.first[k]) for c in token)
        chosen = own if own in scripts else min(scripts, key=self.rank)
        return "".join(c if (k := self.class_of.get(c)) is None or self.script(c) == chosen else self.spellings[k][chosen] for c in token)

    def form(self, text: str) -> str:
        """The one form of all texts that look like ``text``."""
        if text.isascii():
            return text
        text = text.translate(_SIMPLE)
        if text.isascii():
            return text
        text = unicodedata.normalize("NFD", text)
        own = self.own_script(text)
        need = self.member if own != "LATIN" else self.foreign
        if need.search(text):
            text = _TOKEN.sub(lambda m: self.spell(m.group(), own) if need.search(m.group()) else m.group(), text)
        return unicodedata.normalize("NFC", text)


def consistent_forms(docs: DataFrame) -> DataFrame:
    """(doc_id, form): the consistent form of each document; NULL stays NULL."""
    table = load_look_alikes(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks = LookAlikes(table)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "form": [None if t is None else looks.form(t) for t in part["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, form string")


def look_alike_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, form, own): hashes of form and text of each document whose form other texts have too.

    Only hashes of forms and texts are shuffled, and forms with one text only, however many copies it
    has, end at the aggregation.
    """
    table = load_look_alikes(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks = LookAlikes(table)
        digest = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
        for part in parts:
            forms, texts = [], []
            for t in part["text"]:
                form = looks.form(t)
                h = digest(t)
                texts.append(h)
                forms.append(h if form is t or form == t else digest(form))
            yield pd.DataFrame({"doc_id": part["doc_id"], "form": forms, "own": texts})

    # written once: 40 bytes a document, read for the forms of interest and for their members
    hashed = cut_lineage(
        docs.select("doc_id", "text")
        .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .mapInPandas(run, "doc_id bigint, form binary, own binary")
    )
    mixed = hashed.groupBy("form").agg(F.min("own").alias("a"), F.max("own").alias("b")).where(F.col("a") != F.col("b")).select("form")
    return hashed.join(mixed, "form", "left_semi").distinct()


def look_alike_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links): the class of each document with look-alikes, and how many different texts look like it.

    The class is named by its smallest doc_id.
    """
    members = cut_lineage(look_alike_texts(docs))
    classes = members.groupBy("form").agg(F.min("doc_id").alias("class_id"), (F.countDistinct("own") - 1).alias("n_links"))
    return members.join(classes, "form").select("doc_id", "class_id", "n_links")


def look_alike_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first, of documents whose different texts have one form.

    Pairs are built between the different texts of a form, and their copies are joined to these by
    text, so exact copies meet only as members of their text.
    """
    members = cut_lineage(look_alike_texts(docs))
    texts = members.select("form", "own").distinct()
    left, right = texts.select("form", F.col("own").alias("own_a")), texts.select("form", F.col("own").alias("own_b"))
    linked = left.join(right, "form").where(F.col("own_a") < F.col("own_b")).select("own_a", "own_b")
    a = members.select(F.col("own").alias("own_a"), F.col("doc_id").alias("a"))
    b = members.select(F.col("own").alias("own_b"), F.col("doc_id").alias("b"))
    pairs = linked.join(a, "own_a").join(b, "own_b")
    return pairs.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()
