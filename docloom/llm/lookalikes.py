"""Visually identical text with different characters, brought to one spelling (problem 5).

Confusables skeleton: a text is decomposed, every character is replaced by its prototype from the
look-alike table, and the result is decomposed again. The table is the Unicode confusables data of the
ICU library that comes with Spark. Every distinct original and its consistent spellings are grouped
by skeleton; only originals of groups with several spellings can be cases, and an exact test of the
spelling follows, since a skeleton also makes 1 and l, or m and rn, alike. The consistent spelling is
the canonical composition with compatibility variants, invisible characters and borrowed letters
replaced. Superscripts, subscripts, dashes, quotation marks, genuine Greek symbols and genuine words
of other scripts stay.

A letter of another script can be borrowed when a Latin letter of its case has the same prototype. It
is borrowed when its run of letters also holds Latin letters (a small Greek letter other than omicron:
two of them), or when all letters of the run look Latin and nothing around reads as its script: for a
word, no word of the same block has a letter of that script without Latin look-alike; for a formula,
none of the formula has.

Scale: texts of plain ASCII never leave the JVM (a regular expression on the scan). Of the rest each
distinct text goes to Python once, and the written table of spellings is joined back to the
occurrences; what is neither a case nor tells a script drops out there. The context of a word is a
window over its block, which is bounded. The look-alike table is one of Unicode, some 17,000 entries.

Defined results: rows without doc_id give none; null texts are no cases; the newest extraction of a file stands; each key once.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import newest_files, written

_KEPT_TAGS = ("<super>", "<sub>", "<noBreak> 2010")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_RUN = re.compile(r"[^\W\d_²³¹ªº¼½¾⁰-₟]+")
_BLOCK = ["doc_id", "page_num", "block_id"]


@lru_cache(maxsize=None)
def script(c: str) -> str:
    """The script of a letter by the first word of its name; '' for Latin ones and all other characters."""
    if c.isascii() or not c.isalpha() or "À" <= c <= "ɏ":
        return ""
    name = unicodedata.name(c, "").split(" ")[0]
    return "" if name in ("LATIN", "MODIFIER", "FEMININE", "MASCULINE", "MICRO", "OHM", "KELVIN", "ANGSTROM") else name


@lru_cache(maxsize=4096)
def _plain(c: str) -> str:
    """A character without compatibility variant; what the rules keep stays."""
    if c.isspace() or unicodedata.category(c) == "Zs":
        return " " if c not in "\n\t" else c
    kind = unicodedata.decomposition(c)
    if not kind or kind.startswith(_KEPT_TAGS) or unicodedata.category(c) in ("Pd", "Pi", "Pf") or (kind.startswith("<compat> 0020") and c != "‗"):
        return c
    return unicodedata.normalize("NFKC", c)


def plain_form(text: str) -> str:
    """The text without variants and invisible characters, canonically composed."""
    return unicodedata.normalize("NFC", "".join([_plain(c) for c in _INVISIBLE.sub("", text)]))


@dataclass(frozen=True)
class Lookalikes:
    """prototypes: prototype of each character that has another; latin: the Latin letter for each letter that can be borrowed."""

    prototypes: dict[str, str]
    latin: dict[str, str]

    def skeleton(self, text: str) -> str:
        """Decompose, replace each character by its prototype, decompose again."""
        get = self.prototypes.get
        parts = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        return unicodedata.normalize("NFKD", "".join([" " if c.isspace() else get(c, c) for c in parts]))

    def _symbol(self, c: str) -> bool:
        """A small Greek letter that is a symbol of its own outside Latin words."""
        return script(c) == "GREEK" and c.islower() and c != "ο"

    def latin_form(self, text: str, alone: bool | str) -> str:
        """The text with borrowed letters replaced; ``alone``: also runs that only look Latin, all or those of one script."""
        latin = self.latin

        def fix(m: re.Match) -> str:
            run = m.group()
            scripts = {s for c in run if (s := script(c))}
            if not scripts:
                return run
            n = sum(not script(c) for c in run)
            if n:
                return "".join([c if self._symbol(c) and n < 2 else latin.get(c, c) for c in run])
            name = min(scripts - {"GREEK"}, default="GREEK")
            # A genuine Greek symbol such as the delta of a difference stands before a letter of its own.
            own = [c for c in run if not (script(c) == "GREEK" and self.genuine(c))]
            looks = own and all(c in latin and not self._symbol(c) and (c.isupper() or c.islower()) for c in own)
            if alone in (True, name) and looks and (name != "GREEK" or 1 < len(run) == len(own)):
                return "".join([c if self._symbol(c) else latin.get(c, c) for c in run])
            return run

        return _RUN.sub(fix, text)

    def consistent(self, text: str, alone: bool | str = True) -> str:
        """The one consistent spelling."""
        return self.latin_form(plain_form(text), alone)

    def genuine(self, text: str) -> list[str]:
        """Scripts of which the text has a letter that doesn't look Latin, or a Greek symbol."""
        return sorted({script(c) for c in text if script(c) and (c not in self.latin or self._symbol(c))})

    def borrowed(self, text: str) -> list[tuple[str, str]]:
        """(script, form) of each script whose runs only look Latin, with that script's runs alone replaced."""
        base = self.consistent(text, False)
        if base == self.consistent(text, True):
            return []
        return [(s, form) for s in sorted({script(c) for c in text} - {""}) if (form := self.consistent(text, s)) != base]


#: The table of each application.
_TABLES: dict[str, Lookalikes] = {}


def lookalikes(spark: SparkSession) -> Lookalikes:
    """The look-alike table from the confusables data of the driver's ICU library."""
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        chars = [c for c in map(chr, range(0x21, 0x30000)) if not c.isspace() and unicodedata.category(c)[0] != "C"]
        skeletons = dict(zip(chars, checker.getSkeleton("\n".join(chars)).split("\n"), strict=True))
        given = {c: s for c, s in skeletons.items() if s != unicodedata.normalize("NFD", c)}
        again = lambda s: "".join([given.get(x, x) for x in unicodedata.normalize("NFKD", s)])
        prototypes = {c: again(s) for c, s in given.items()}  # compatibility decomposition can make characters with prototypes
        ascii_ = {(skeletons[c], up): c for c in map(chr, range(0x7F, 0x20, -1)) if c.isalpha() for up in (c.isupper(),)}
        # Letters without case count as what they look like.
        latin = {c: a for c in chars if script(c) and unicodedata.normalize("NFKC", c) == c and (a := ascii_.get((skeletons[c], c.isupper())) if c.isupper() or c.islower() else skeletons[c]) and len(a) == 1 and a.isascii() and a.isalpha()}
        _TABLES[app] = Lookalikes(prototypes, latin)
    return _TABLES[app]


_FORMS = "skeleton string, form string, form_alone string, genuine array<string>, borrowed array<struct<script string, form string>>, members array<struct<skeleton string, spelling string>>"


def spelled(texts: DataFrame) -> DataFrame:
    """``texts`` (text, not plain ASCII) with skeleton, form, form_alone, genuine, borrowed and members: its spellings and their skeletons."""
    shared = texts.sparkSession.sparkContext.broadcast(lookalikes(texts.sparkSession))  # of Unicode, not of the data

    def forms(values: pd.Series) -> pd.DataFrame:
        table = shared.value
        rows = []
        for v in values:
            form, alone, lent = table.consistent(v, False), table.consistent(v, True), table.borrowed(v)
            members = [(table.skeleton(s), s) for s in dict.fromkeys([v, form, alone, *[f for _, f in lent]])]
            rows.append((members[0][0], form, alone, table.genuine(v), [{"script": a, "form": b} for a, b in lent], [{"skeleton": a, "spelling": b} for a, b in members]))
        return pd.DataFrame(rows, columns=["skeleton", "form", "form_alone", "genuine", "borrowed", "members"])

    udf = F.pandas_udf(forms, _FORMS)
    return texts.withColumn("_f", udf("text")).select(*texts.columns, "_f.*")


def _odd(text: str = "text") -> Column:
    return F.col(text).rlike(r"[^\x00-\x7F]")


def ambiguous(spellings: DataFrame) -> DataFrame:
    """The spellings whose skeleton group holds several spellings, or that tell a script."""
    groups = spellings.select(F.inline("members")).distinct().groupBy("skeleton").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("skeleton", F.lit(True).alias("alike"))
    return spellings.drop("members").hint("merge").join(groups, "skeleton", "left").where(F.col("alike") | (F.size("genuine") > 0)).withColumn("alike", F.coalesce("alike", F.lit(False)))


def newest_words(words: DataFrame, odd: bool) -> DataFrame:
    """(doc_id, page_num, block_id, widx, text) of the newest extractions, all or only what isn't plain ASCII; one delivered twice is there twice."""
    w = words.select(*_BLOCK, "widx", "text", "extracted_at")
    return newest_files(w.where(_odd() if odd else F.col("text").isNotNull()), delivered=w).select(*_BLOCK, "widx", "text")


def word_cases(words: DataFrame, spellings: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_id, widx, text, form): words not in the consistent form; ``spellings`` is ``ambiguous``."""
    seen = newest_words(words, True).hint("merge").join(spellings, "text")  # both grow
    around = F.array_distinct(F.flatten(F.collect_set("genuine").over(Window.partitionBy(*_BLOCK))))
    free = F.filter("borrowed", lambda b: ~F.array_contains("_around", b["script"]))
    form = F.when(F.col("text") != F.col("form"), F.col("form")).when(F.size("_free") == 1, F.col("_free")[0]["form"]).when(F.size("_free") > 1, F.col("form_alone"))
    judged = seen.withColumn("_around", around).where("alike").withColumn("_free", free).select(*_BLOCK, "widx", "text", form.alias("form"))
    return judged.where("form is not null").dropDuplicates([*_BLOCK, "widx"])


def formula_cases(formulas: DataFrame, spellings: DataFrame) -> DataFrame:
    """(doc_id, page_num, formula_index, text, form): formulas not in the consistent form; ``spellings`` is ``ambiguous``."""
    keys = ["doc_id", "page_num", "formula_index"]
    seen = formulas.where("doc_id is not null").select(*keys, F.col("source_text").alias("text")).where(_odd()).hint("merge").join(spellings.where("alike"), "text")
    form = F.when(F.array_contains("genuine", "CYRILLIC"), F.col("form")).otherwise(F.col("form_alone"))
    return seen.select(*keys, "text", form.alias("form")).where("text <> form").dropDuplicates(keys)


def all_spellings(words: DataFrame, formulas: DataFrame) -> DataFrame:
    """``ambiguous`` over every distinct text of both tables, written."""
    texts = words.select("text").unionByName(formulas.select(F.col("source_text").alias("text"))).where(_odd()).distinct()
    return written(ambiguous(written(spelled(texts), "spellings")), "alike")


def inconsistent(words: DataFrame, formulas: DataFrame, excluded: DataFrame) -> DataFrame:
    """(record, doc_id, page_num, item_id, widx) of the cases; ``excluded`` blocks give none."""
    spellings = all_spellings(words, formulas)
    w = word_cases(words, spellings).hint("merge").join(excluded.select(*_BLOCK).distinct(), _BLOCK, "left_anti")
    w = w.select(F.lit("word").alias("record"), "doc_id", "page_num", F.col("block_id").alias("item_id"), "widx")
    f = formula_cases(formulas, spellings)
    return w.unionByName(f.select(F.lit("formula").alias("record"), "doc_id", "page_num", F.col("formula_index").alias("item_id"), F.lit(-1).cast("bigint").alias("widx")))


def ascii_skeleton(text: Column, table: Lookalikes) -> Column:
    """The skeleton of plain ASCII text, in the JVM: prototypes are prototypes of themselves, so their order doesn't matter."""
    blank = F.regexp_replace(text, r"[\x09-\x0D\x1C-\x1F]", " ")
    return reduce(lambda acc, c: F.replace(acc, F.lit(c), F.lit(unicodedata.normalize("NFKD", table.prototypes[c]))), sorted(c for c in table.prototypes if c.isascii()), blank)


def skeleton_groups(words: DataFrame) -> DataFrame:
    """(skeleton, form, n_forms, n_words): spellings that look alike, with the most frequent consistent form.

    Words of the newest extractions count, each key once. Counts per spelling come first, so a
    frequent word is one row before its group is formed. Groups are of words with non-ASCII
    characters and of the ASCII words that look like them.
    """
    counts = newest_words(words, False).where("doc_id is not null").dropDuplicates([*_BLOCK, "widx"]).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "spelling-counts")
    odd = written(spelled(counts.where(_odd())).select("text", "n", "form_alone", "skeleton"), "spellings")
    plain = counts.where(~_odd()).withColumns({"form_alone": F.col("text"), "skeleton": ascii_skeleton(F.col("text"), lookalikes(words.sparkSession))})
    plain = plain.join(odd.select("skeleton").distinct(), "skeleton", "left_semi").select("text", "n", "form_alone", "skeleton")
    return odd.unionByName(plain).groupBy("skeleton").agg(F.max_by("form_alone", F.struct("n", "form_alone")).alias("form"), F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_words"))
