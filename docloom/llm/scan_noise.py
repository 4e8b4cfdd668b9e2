"""Noise in text from scanned pages (problem 1): running lines, broken words, misread characters.

Running lines: a line is a page number when it has the shape of one and, inside the page body, its
value is the page's; it is a repeated title when it is within edit distance of the file's title
(its metadata title or the first body block of the first page). Broken words: a line ends in a
letter and a hyphen and the next line that is not running starts with a letter; evidence for one
word are files with the joined form, evidence for a compound files with the hyphenated form.
Misread words: the *anagram hash* of a word is the sum of its characters' hashes, so a confusion
such as rn for m shifts it by a fixed difference. Rare words and frequent words meet half way: a rare
word is shifted by the difference of each confusion it could hold, a frequent word by none or back by
that of each confusion it could have suffered, and equal hashes are joined in SQL, so two confusions
cost the sum, not the product, of their numbers. Hits are verified by substituting at actual positions
and ranked by frequency. A word that mostly stands on pages that weren't scanned is a word of its own.

Scale: a file's newest extraction, scanned pages and title are joined to its blocks by doc_id, and the
counts per file use that partitioning: texts move twice, once for the vocabulary (words and hyphenated
pairs, counted per file and then summed with map-side combining) and once for the scanned pages. Lines,
running lines and broken words are found inside each row with higher-order functions, without exploding
text. Only distinct words of scanned pages that are rare, and so rare that another word can be their
original, enter the hash join, some ten rows a word; joins are on hashes and words, never within a group.

Defined results: rows without doc_id give none; pages not listed as needing OCR, null texts and null page lists give no rows; the
newest triage and extraction of a file stand; words with characters that are no letters or digits
are not judged, so damage by a wrong encoding is no case; of equally frequent originals the smaller
word is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import newest_files, written

#: What is read, and what stood there.
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("f", "t"), ("t", "f"), ("1", "l"), ("1", "i"), ("5", "s"), ("0", "o"), ("7", "t"), ("8", "b"), ("9", "g"), ("6", "b"), ("2", "z"),
    ("l", "i"), ("i", "l"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("b", "h"), ("h", "b"), ("ii", "u"), ("u", "ii"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"),
    ("q", "g"), ("g", "q"), ("h", "li"), ("li", "h"), ("vv", "w"), ("w", "vv"), ("u", "ll"), ("ll", "u"), ("y", "v"), ("v", "y"), ("n", "u"), ("u", "n"), ("c", "o"), ("o", "c"), ("nn", "m"), ("lc", "k"),
]
#: How many times as many files hold an original as its misreading, at least.
RATIO = 4
#: Least files for an original.
MIN_FILES = 2
#: First block number of page margins.
MARGIN = 1_000_000

_DASH = r"[-\\u2010\\u2011\\u2012\\u2013\\u2014\\u00AC\\u00AD]"
#: Marks where a word was broken; a private-use character.
_BREAK = "\ue000"
#: What parts words: blanks, ASCII punctuation, quotation marks, bullets, dashes, ellipses.
_GAP = r"[\\x00-\\x2F:-@\\[-`{-\\x7F\\s\\u2010-\\u201F\\u2022\\u2026\\u00AB\\u00BB\\u00BF\\u00A1]+"
_LETTERS = r"^[\\p{L}\\p{N}\\x{E000}]+$"

_NUMBER = (
    r"^[-\\u2013\\u2014\\[(|\\s]*(?:(?:p[aou][gqj][eco]|seite|p[aá]gina|strona|стр\\.?|p\\.|pg\\.?)\\s*)?"
    r"([0-9lioszq]{1,4}|[ivxlc1u]{1,7})(?:\\s*(?:/|[oc0a][ft]|von|de|sur|z|из)\\s*[0-9lios]{1,4})?[-\\u2013\\u2014\\])|\\s]*$"
)
#: Roman digits.
_ROMAN = (("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"))


def _roman(n: str) -> str:
    """SQL for the Roman numeral of 1 to 999."""
    digits = [f"element_at(array({', '.join(repr(x) for x in row)}), cast({n} div {10**k} % 10 as int) + 1)" for k, row in enumerate(_ROMAN)]
    return f"concat({digits[2]}, {digits[1]}, {digits[0]})"


def scan_pages(triage: DataFrame) -> DataFrame:
    """(doc_id, scans): the 0-based pages that the newest triage of each file names; files without any are left out."""
    newest = triage.groupBy("doc_id").agg(F.max_by("pages_needing_ocr", F.struct("triaged_at", F.coalesce(F.size("pages_needing_ocr"), F.lit(-1)))).alias("p"))
    pages = newest.select("doc_id", F.array_distinct(F.transform(F.filter("p", lambda p: p.isNotNull()), lambda p: p - 1)).alias("scans"))
    return pages.where("doc_id is not null and size(scans) > 0")


def placed_blocks(blocks: DataFrame, triage: DataFrame, scanned_files: bool) -> DataFrame:
    """(doc_id, page_num, block_id, reading_order, text, scanned) of each file's newest extraction, by doc_id; one delivered twice is there twice.

    ``scanned_files``: only files with scanned pages.
    """
    own = blocks.select("doc_id", "page_num", "block_id", "reading_order", "text", "extracted_at")  # extra columns can't clash
    pages = scan_pages(triage).hint("shuffle_hash")
    own = newest_files(own).where("text is not null").join(pages, "doc_id", "inner" if scanned_files else "left")
    scanned = F.coalesce(F.array_contains("scans", F.col("page_num")), F.lit(False)).alias("scanned")
    return own.select("doc_id", "page_num", "block_id", "reading_order", "text", scanned)


def titles(own: DataFrame, reports: DataFrame) -> DataFrame:
    """(doc_id, titles, title_block): normalised titles of the files of ``own``."""
    first = F.min_by(F.when((F.col("page_num") == 0) & (F.col("block_id") < MARGIN), F.struct("block_id", "text")), F.when((F.col("page_num") == 0) & (F.col("block_id") < MARGIN), F.struct("reading_order", "block_id")))
    files = own.groupBy("doc_id").agg(first.alias("f"))
    meta = reports.groupBy("doc_id").agg(F.max("title").alias("title"))
    # A file without a first page takes the top margin line, unless three files share it: then it is a notice.
    top = own.where(F.col("block_id") == MARGIN).select("doc_id", "page_num", F.regexp_replace("text", r"\s+\d{1,4}$", "").alias("_line"))
    shared = top.select("doc_id", F.lower("_line").alias("_key")).distinct().groupBy("_key").count().where("count >= 3")
    top = top.join(shared, F.lower("_line") == F.col("_key"), "left_anti").groupBy("doc_id").agg(F.min_by("_line", F.struct("page_num", "_line")).alias("top"))
    both = files.join(meta, "doc_id", "left").join(top, "doc_id", "left")
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    body = F.when(~F.col("f.text").contains("\n") & (F.length("f.text") <= 200), norm(F.col("f.text")))
    top_line = F.when(F.col("f").isNull() & F.col("title").isNull(), norm(F.col("top")))
    known = F.array_distinct(F.filter(F.array(norm(F.col("title")), body, top_line), lambda t: t.isNotNull() & (F.length(t) >= 4)))
    return both.select("doc_id", known.alias("titles"), F.col("f.block_id").alias("title_block"))


def scanned_blocks(blocks: DataFrame, triage: DataFrame, reports: DataFrame) -> DataFrame:
    """Blocks on scanned pages with their lines told apart.

    (doc_id, page_num, block_id, text, running, body): whether a line is running, and the other
    lines as one text in which words broken at line ends are joined by a private-use mark.
    """
    own = placed_blocks(blocks, triage, True).where((F.col("scanned")) | (F.col("page_num") == 0) | (F.col("block_id") == MARGIN))
    on = own.where("scanned").dropDuplicates(["doc_id", "page_num", "block_id"]).join(titles(own, reports), "doc_id", "left")
    number = f"regexp_extract(norm, '{_NUMBER}', 1)"
    value = f"translate({number}, 'lioszq', '110529')"
    page = "cast(page_num + 1 as string)"
    is_number = (
        f"(length(norm) <= 24 and norm rlike '{_NUMBER}' and {number} <> '' and (block_id >= {MARGIN} or {value} = {page} or "
        f"replace(translate({number}, '1l', 'ii'), 'u', 'ii') = translate({_roman('abs(page_num + 1)')}, 'l', 'i')))"
    )
    bound = "greatest(2, cast(floor(length(t) * 0.25) as int))"
    near = (
        f"exists(titles, t -> length(norm) between length(t) - {bound} and length(t) + {bound} + 5 and "
        f"(levenshtein(norm, t, {bound}) >= 0 or levenshtein(regexp_replace(norm, '\\\\s+[0-9lios]{{1,4}}$', ''), t, {bound}) >= 0))"
    )
    is_title = f"(coalesce({near}, false) and not (page_num = 0 and block_id <=> title_block))"
    lines = f"transform(transform(split(text, '\\n'), l -> struct(l as line, trim(regexp_replace(lower(l), '\\\\s+', ' ')) as norm)), x -> struct(x.line, ({is_number} or {is_title}) as running))"
    lines = lines.replace("(norm", "(x.norm").replace("and norm rlike", "and x.norm rlike")
    kept = on.selectExpr("doc_id", "page_num", "block_id", "text", f"{lines} as ls").selectExpr(
        "doc_id", "page_num", "block_id", "text", "exists(ls, x -> x.running) as running", "array_join(transform(filter(ls, x -> not x.running), x -> x.line), '\\n') as kept"
    )
    mark = f"regexp_replace(kept, '(?<=[\\\\p{{L}}\\\\p{{N}}]){_DASH}[ \\\\t\\\\r]*\\n[ \\\\t]*(?=\\\\p{{L}})', '{_BREAK}')"
    return kept.selectExpr("doc_id", "page_num", "block_id", "text", "running", f"{mark} as body")


def _runs(text: str) -> Column:
    """Distinct lower-case runs of characters that part no words."""
    return F.expr(f"array_distinct(split(lower({text}), '{_GAP}'))")


def _is_word(name: str) -> Column:
    """Letters and digits only, at least one letter."""
    return F.expr(f"{name} rlike '{_LETTERS}' and {name} rlike '\\\\p{{L}}'")


def _tokens(text: str) -> Column:
    """The runs that are words."""
    return F.expr(f"filter(array_distinct(split(lower({text}), '{_GAP}')), w -> w rlike '{_LETTERS}' and w rlike '\\\\p{{L}}')")


def vocabulary(blocks: DataFrame, triage: DataFrame) -> DataFrame:
    """(word, n_files, n_clean): files that hold each word or hyphenated pair of words, and files that hold it on pages not scanned; written.

    Words broken at line ends are not counted, nor are their fragments; a pair stands within a line.
    """
    whole = F.regexp_replace("text", rf"{_DASH.replace(chr(92) * 2, chr(92))}[ \t\r]*\n[ \t]*(?=\p{{L}})", _BREAK)
    pairs = F.expr(r"if(contains(text, '-'), regexp_extract_all(lower(text), '(?<!\\p{L})\\p{L}++-\\p{L}+', 0), array())")
    own = placed_blocks(blocks, triage, False).select("doc_id", ~F.col("scanned"), F.explode(F.array_distinct(F.concat(F.split(F.lower(whole), _GAP.replace("\\\\", "\\")), pairs)))).toDF("doc_id", "clean", "word")
    per_file = own.groupBy("doc_id", "word").agg(F.max("clean").alias("clean"))
    counted = written(per_file.groupBy("word").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("clean").alias("n_clean")), "vocabulary")
    return counted.where((_is_word("word") & ~F.col("word").contains(_BREAK)) | F.col("word").contains("-"))  # after writing, else each occurrence were judged


def anagram_hash(word: str) -> str:
    """SQL for the order-free hash of a word: 40 bits of each character's hash, added."""
    return f"aggregate(regexp_extract_all({word}, '.', 0), 0L, (a, c) -> a + (xxhash64(c) & 1099511627775L))"


def _confusion_table() -> str:
    """SQL for the confusions with the difference each makes to the hash; only literals, so it is computed once."""
    value = lambda w: " + ".join(f"(xxhash64('{c}') & 1099511627775L)" for c in w)
    return "array(" + ", ".join(f"struct('{m}' as m, '{o}' as o, {value(o)} - ({value(m)}) as d)" for m, o in CONFUSIONS) + ")"


def corrections(words: DataFrame, vocab: DataFrame, ratio: int = RATIO, min_files: int = MIN_FILES) -> DataFrame:
    """(word, original, n_original): the best verified original of each rare word in ``words``; ``vocab`` has words only."""
    most = vocab.agg(F.max("n_files")).first()[0] or 0
    known = words.join(vocab, "word", "left").select("word", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_clean", F.lit(0)).alias("n_clean"))
    rare = known.where((F.length("word") >= 2) & (F.col("n_clean") * 4 <= F.col("n_files")) & (F.col("n_files") * ratio <= most))
    held = rare.selectExpr("*", f"explode(filter({_confusion_table()}, k -> instr(word, k.m) > 0)) as a", f"{anagram_hash('word')} as h")
    probes = held.selectExpr("word", "n_files", "n_clean", "a", "h + a.d as h")
    frequent = vocab.where((F.col("n_files") >= min_files) & (F.length("word") >= 2) & F.col("word").rlike(r"\p{L}{2}"))
    # The confusion undone last leaves its original in the word; none where there is only one.
    none = "struct('' as m, '' as o, 0L as d)"
    suffered = f"explode(concat(array({none}), filter({_confusion_table()}, k -> instr(word, k.o) > 0))) as b"
    targets = frequent.selectExpr("word as original", "n_files as n_original", "n_clean as clean_original", suffered, f"{anagram_hash('word')} as h").withColumn("h", F.expr("h - b.d"))
    hits = probes.join(targets, "h").where(
        (F.col("n_original") >= F.col("n_files") * ratio) & (F.col("n_clean") * 20 <= F.col("clean_original")) & F.expr("b.m = '' or instr(word, b.m) > 0")
    )
    one = lambda w, k, then: (
        f"exists(sequence(1, length({w})), i{k} -> substr({w}, i{k}, length({k}.m)) = {k}.m and "
        + then(f"concat(left({w}, i{k} - 1), {k}.o, substr({w}, i{k} + length({k}.m)))")
        + ")"
    )
    single = one("word", "a", lambda w: f"{w} = original")
    double = one("word", "a", lambda w: one(w, "b", lambda v: f"{v} = original"))
    sure = hits.where(F.expr(f"case when b.m = '' then {single} else {double} end"))
    best = F.min_by(F.struct("original", "n_original"), F.struct(F.when(F.col("b.m") == "", 0).otherwise(1), -F.col("n_original"), "original")).alias("v")
    return sure.groupBy("word").agg(best).select("word", "v.*")


def judged_words(scans: DataFrame, vocab: DataFrame, pairs: DataFrame, ratio: int = RATIO, min_files: int = MIN_FILES) -> DataFrame:
    """(token, word, broken, original): distinct words of scanned pages, judged.

    ``broken`` is true for a word broken at a line end that is normally written without a hyphen;
    ``original`` is what stood there where the word, or a part of a compound, is misread.
    """
    tokens = scans.select(F.explode(_tokens("body")).alias("token")).distinct()
    split = tokens.select("token", F.split("token", _BREAK).alias("parts"), F.regexp_replace("token", _BREAK, "").alias("joined"))
    forms = split.select(F.explode(F.concat(F.array("joined"), "parts")).alias("word")).distinct()
    fixed = written(corrections(forms, vocab, ratio, min_files), "corrections")
    whole = split.where("size(parts) = 1").join(fixed.withColumnRenamed("word", "joined"), "joined").select("token", F.col("joined").alias("word"), F.lit(False).alias("broken"), "original")

    broken_ = split.where("size(parts) > 1").select("token", "joined", F.col("parts")[0].alias("a"), F.element_at("parts", -1).alias("b"))
    broken_ = broken_.withColumn("compound", F.concat_ws("-", "a", "b"))
    roles = ("joined", "a", "b", "compound")
    asked = broken_.select("token", F.explode(F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).alias("word")) for c in roles])).alias("r")).select("token", "r.*")
    counts = vocab.select("word", F.col("n_files").alias("n")).unionByName(pairs.select("word", F.col("n_files").alias("n")))
    told = asked.join(counts, "word", "left").join(fixed, "word", "left")
    of = lambda c, role: F.max(F.when(F.col("role") == role, F.col(c)))
    seen = told.groupBy("token").agg(
        *[of("word", c).alias(c) for c in roles], *[F.coalesce(of("n", c), F.lit(0)).alias(f"n_{c}") for c in roles],
        *[of("original", c).alias(f"o_{c}") for c in roles[:3]], *[F.coalesce(of("n_original", c), F.lit(0)).alias(f"m_{c}") for c in roles[:3]],
    )
    strength = F.greatest("n_joined", "m_joined")
    both = (F.greatest("n_a", "m_a") >= min_files) & (F.greatest("n_b", "m_b") >= min_files)
    broken = F.when(strength + F.col("n_compound") > 0, strength > F.col("n_compound")).otherwise(~both)
    judged = seen.withColumn("broken", broken)
    original = F.when(F.col("broken"), F.col("o_joined")).when(F.col("o_a").isNotNull() | F.col("o_b").isNotNull(), F.concat_ws("-", F.coalesce("o_a", "a"), F.coalesce("o_b", "b")))
    word = F.when(F.col("broken"), F.col("joined")).otherwise(F.col("compound"))
    return whole.unionByName(judged.select("token", word.alias("word"), "broken", original.alias("original")))


def _judged(blocks: DataFrame, triage: DataFrame, reports: DataFrame, ratio: int, min_files: int) -> tuple[DataFrame, DataFrame]:
    scans = written(scanned_blocks(blocks, triage, reports), "scans")  # read by two branches
    counted = vocabulary(blocks, triage)
    pair = F.col("word").contains("-")
    return scans, judged_words(scans, counted.where(~pair), counted.where(pair), ratio, min_files)


def scan_defects(blocks: DataFrame, triage: DataFrame, reports: DataFrame, ratio: int = RATIO, min_files: int = MIN_FILES) -> DataFrame:
    """(doc_id, page_num, block_id, defect): hyphen, misread and running, one row per block and defect."""
    keys = ["doc_id", "page_num", "block_id"]
    scans, judged = _judged(blocks, triage, reports, ratio, min_files)
    words = scans.select(*keys, F.explode(_tokens("body")).alias("token")).join(judged.where("broken or original is not null"), "token")
    parts = [
        scans.where("running").select(*keys, F.lit("running").alias("defect")),
        words.where("broken").select(*keys, F.lit("hyphen").alias("defect")),
        words.where("original is not null").select(*keys, F.lit("misread").alias("defect")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def repaired_blocks(blocks: DataFrame, triage: DataFrame, reports: DataFrame, ratio: int = RATIO, min_files: int = MIN_FILES) -> DataFrame:
    """(doc_id, page_num, block_id, text): continuous paragraphs of the scanned pages.

    Running lines are removed, broken words joined, misread words replaced in their own case and
    the remaining line ends made spaces; blocks of running lines only come out as ''.
    """
    keys = ["doc_id", "page_num", "block_id"]
    scans, judged = _judged(blocks, triage, reports, ratio, min_files)
    fixes = scans.select(*keys, F.explode(_tokens("body")).alias("token")).join(judged, "token")
    one = F.struct((-F.length("token")).alias("k"), "token", F.coalesce("original", "word").alias("to"))
    per = fixes.where("broken or original is not null or word <> token").groupBy(*keys).agg(F.array_sort(F.collect_set(one)).alias("fixes"))
    edge = "(?<![\\\\p{L}\\\\p{N}])"
    swap = lambda pattern, to: f"regexp_replace(acc, '{edge}' || {pattern} || '{edge.replace('<!', '!')}', {to})"
    fixed = (
        "aggregate(coalesce(fixes, array()), body, (acc0, f) -> aggregate(array(struct(f.token as t, f.to as o), struct(upper(left(f.token, 1)) || substr(f.token, 2) as t, upper(left(f.to, 1)) || substr(f.to, 2) as o),"
        " struct(upper(f.token) as t, upper(f.to) as o)), acc0, (acc, g) -> " + swap("g.t", "g.o") + "))"
    )
    joined = scans.join(per, keys, "left").selectExpr(*keys, f"{fixed} as text")
    return joined.selectExpr(*keys, f"trim(regexp_replace(regexp_replace(text, '{_BREAK}', '-'), '\\\\s*\\n\\\\s*', ' ')) as text")
