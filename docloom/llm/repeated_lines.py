"""Lines repeated across one source's documents (problem 4).

Per source, record kind and line key the operator counts the distinct files that hold the
line. A line is repeated when it occurs in at least ``min_files`` files and in at least
``min_share`` of the source's files. Counts live in a ``State`` of written tables; ``loaded`` makes
it, ``merged`` takes in another partition: its lines are appended, what its files counted before is
taken back, lines that cross the threshold are told, and only documents with such lines, or
delivered again, are judged and rebuilt. The registered queries take the tables as two partitions by
time of extraction (``accumulated``), the later one as a delta.

Scale: (doc, key) pairs are made distinct before they are counted, so the only shuffle keys
are (source, kind, doc, key) and then (source, kind, key) with map-side partial counts; a
source holding a third of all rows spreads over its lines, and one hot line reaches the final
count as one partial row per task. Lines and counts are logs to which a merge appends: it rewrites
the table of files and the sizes of sources, one row each, and reads the old lines once. Joins with
a source's size are merged under a salt, so no source is one task. No group is ever collected.

Defined results: rows without doc_id give none; null texts, null sources and lines without a letter give no rows and count
for nothing; a record delivered twice counts once; rows without extraction time belong to the first
partition; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import newest_files, written

BLOCK, FURNITURE = "block", "furniture"
_KEY = ["source", "record", "key"]
#: Share of the block rows, by time of extraction, that the registered queries load before the delta.
FIRST_SHARE = 0.9
#: Parts a source's lines are spread over where they meet the source's size.
SALT = 64


def line_keys(lines: Column) -> Column:
    """Lower case, letters and digits only, each run of digits as one 0; null without any letter. One pass over each line."""
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}]+", ""), r"\p{Nd}+", "0"))
    return F.transform(bare, lambda k: F.when(k != "0", F.when(k.rlike(r"\p{L}"), k)))


def record_lines(blocks: DataFrame, furniture: DataFrame) -> DataFrame:
    """(record, doc_id, page_num, item_id, line_no, key, version) of both record kinds; lines without a letter are left out.

    Only the newest extraction of a file counts, told from (doc_id, time) alone. An extraction
    delivered twice gives its lines twice: counting takes distinct files, results are made distinct
    where rows are few.
    """
    b = blocks.where("doc_id is not null and text is not null").select("doc_id", "page_num", F.col("block_id").alias("item_id"), F.col("extracted_at").alias("version"), F.posexplode(line_keys(F.split("text", "\n"))).alias("line_no", "key"))
    b = newest_files(b.where("key is not null"), "version", blocks.where("text is not null").select("doc_id", F.col("extracted_at").alias("version")))
    f = furniture.where("doc_id is not null").select("doc_id", "page_num", F.col("line_idx").alias("item_id"), F.lit(None).cast("timestamp").alias("version"), F.posexplode(line_keys(F.array("signature"))).alias("line_no", "key"))
    kinds = [df.withColumn("record", F.lit(kind)) for df, kind in ((b, BLOCK), (f.where("key is not null"), FURNITURE))]
    return kinds[0].unionByName(kinds[1]).select("record", "doc_id", "page_num", "item_id", F.col("line_no").cast("bigint").alias("line_no"), "key", "version")


def digest(key: Column) -> Column:
    """128 bits for a key."""
    return F.unhex(F.md5(key))


@dataclass(frozen=True)
class State:
    """Written tables.

    files: doc_id, version, placed, source; one row per file, version the newest extraction with text.
    lines: record, doc_id, page_num, item_id, line_no, key (a digest), version; all delivered ones.
    counts: source, record, key, n_files; signed, to be added up.
    sizes: source, files.
    over: source, record, key of the lines at or over the threshold.
    """

    files: DataFrame
    lines: DataFrame
    counts: DataFrame
    sizes: DataFrame
    over: DataFrame


def _delivered(blocks: DataFrame, furniture: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, lines) of one partition: the newest time of each file's texts, whether it has block rows, and its source."""
    texts = F.max(F.when(F.col("text").isNotNull(), F.col("extracted_at")))
    b = blocks.groupBy("doc_id").agg(texts.alias("version"), F.lit(True).alias("placed"))
    f = furniture.select("doc_id").distinct()
    r = reports.groupBy("doc_id").agg(F.max("source").alias("source"))
    rows = b.unionByName(f, allowMissingColumns=True).unionByName(r, allowMissingColumns=True).where("doc_id is not null")
    files = rows.groupBy("doc_id").agg(F.max("version").alias("version"), F.coalesce(F.bool_or("placed"), F.lit(False)).alias("placed"), F.max("source").alias("source"))
    lines = record_lines(blocks, furniture)
    return files, lines.select("record", "doc_id", "page_num", "item_id", "line_no", digest(F.col("key")).alias("key"), "version")


def standing(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of each file's standing extraction, with the file's source; files without one are left out."""
    known = files.where("source is not null").select("doc_id", "source", F.col("version").alias("_stands"))
    return lines.join(known, "doc_id").where((F.col("record") == FURNITURE) | F.col("version").eqNullSafe(F.col("_stands"))).drop("_stands")


def line_counts(lines: DataFrame) -> DataFrame:
    """(source, record, key, n_files): distinct files holding each standing line."""
    pairs = lines.select("source", "record", "doc_id", "key").distinct()
    return pairs.groupBy("source", "record", "key").agg(F.count(F.lit(1)).alias("n_files"))


def source_sizes(files: DataFrame) -> DataFrame:
    """(source, files): the source's files that have block rows, whatever their text."""
    return files.where("source is not null and placed").groupBy("source").agg(F.count(F.lit(1)).alias("files"))


def _sized(counts: DataFrame, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """Counts with what ``sizes`` has for their source, a source's lines spread over SALT parts."""
    spread = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return counts.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")).join(spread, ["source", "_salt"], how).drop("_salt")


def _over(n: Column, files: Column, min_files: int, min_share: float) -> Column:
    return (n >= min_files) & (n >= files * F.lit(min_share))


def crossing(counts: DataFrame, sizes: DataFrame, min_files: int = 3, min_share: float = 0.1) -> DataFrame:
    """(source, record, key, n_files, files) of the lines at or over the threshold; ``counts`` has one row for each line."""
    return _sized(counts.where(F.col("n_files") >= min_files), sizes).where(_over(F.col("n_files"), F.col("files"), min_files, min_share))


def loaded(blocks: DataFrame, furniture: DataFrame, reports: DataFrame, min_files: int = 3, min_share: float = 0.1) -> State:
    """The state after a first partition."""
    files, lines = _delivered(blocks, furniture, reports)
    files, lines = written(files, "files"), written(lines, "lines")
    counts, sizes = written(line_counts(standing(lines, files)), "counts"), source_sizes(files)
    return State(files, lines, counts, sizes, written(crossing(counts, sizes, min_files, min_share).select(*_KEY), "over"))


def merged(state: State, blocks: DataFrame, furniture: DataFrame, reports: DataFrame | None = None, min_files: int = 3, min_share: float = 0.1) -> tuple[State, DataFrame]:
    """(state after another partition, documents to rebuild).

    Counts of the partition's files are taken back and added as they stand now, so files delivered
    again count once and lines of superseded text not at all; an older extraction changes nothing.
    Rebuilt are the files of the partition and all that hold a line that crossed the threshold.
    Files of which only a report comes, without blocks or furniture, are of the partition too.
    """
    if reports is None:
        reports = state.files.select("doc_id", "source").limit(0)
    new_files, new_lines = _delivered(blocks, furniture, reports)
    new_files, new_lines = written(new_files, "delta-files"), written(new_lines, "delta-lines")
    touched = new_files.select("doc_id")
    old_files = state.files.join(touched, "doc_id", "left_semi")
    both = old_files.unionByName(new_files).groupBy("doc_id").agg(F.max("version").alias("version"), F.bool_or("placed").alias("placed"), F.max("source").alias("source"))
    both = written(both, "delta-files")
    old_lines = written(state.lines.join(touched, "doc_id", "left_semi"), "delta-lines")
    net = _net(line_counts(standing(old_lines.unionByName(new_lines), both)), line_counts(standing(old_lines, old_files)), "n_files")
    counts = written(net.where("n_files <> 0"), "delta-counts")
    grown = _net(source_sizes(both), source_sizes(old_files), "files")
    files = written(state.files.join(touched, "doc_id", "left_anti").unionByName(both), "files")
    changed = written(changed_lines(state, counts, grown, min_files, min_share), "changed")
    over = state.over.join(changed.where("not now"), _KEY, "left_anti").unionByName(changed.where("now").select(*_KEY))
    out = State(files, state.lines.unionByName(new_lines), state.counts.unionByName(counts), source_sizes(files), written(over, "over"))
    return out, written(holding(out, changed).select("doc_id").unionByName(touched).distinct(), "rebuild")


def _net(plus: DataFrame, minus: DataFrame, n: str) -> DataFrame:
    keys = [c for c in plus.columns if c != n]
    return plus.unionByName(minus.withColumn(n, -F.col(n))).groupBy(*keys).agg(F.sum(n).alias(n))


def changed_lines(state: State, counts: DataFrame, sizes: DataFrame, min_files: int = 3, min_share: float = 0.1) -> DataFrame:
    """(source, record, key, now): lines that net ``counts`` and ``sizes`` make cross the threshold, either way.

    Where a source grows only lines that were over the threshold or whose count changes can cross it;
    where it shrinks, because a file's source changed, all its lines are looked at.
    """
    zero = F.lit(0).cast("bigint")
    near = counts.select(*_KEY).unionByName(state.over).distinct().withColumn("_near", F.lit(True))
    shrunk = sizes.where("files < 0").select("source", F.lit(True).alias("_shrunk"))
    rows = _sized(state.counts.join(near, _KEY, "left"), shrunk, "left").where("_near or _shrunk").select(*_KEY, F.col("n_files").alias("old"), zero.alias("new"))
    rows = rows.unionByName(counts.select(*_KEY, zero.alias("old"), F.col("n_files").alias("new")))
    total = rows.groupBy(*_KEY).agg(F.sum("old").alias("old"), F.sum("new").alias("new")).where(F.greatest(F.col("old"), F.col("old") + F.col("new")) >= min_files)
    size = state.sizes.select("source", F.col("files").alias("had"), zero.alias("added")).unionByName(sizes.select("source", zero.alias("had"), F.col("files").alias("added")))
    size = size.groupBy("source").agg(F.sum("had").alias("had"), F.sum("added").alias("added"))
    joined = _sized(total, size)
    was = _over(F.col("old"), F.col("had"), min_files, min_share)
    now = _over(F.col("old") + F.col("new"), F.col("had") + F.col("added"), min_files, min_share)
    return joined.select(*_KEY, was.alias("was"), now.alias("now")).where("was <> now").drop("was")


def holding(state: State, keys: DataFrame) -> DataFrame:
    """The standing lines with one of the (source, record, key) in ``keys``.

    Lines are told by record and key first, so only these meet the table of files.
    """
    near = state.lines.join(keys.select("record", "key").distinct(), ["record", "key"], "left_semi")
    return standing(near, state.files).join(keys, _KEY, "left_semi")


def found_lines(state: State) -> DataFrame:
    """(record, doc_id, page_num, item_id, line_no): every occurrence of a repeated line."""
    return holding(state, state.over).select("record", "doc_id", "page_num", "item_id", "line_no").distinct()


def rebuilt_blocks(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_id, text): the newest blocks without the lines in ``hits``; emptied blocks stay with ''."""
    hit = hits.where(F.col("record") == BLOCK).select("doc_id", "page_num", F.col("item_id").alias("block_id"), "line_no")
    hit = hit.groupBy("doc_id", "page_num", "block_id").agg(F.collect_set("line_no").alias("_hit"))
    b = blocks.where("doc_id is not null and text is not null").select("doc_id", "page_num", "block_id", "text", "extracted_at")
    own = newest_files(b).groupBy("doc_id", "page_num", "block_id").agg(F.max("text").alias("text"))  # an extraction delivered twice
    kept = F.expr("array_join(filter(split(text, '\n'), (l, i) -> not array_contains(_hit, cast(i as bigint))), '\n')")
    return own.join(hit, ["doc_id", "page_num", "block_id"], "left").select("doc_id", "page_num", "block_id", F.when(F.col("_hit").isNull(), F.col("text")).otherwise(kept).alias("text"))


def partitions(blocks: DataFrame, furniture: DataFrame, first_share: float = FIRST_SHARE) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """((blocks, furniture), (blocks, furniture)): the rows of the first partition and of the later one.

    Blocks are parted by time of extraction, furniture goes with its file's first blocks. Results
    don't depend on where the cut lies.
    """
    cut = blocks.agg(F.percentile_approx("extracted_at", first_share)).first()[0]
    late = F.coalesce(F.col("extracted_at") > F.lit(cut), F.lit(False))
    begun = blocks.groupBy("doc_id").agg(F.bool_and(late).alias("_late")).where("_late").select("doc_id")
    return (blocks.where(~late), furniture.join(begun, "doc_id", "left_anti")), (blocks.where(late), furniture.join(begun, "doc_id", "left_semi"))


def accumulated(blocks: DataFrame, furniture: DataFrame, reports: DataFrame, min_files: int = 3, min_share: float = 0.1, first_share: float = FIRST_SHARE) -> tuple[State, State, DataFrame]:
    """(state after the first partition, state after both, documents the second made to rebuild)."""
    first, late = partitions(blocks, furniture, first_share)
    before = loaded(*first, reports, min_files, min_share)
    after, rebuild = merged(before, *late, None, min_files, min_share)
    return before, after, rebuild


def repeated_lines(blocks: DataFrame, furniture: DataFrame, reports: DataFrame, min_files: int = 3, min_share: float = 0.1, first_share: float = FIRST_SHARE) -> DataFrame:
    """(record, doc_id, page_num, item_id, line_no): every occurrence of a repeated line.

    What the first partition gave stands for documents that need no rebuilding; the others are judged anew.
    """
    before, after, rebuild = accumulated(blocks, furniture, reports, min_files, min_share, first_share)
    return _standing_hits(before, after, rebuild)


def _standing_hits(before: State, after: State, rebuild: DataFrame) -> DataFrame:
    """Repeated lines as the first partition has them for documents that need no rebuilding, as both have them for the others; one pass over the lines."""
    keys = before.over.select(*_KEY, F.lit(True).alias("_then"), F.lit(False).alias("_now")).unionByName(after.over.select(*_KEY, F.lit(False).alias("_then"), F.lit(True).alias("_now")))
    keys = keys.groupBy(*_KEY).agg(F.max("_then").alias("_then"), F.max("_now").alias("_now"))
    hits = holding(after, keys.select(*_KEY)).join(keys, _KEY).join(rebuild.withColumn("_again", F.lit(True)), "doc_id", "left")
    stands = F.when(F.col("_again").isNull(), F.col("_then")).otherwise(F.col("_now"))
    return hits.where(stands).select("record", "doc_id", "page_num", "item_id", "line_no").distinct()


def cleaned_blocks(blocks: DataFrame, furniture: DataFrame, reports: DataFrame, min_files: int = 3, min_share: float = 0.1, first_share: float = FIRST_SHARE) -> DataFrame:
    """(doc_id, page_num, block_id, text): every block without its repeated lines; emptied blocks stay with ''.

    Documents are cleaned as the first partition has them, and again only those to rebuild.
    """
    first = partitions(blocks, furniture, first_share)[0][0]
    before, after, rebuild = accumulated(blocks, furniture, reports, min_files, min_share, first_share)
    hits = written(_standing_hits(before, after, rebuild), "hits")
    stays = rebuilt_blocks(first.join(rebuild, "doc_id", "left_anti"), hits)
    return stays.unionByName(rebuilt_blocks(blocks.join(rebuild, "doc_id", "left_semi"), hits))


def repeated_line_table(blocks: DataFrame, furniture: DataFrame, reports: DataFrame, min_files: int = 3, min_share: float = 0.1, first_share: float = FIRST_SHARE) -> DataFrame:
    """(source, record, key, n_files, files): the repeated lines named per source, from the accumulated counts."""
    _, after, _ = accumulated(blocks, furniture, reports, min_files, min_share, first_share)
    totals = after.counts.join(after.over, _KEY, "left_semi").groupBy(*_KEY).agg(F.sum("n_files").alias("n_files"))
    over = written(totals.join(after.sizes, "source"), "crossing")
    lines = record_lines(blocks, furniture).select("record", "key", digest(F.col("key")).alias("_digest"))
    wanted = over.select("record", F.col("key").alias("_digest")).distinct()
    names = lines.join(wanted, ["record", "_digest"], "left_semi").distinct()
    return over.withColumnRenamed("key", "_digest").join(names, ["record", "_digest"]).select("source", "record", "key", "n_files", "files")
