"""Quality rules: word counts of each document, and line frequency across the documents of a host.

Lines are normalised (trimmed, white space collapsed, lower case) and hashed to 64 bits. For each host the distinct
documents with a line are counted; lines in more documents than the limit are removed, and a document that loses most
of its words is rejected as depleted. The limit is a share of the host's rows, but no less than a floor, so that a large
host's ordinary lines stay. DataFrame functions only.

spare_copies (off unless asked for): near copies count as one document, so that a family of thousands of copies, which
shares all its lines, is left to the near-duplicate stage. A document is one of a family if lines within the limit make up
at most 1/9 of its lines and of its words (two documents with s shared lines and r own ones have a Jaccard index of
0.8 where r is 1/9 of s + r); it is known by the line over the limit that stands in the fewest documents, which copies
mostly agree on and boilerplate hardly ever is. Any other document is known by a digest of all its lines within the
limit, whatever the number of lines that it shares. A line is removed where more of these than the limit hold it.

Null and empty texts have no words and fail the base rule; a null host is a host of its own; repeated rows (equal
id and text) count as one document and get equal verdicts; null ids tell documents apart by their text; texts of any
length are read whole; a table without rows gives none; other columns of the input are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.llm.common import SPACE_CLASS, words_of, written
from plexmat.llm.textstats import base_counts, held, worded_lines

#: Frequent lines are broadcast up to this many (24 bytes each); beyond it they are joined by shuffle, lines split over SALTS.
BROADCAST_LINES, SALTS = 500_000, 32
#: A line may stand in this share of a host's documents, and in so many of them in any case.
SHARE, FLOOR = 0.001, 10


def line_hash(line: Column) -> Column:
    """The 64-bit hash of a normalised line."""
    inner = F.regexp_replace(F.lower(line), f"[{SPACE_CLASS}]+", " ")
    return F.xxhash64(F.trim(inner))


def host_key(host: str) -> Column:
    """A host as text that tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def document_lines(docs: DataFrame, host: str, whole: bool = False) -> DataFrame:
    """One row for each line of each document: doc_id, _text_key, _host, _row, _line, _line_words.

    whole: also _all (a digest of the set of its lines), _n_lines (different ones) and _all_words of the document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.xxhash64(text).alias("_text_key"), host_key(host).alias("_host"), F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    hashed = F.transform(worded_lines(F.col("_text")), lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("n")))
    df = held(df, drop=("_text",), _lines=hashed)
    of_all: list[str] = []
    if whole:
        df = held(df, _distinct=F.array_distinct(F.transform("_lines", lambda x: x["h"])))
        digest = F.aggregate("_distinct", F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.xxhash64(h)))
        n_words = F.aggregate("_lines", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        df = held(df, drop=("_distinct",), _all=digest, _n_lines=F.size("_distinct").cast("long"), _all_words=n_words)
        of_all = ["_all", "_n_lines", "_all_words"]
    exploded = df.select("doc_id", "_text_key", "_host", "_row", *of_all, F.inline("_lines"))
    return exploded.select("doc_id", "_text_key", "_host", "_row", *of_all, F.col("h").alias("_line"), F.col("n").alias("_line_words"))


def _limits(docs: DataFrame, host: str, share: float, floor: int) -> DataFrame:
    """_host, _most: in how many documents of a host a line may stand."""
    return docs.groupBy(host_key(host).alias("_host")).agg(F.greatest(F.lit(float(floor)), share * F.count("*")).alias("_most"))


def _over(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """The lines (_host, _line) whose count _n is above their host's limit."""
    return counted.join(limits, "_host").where(F.col("_n") > F.col("_most")).select("_host", "_line")


def _on_lines(rows: DataFrame, lines: DataFrame, few: bool) -> DataFrame:
    """rows joined to lines; a line that very many rows hold is split over SALTS tasks where lines are not broadcast."""
    if few:
        return rows.join(F.broadcast(lines), ["_host", "_line"])
    dealt = lines.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_text_key"), F.lit(SALTS)).cast("int")).join(dealt, ["_host", "_line", "_salt"]).drop("_salt")


def frequent_lines(docs: DataFrame, host: str, share: float, floor: int, spare_copies: bool) -> tuple[DataFrame, DataFrame]:
    """The lines to remove (_host, _line), and a row (_host, _line, doc_id, _text_key, _words) for each document with a candidate line."""
    limits = _limits(docs, host, share, floor)
    often = _over(document_lines(docs, host).groupBy("_host", "_line").agg(F.count("*").alias("_n")), limits)
    often = written(often, "often")
    few = often.count() <= BROADCAST_LINES
    of_all = ("_all", "_n_lines", "_all_words") if spare_copies else ()
    marked = _on_lines(document_lines(docs, host, whole=spare_copies), often, few)
    # A document may hold a line twice, and a repeated row holds it as often again.
    words = (F.sum("_line_words") / F.count_distinct("_row")).alias("_words")
    marked = marked.groupBy("_host", "_line", "doc_id", "_text_key").agg(words, *[F.max(c).alias(c) for c in of_all])
    marked = written(marked, "marked")
    counts = _over(marked.groupBy("_host", "_line").agg(F.count("*").alias("_n")), limits)
    if not spare_copies:
        return written(counts, "over"), marked
    counts = marked.groupBy("_host", "_line").agg(F.count("*").alias("_docs")).join(limits, "_host").where(F.col("_docs") > F.col("_most")).drop("_most")
    shared = _on_lines(marked, counts, few)
    # Doublings of the number, so that lines of one family, edited now and then, are told apart by hash alone.
    rank = F.struct(F.floor(F.log2("_docs")).alias("times"), F.col("_line").alias("line"))
    each = shared.groupBy("_host", "doc_id", "_text_key").agg(
        F.bit_xor(F.xxhash64("_line")).alias("_xor"), F.count("*").alias("_n"), F.sum("_words").alias("_shared_words"), F.min(rank).alias("_low"),
        *[F.max(c).alias(c) for c in of_all], F.collect_list("_line").alias("_lines"),
    )
    family = (9 * (F.col("_n_lines") - F.col("_n")) <= F.col("_n_lines")) & (9 * (F.col("_all_words") - F.col("_shared_words")) <= F.col("_all_words"))
    known_by = F.when(family, F.xxhash64(F.lit("family"), F.col("_low")["line"])).otherwise(F.xxhash64(F.lit("own"), F.col("_all").bitwiseXOR(F.col("_xor"))))
    distinct = each.select("_host", known_by.alias("_known_by"), F.explode("_lines").alias("_line")).distinct()
    over = _over(distinct.groupBy("_host", "_line").agg(F.count("*").alias("_n")), limits)
    return written(over, "over"), marked


def removed_lines(docs: DataFrame, host: str, share: float, floor: int, spare_copies: bool) -> DataFrame:
    """For each document that holds lines over the limit: doc_id, _text_key, _removed (their hashes), _removed_words."""
    over, marked = frequent_lines(docs, host, share, floor, spare_copies)
    hit = _on_lines(marked, over, over.count() <= BROADCAST_LINES)
    return hit.groupBy("doc_id", "_text_key", "_host").agg(F.collect_set("_line").alias("_removed"), F.sum("_words").alias("_removed_words"))


def judge(docs: DataFrame, host: str = "source", share: float = SHARE, floor: int = FLOOR, min_left: float = 0.3, spare_copies: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts, base_failed, removed_words, _removed and kept of every document, with the columns `carry`."""
    tagged = docs.withColumns({"_text_key": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), "_host": host_key(host)})
    counts = base_counts(tagged, ("doc_id", *carry, "_text_key", "_host"))
    lost = removed_lines(docs, host, share, floor, spare_copies)
    # A null id is an id here, so the keys are compared as text that tells it apart.
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("_key")
    lost = lost.select(key, "_text_key", "_host", "_removed", "_removed_words")
    known = counts.withColumn("_key", key).join(lost, ["_key", "_text_key", "_host"], "left")
    removed = F.coalesce(F.round("_removed_words"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - removed) < round(100 * min_left) * F.col("n_words")
    return known.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), removed.alias("removed_words"), "_removed", (~failed & ~depleted).alias("kept"),
    )


def apply_rules(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """docs without the rejected ones, and without the lines over the limit in those that stay; n_chars follows the text."""
    packed = docs.select("doc_id", "text", host, F.struct(*docs.columns).alias("_own"))
    kept = judge(packed, host, carry=("_own",), **options).where("kept")
    text = F.col("_own")["text"]
    without = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("_removed"), line_hash(x))), "\n")
    kept = kept.select(F.when(F.col("removed_words") > 0, without).otherwise(text).alias("_text"), "removed_words", "_own")
    given = {"text": F.col("_text"), "n_chars": F.when(F.col("removed_words") > 0, F.length("_text").cast("long")).otherwise(F.col("_own")["n_chars"]) if "n_chars" in docs.columns else None}
    return kept.select(*[(given[c] if given.get(c) is not None else F.col("_own")[c]).alias(c) for c in docs.columns])


def document_rules(docs: DataFrame, **options) -> DataFrame:
    """One row for each document with its counts and verdict."""
    found = judge(docs.select("doc_id", "text", "source"), **options)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
