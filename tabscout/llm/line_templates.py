"""Line deduplication by a log-template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.session import materialise

#: Fixed patterns: white space inside a line, and a token that holds a digit.
SPACE, FIELD = r"[\x09-\x0D\x20]+", r"[^\x09-\x0D\x20]*[0-9][^\x09-\x0D\x20]*"
#: A text without any of these has lines that are single-spaced and without fields already.
UNEVEN = r"[0-9\x09\x0B-\x0D]|  "
#: A lookup of fewer leaves than this is broadcast, a longer one is shuffled.
SMALL_LOOKUP = 2_000_000


def _masked(line):
    """The line with single spaces and its variable-looking tokens as one wildcard."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, FIELD, "<*>"), SPACE, " "))


def _lines(docs: DataFrame, lead: int) -> DataFrame:
    exploded = docs.withColumn("uneven", F.rlike("text", F.lit(UNEVEN))).select(
        "doc_id", "row", "uneven", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # The filter is on the plain line: one on the masked line would mask it twice.
    masked = exploded.where(F.trim("line") != "").select(
        "doc_id", "row", "line_no",
        F.when(F.col("uneven"), _masked(F.col("line"))).otherwise(F.trim("line")).alias("masked"))
    # Tree path: number of tokens, then the leading tokens.
    count = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "))) + 1
    return masked.withColumn(
        "leaf", F.xxhash64(count, F.substring_index("masked", " ", lead)))


def _templates(variants: DataFrame, lead: int, similar: float, levels: int,
               min_docs: int) -> DataFrame:
    """Lines (leaf, masked, docs) with the template they belong to: (leaf, masked, template).

    Each level takes, in every node, the line that most documents hold, the greater text
    among equals, as the node's template. Lines that equal it in enough of the tokens after the
    leading ones are its instances, their other tokens its variable fields. The rest goes on
    to child nodes by the first place and token in which it differs. At the bottom a line
    is a template of its own. Nodes too rare to recur are left out.
    """
    done, at = None, variants.withColumn("node", F.col("leaf"))
    for level in range(levels):
        total = at.groupBy("node").agg(
            F.sum("docs").alias("seen"), F.max(F.struct("docs", "masked")).alias("top"))
        ahead = total.where(F.col("seen") >= min_docs).select("node", F.col("top.masked").alias("leader"))
        a, b = F.split("masked", " "), F.split("leader", " ")
        rest = F.size(a) - lead
        differs = F.filter(
            F.transform(F.arrays_zip(a.alias("a"), b.alias("b")),
                        lambda p, i: F.when(p["a"] != p["b"], F.struct(i.alias("i"), p["a"].alias("t")))),
            lambda d: d.isNotNull())
        judged = materialise(at.join(ahead, "node").withColumn("differs", differs).select(
            "node", "leaf", "masked", "docs",
            (F.size("differs") <= F.floor((1 - similar) * F.greatest(rest, F.lit(0)) + 1e-9)).alias("fits"),
            F.get("differs", F.lit(0)).alias("first")))
        fits = judged.where("fits").select("leaf", "masked", F.col("node").alias("template"))
        done = fits if done is None else done.union(fits)
        at = judged.where("NOT fits").select(
            "leaf", "masked", "docs", F.xxhash64("node", "first.i", "first.t").alias("node"))
        if level + 1 < levels and at.limit(1).count() == 0:
            return done
    return done.union(at.where(F.col("docs") >= min_docs).select(
        "leaf", "masked", F.xxhash64("node", "masked").alias("template")))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, lead: int = 5, similar: float = 0.8,
                         levels: int = 3, key: str = "doc_id", text: str = "text",
                         keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text[, kept]): every row without its recurring lines.
    ``kept`` is a struct of the columns in ``keep``, if there are any.

    Lines end at line feeds. A line's tokens stand between white space; a token with a digit
    is a variable field. A tree of fixed depth, by token count, ``lead`` leading tokens and
    ``levels`` splits, groups lines into templates; a line fits a template if at most a
    share 1 - ``similar`` of the tokens after the leading ones differ. A template found in at least
    ``min_docs`` documents recurs: its first line stays, in the order of key and line,
    and all others are dropped. Lines without tokens are never dropped.

    Null text has no lines and stays null. Rows that are equal in key and text share their
    decisions, so they count as one document and keep the same lines; null keys come first. An
    empty table gives no rows; other columns are ignored.

    Lines of leaves that too few documents reach leave early, by counts of hashes alone, so the text
    of a document is shuffled once, at the end. Counts are folded before every shuffle:
    a line that a third of all documents hold arrives as one row of each task.
    """
    carried = [F.struct(*keep).alias("kept")] if keep else []
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *carried).withColumn(
        "row", F.xxhash64("doc_id", "text"))
    lines = _lines(rows, lead)
    frequent = materialise(lines.groupBy("leaf").agg(F.count_distinct("row").alias("docs")).where(
        F.col("docs") >= min_docs).select("leaf"))
    if frequent.count() <= SMALL_LOOKUP:
        frequent = F.broadcast(frequent)
    alive = materialise(lines.join(frequent, "leaf"))
    alive = alive.where("masked <> ''")
    variants = alive.groupBy("leaf", "masked").agg(F.count_distinct("row").alias("docs"))
    template = materialise(_templates(variants, lead, similar, levels, min_docs))
    place = F.struct("doc_id", "row", "line_no")
    of = materialise(alive.join(template, ["leaf", "masked"]).select("template", place.alias("place")))
    recurring = of.groupBy("template").agg(
        F.count_distinct("place.row").alias("docs"), F.min("place").alias("first")).where(
        F.col("docs") >= min_docs)
    dropped = of.join(recurring, "template").where("place <> first").groupBy(
        F.col("place.row").alias("row")).agg(F.collect_set("place.line_no").alias("gone"))
    split = F.split("text", "\n")
    n = F.coalesce(F.size(split), F.lit(0))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), gone)
    return rows.join(dropped, "row", "left").select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        F.when(F.size(gone) == 0, F.col("text")).otherwise(
            F.array_join(F.transform(kept, lambda i: split[i]), "\n")).alias("text"),
        *(["kept"] if keep else []))
