"""Deletion of later copies of repeated line runs.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WORD
from .prefix import numbered
from .scratch import Scratch

_DOC = ["doc_id", "body"]
_PLACE = [*_DOC, "idx"]
#: A key with this share of all rows is hot: there are no more than so many of them, and they are joined by broadcast.
HOT = 256
#: Suffixes of one task where neighbours are compared.
RANGE = 1024


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, scratch: Scratch | None = None
) -> DataFrame:
    """Later copies of line runs of `min_words` words or more: doc_id, body (hash of the text), first, last (lines).

    A run is a sequence of lines of one text; blank lines are not part of the
    sequence. A line is in a later copy if a run that holds it also occurs
    earlier, by (doc_id with null last, hash of the text, line), not counting
    lines of that first occurrence itself where the two overlap.

    1. Lines that occur once cut the texts into stretches; those with too few
       words leave, so what follows handles repetitions only.
    2. The suffixes of the stretches, as sequences of line IDs, are sorted by
       prefix doubling: the rank by the first 2k lines comes from the ranks by
       the first k lines and by the k lines after them, until k reaches the
       longest run needed (`min_words` lines at most).
    3. Neighbours in that suffix array have a longest common prefix (LCP). The
       maximal range of neighbours with an LCP of w lines or more is the
       interval of all suffixes that share their first w lines. Each suffix
       asks for the intervals of the shortest runs with words enough that begin
       at its line, or begin there and are the shortest that end at theirs: a
       repeated run, however long, is the union of those inside it.
    4. The first place of an interval stays; the runs at its other places go,
       and lines next to each other that go are one maximal run.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    # repeated rows are one document: each of its lines is numbered once
    lines = scratch.keep(_lines(docs, id_col, text_col).dropDuplicates(_PLACE))
    often = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    lines = _look_up(lines, scratch.keep(often), ["a", "b"], lines.count()).drop("n")

    # stretches of repeated lines with words enough
    in_doc = Window.partitionBy(*_DOC).orderBy("idx")
    lines = lines.withColumn("stretch", F.col("idx") - F.row_number().over(in_doc))
    stretch = Window.partitionBy(*_DOC, "stretch")
    lines = lines.withColumn("all_words", F.sum("words").over(stretch)).where(F.col("all_words") >= min_words)
    ordered = stretch.orderBy("idx")
    upto = F.sum("words").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumn("upto", upto).withColumn("before", upto - F.col("words"))
    # lines of the shortest run with words enough that begins, and that ends, at this line
    ahead = F.count("*").over(stretch.orderBy("before").rangeBetween(0, min_words - 1))
    behind = F.count("*").over(stretch.orderBy("upto").rangeBetween(-(min_words - 1), 0))
    lines = lines.withColumn("ahead", F.when(F.col("all_words") - F.col("before") >= min_words, ahead))
    lines = lines.withColumn("behind", F.when(F.col("upto") >= min_words, behind))
    lines = scratch.keep(lines.select(*_PLACE, "pos", "a", "b", "stretch", "ahead", "behind"))
    longest = lines.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 0

    # runs asked for, by the line they begin at
    runs = lines.select(*_PLACE, F.col("ahead").alias("w")).where("w IS NOT NULL")
    back = lines.where("behind IS NOT NULL")
    back = back.select(*_DOC, (F.col("idx") - F.col("behind") + 1).alias("idx"), F.col("behind").alias("w"))
    runs = runs.unionByName(back).groupBy(*_PLACE).agg(F.collect_set("w").alias("runs"))  # at most min_words of them
    suffixes = _suffix_array(lines, runs, longest, scratch)
    found = scratch.keep(_intervals(_with_lcp(suffixes, scratch)))

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body", "idx")
    first = found.groupBy("w", "interval").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = _look_up(found, scratch.keep(first), ["w", "interval"], found.count()).where(place != F.col("first"))
    same_text = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.body") == F.col("body"))
    start = F.when(same_text, F.greatest("idx", F.col("first.idx") + F.col("w"))).otherwise(F.col("idx"))
    gone = later.select(*_DOC, F.explode(F.sequence(start, F.col("idx") + F.col("w") - 1)).alias("idx")).distinct()
    gone = gone.select(F.col("doc_id").alias("doc_2"), F.col("body").alias("body_2"), F.col("idx").alias("idx_2"))
    gone = lines.select(*_PLACE, "pos").join(gone, F.expr("body = body_2 AND idx = idx_2 AND doc_id <=> doc_2"), "left_semi")
    # lines next to each other (blank ones between them count as theirs) are one run
    gone = gone.distinct().withColumn("island", F.col("idx") - F.row_number().over(in_doc))
    return gone.groupBy(*_DOC, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("island")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    scratch: Scratch | None = None,
) -> DataFrame:
    """`docs` with later copies of repeated line runs deleted from the text.

    All columns of `docs` stay; n_lines, n_removed (lines, blank ones inside a
    deleted run included) and emptied (all words are gone) are added, and
    columns of those names replaced. The first copy of every run stays, as do
    repeated runs of fewer than `min_words` words.

    Null text stays null and empty text empty, with no line removed. A very
    long text is split whole; its lines are rows of their own. A null doc_id
    comes last in the order; of copies with equal ids and different texts the
    one of the smaller text hash is first. Repeated rows of equal id and text are one
    document and stay alike. Empty table: no rows.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words, scratch)
    cuts = runs.groupBy(*_DOC).agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    cuts = cuts.select(F.col("doc_id").alias("cut_id"), F.col("body").alias("cut_body"), "cuts")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "emptied")]
    told = docs.select(F.struct(*keep).alias("row"), F.xxhash64(F.col(text_col)).alias("body_of"))
    told = told.join(
        cuts, (F.col("body_of") == F.col("cut_body")) & F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("cut_id")), "left"
    )
    old, lines = F.col(f"row.{text_col}"), F.split(F.col(f"row.{text_col}"), "\n")
    left = F.filter(
        lines, lambda _, i: ~F.exists("cuts", lambda c: (c["first"] <= i) & (i <= c["last"]))
    )
    removed = F.aggregate("cuts", F.lit(0), lambda n, c: n + c["last"] - c["first"] + 1)
    told = told.withColumn("new", F.when(F.col("cuts").isNull(), old).otherwise(F.array_join(left, "\n")))
    columns = [F.col("new").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in keep]
    return told.select(
        *columns,
        F.when(old.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        (F.col("cuts").isNotNull() & ~F.col("new").rlike(WORD)).alias("emptied"),
    )


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that are not blank: doc_id, body, idx (their number), pos (line), a, b (hashes), words."""
    split = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("body"),
        F.split(F.col(text_col), "\n").alias("all"),
    )
    indexed = F.transform("all", lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    full = F.filter(indexed, lambda x: x["line"].rlike(WORD))
    line = F.col("x.line")
    out = split.select(*_DOC, F.posexplode(full).alias("idx", "x")).select(
        *_PLACE,
        F.col("x.pos").alias("pos"),
        F.xxhash64(line).alias("a"),
        F.xxhash64(F.lit("second"), line, F.length(line)).alias("b"),
        F.regexp_count(line, F.lit(WORD)).alias("words"),
    )
    return out


def _look_up(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` joined with `table` (a row for each key, n: rows of the key), hot keys apart.

    Keys with 1 / HOT of the `total` rows are HOT at most; their few rows of
    `table` are broadcast, so that no task gets all rows of a hot key.
    """
    is_hot = F.col("n") * HOT >= total
    hot = table.where(is_hot)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(~is_hot), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def _rank(pairs: DataFrame, x: str, y: str, scratch: Scratch) -> DataFrame:
    """`pairs` with rank, the order of (x, y): equal for equal pairs."""
    order = pairs.groupBy(x, y).agg(F.count("*").alias("n")).orderBy(x, y)
    order = scratch.keep(order.withColumn("rank_2", F.monotonically_increasing_id()))
    out = scratch.keep(_look_up(pairs, order, [x, y], pairs.count()).drop(x, y, "n").withColumnRenamed("rank_2", "rank"))
    scratch.drop(order)
    return out


def _suffix_array(lines: DataFrame, runs: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """Suffixes at which `runs` begin: doc_id, body, idx, runs, ahead_ids (line IDs, `longest` at most), at (their order).

    A suffix ends with its stretch; a shorter one comes before those it begins.
    """
    first = _rank(lines.select(*_PLACE, "stretch", "a", "b"), "a", "b", scratch)
    now, k = first.drop("stretch"), 1
    while k < longest:
        after = now.select(
            F.col("doc_id").alias("doc_2"), F.col("body").alias("body_2"), (F.col("idx") - k).alias("idx_2"),
            F.col("rank").alias("next"),
        )
        pairs = now.join(after, F.expr("body = body_2 AND idx = idx_2 AND doc_id <=> doc_2"), "left")
        # a missing line is either the end of the text or one that does not recur: both end the stretch
        pairs = scratch.keep(pairs.select(*_PLACE, "rank", F.coalesce("next", F.lit(-1).cast("long")).alias("next")))
        before, now = now, _rank(pairs, "rank", "next", scratch)
        scratch.drop(pairs, *([before] if k > 1 else []))
        k *= 2
    ahead = Window.partitionBy(*_DOC, "stretch").orderBy("idx").rowsBetween(0, max(longest - 1, 0))
    ids = first.select(*_PLACE, F.collect_list("rank").over(ahead).alias("ahead_ids"))
    on = F.expr("body = body_2 AND idx = idx_2 AND doc_id <=> doc_2")
    aside = lambda df: df.withColumnsRenamed({"doc_id": "doc_2", "body": "body_2", "idx": "idx_2"})
    told = now.join(aside(runs), on).drop("doc_2", "body_2", "idx_2").join(aside(ids), on)
    told = told.select(*_PLACE, "rank", "runs", "ahead_ids")
    return numbered(told, [F.col(c) for c in ("rank", *_PLACE)], "at", scratch)


def _with_lcp(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """`suffixes` with lcp, the lines that each shares with the one before it in the array (0 for the first)."""
    # the last suffix of a range is also seen by the next range
    own = F.floor(F.col("at") / RANGE)
    seen = F.when(F.col("at") % RANGE == RANGE - 1, F.array(own, own + 1)).otherwise(F.array(own))
    told = suffixes.withColumn("range", F.explode(seen))
    before = F.lag("ahead_ids").over(Window.partitionBy("range").orderBy("at"))
    n = F.least(F.size("ahead_ids"), F.size("before"))
    same = F.zip_with(F.slice("ahead_ids", F.lit(1), n), F.slice("before", F.lit(1), n), lambda x, y: x == y)
    differs = F.array_position(same, False)
    lcp = F.when(F.col("before").isNull(), 0).when(differs == 0, n).otherwise(differs - 1)
    told = told.withColumn("before", before).where(F.col("range") == own)
    return scratch.keep(told.select(*_PLACE, "runs", "at", lcp.cast("int").alias("lcp")))


def _intervals(suffixes: DataFrame) -> DataFrame:
    """The interval of each run asked for: doc_id, body, idx, w, interval (where in the array it begins).

    Where a suffix shares its first w lines with the one before it, that one
    asks for a run of w lines too, as this depends on those lines alone. So the
    interval begins at the last suffix, of those that ask for w, with an LCP
    below w.
    """
    told = suffixes.select(*_PLACE, "at", "lcp", F.explode("runs").alias("w")).withColumn("range", F.floor(F.col("at") / RANGE))
    begins = F.when(F.col("lcp") < F.col("w"), F.col("at"))
    upto = Window.partitionBy("w", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("begins", begins).withColumn("inner", F.max("begins").over(upto))
    earlier = Window.partitionBy("w").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = told.groupBy("w", "range").agg(F.max("begins").alias("at_end"))  # a row for each range and length
    ends = ends.select("w", "range", F.max("at_end").over(earlier).alias("outer"))
    told = told.join(ends, ["w", "range"])
    return told.select(*_PLACE, "w", F.coalesce("inner", "outer").alias("interval"))
