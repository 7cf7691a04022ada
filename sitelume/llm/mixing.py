"""Mixing sources to target weights over fixed-length blocks of words.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import numbered, running
from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]"
#: Primes that step through a source's blocks; two of them never both divide a count below 10**18.
STEPS = (1_000_000_007, 1_000_000_009, 1_500_000_001, 1_999_999_973)
#: Bytes of source rows that are broadcast at most; larger tables of sources are joined with salt.
BROADCAST_BYTES, SALTS = 4_000_000, 32
#: Lanes of a mix at most, and units in which surplus draws meet what other sources lack.
MOST_LANES, UNIT = 20_000, 64


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Mix:
    """A mix of `docs`: what each source gives, which blocks are drawn, and the documents they take.

    1. Every source's documents, in a pseudorandom order, form one stream of
       words, cut into blocks of `block_words` (the last may be shorter). A
       document's place in the stream is a prefix sum over lanes of about
       `lane_docs` neighbours in that order, so no task holds a source, and
       copies of one document are spread over lanes like any other rows.
    2. Output shards of `shard_blocks` slots draw multinomial counts of their
       sources, in proportion to the blocks that the targets ask for. Draws
       beyond a source's target go to sources that lack some, so that the
       counts are the multinomial's conditioned on the targets.
    3. The j-th slot of a source maps to a block by a pseudorandom permutation
       of its block indices, another one on each pass through them; slots and
       blocks join by index. A block is thus taken at most `cap` times.

    Sources are a table, of any number; only sums over all of them reach the
    driver. Their targets share the total size by weight: sources by code
    point, null last, take `weights` in turn. A target stops at `cap` times its
    source's size; what is left is shared again by weight among the others,
    until none is above its cap.

    Null text and text without words have size 0 and give nothing. A null
    source is a source, the last one. Null doc_ids and repeated rows are
    documents like any other; ties in the order only swap equal rows. A very
    long text spans many blocks, each drawn by itself. An empty table gives an
    empty mix. Extra columns are dropped unless named in `carry`.
    """

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        carry: tuple[str, ...] = (),
        weights: tuple[float, ...] = (5, 2, 1),
        cap: float = 3.0,
        block_words: int = 128,
        shard_blocks: int = 4096,
        lane_docs: int = 5_000,
        seed: str = "mix",
        scratch: Scratch | None = None,
    ):
        self.spark = docs.sparkSession
        self.scratch = scratch or Scratch(self.spark)
        self.block_words, self.shard_blocks, self.cap, self.seed = block_words, shard_blocks, cap, seed
        self.weights, self.lane_docs = weights, lane_docs
        sized = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            words_in(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("order"),
            F.monotonically_increasing_id().alias("row"),  # fixed, as the table is written
            *[F.col(c).alias(f"carry_{c}") for c in carry],
        )
        self.sized = self.scratch.keep(sized)
        self.sources = self._sources()
        facts = self.sources.agg(
            F.count("*").alias("n"),
            F.sum("docs").alias("docs"),
            F.sum("draws").alias("draws"),
            F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 200).alias("bytes"),
        ).first()
        self.n_sources, self.n_docs, self.n_draws = facts["n"], facts["docs"] or 0, facts["draws"] or 0
        self.small = (facts["bytes"] or 0) <= BROADCAST_BYTES
        self.placed = self._place()

    def _sources(self) -> DataFrame:
        """One row for each source: k (its place in the order), source, source_size, docs, target, blocks, draws, turns."""
        counted = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        named = numbered(counted, [F.col("source").asc_nulls_last()], "k", self.scratch)
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in self.weights]), (F.col("k") % len(self.weights) + 1).cast("int"))
        named = self.scratch.keep(named.withColumn("weight", weight))
        limit = F.lit(float(self.cap)) * F.col("source_size")
        level, total = None, float(named.agg(F.sum("source_size")).first()[0] or 0)
        while True:  # the level rises until no further source is above its cap
            over = F.col("weight") * F.lit(level) > limit if level is not None else F.lit(False)
            sums = named.agg(F.sum(F.when(over, limit)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
            if not sums["free"]:
                break
            after = (total - (sums["capped"] or 0.0)) / sums["free"]
            if level is not None and after <= level:
                break
            level = after
        share = F.col("weight") * F.lit(level or 0.0)
        told = named.withColumn("target", F.when(share > limit, limit).otherwise(share))
        told = told.withColumn("blocks", F.ceil(F.col("source_size") / self.block_words).cast("long"))
        wanted = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)
        draws = F.when(F.col("blocks") > 0, F.least(wanted, F.floor(F.col("blocks") * float(self.cap)))).otherwise(0)
        told = told.withColumn("draws", draws.cast("long")).withColumn("turns", self._turns())
        return self.scratch.keep(told.drop("weight"))

    def _turns(self) -> Column:
        """Step and shift of the permutation of a source's blocks on each pass."""
        primes, blocks = F.array(*[F.lit(p).cast("long") for p in STEPS]), F.col("blocks")

        def turn(number: Column) -> Column:
            key = F.concat_ws(":", F.lit(self.seed), F.col("k").cast("string"), number.cast("string"))
            draw = F.conv(F.substring(F.md5(key), 1, 14), 16, 10).cast("long")
            first = (draw % len(STEPS)).cast("int")
            choice = F.concat(F.slice(primes, first + 1, len(STEPS)), F.slice(primes, F.lit(1), first))
            step = F.element_at(F.filter(choice, lambda p: (blocks == 0) | (blocks % p != 0)), 1)
            return F.struct(step.alias("step"), (draw % F.greatest(blocks, F.lit(1))).alias("shift"))

        return F.transform(F.array(*[F.lit(t) for t in range(math.ceil(self.cap))]), turn)

    def _named(self, docs: DataFrame) -> DataFrame:
        """`docs` (source, row, ...) with k instead of source."""
        names = self.sources.select("k", F.col("source").alias("name"))
        same = F.col("source").eqNullSafe(F.col("name"))
        if self.small:
            return docs.join(F.broadcast(names), same).drop("name", "source")
        # one source may hold a third of all rows
        names = names.withColumn("salt_2", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
        docs = docs.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
        return docs.join(names, same & (F.col("salt") == F.col("salt_2"))).drop("name", "source", "salt", "salt_2")

    def _with_sources(self, rows: DataFrame, *columns: str) -> DataFrame:
        """`rows` (k, ...) with columns of their sources."""
        found = self.sources.select("k", *columns)
        return rows.join(F.broadcast(found) if self.small else found, "k")

    def _place(self) -> DataFrame:
        """Documents with k and [start, start + size), their words' places in their source's stream."""
        docs = self._named(self.sized.select("row", "doc_id", "source", "size", "order"))
        lanes = min(max(1, math.ceil(self.n_docs / self.lane_docs)), MOST_LANES)
        order = ["k", "order", "row"]
        docs = docs.repartitionByRange(lanes, *order).sortWithinPartitions(*order)
        docs = self.scratch.keep(docs.withColumn("at", F.monotonically_increasing_id()))
        # a lane is a partition of the sort; the order of all is that of `at`
        lane, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        docs = docs.withColumn("lane", lane).withColumn("place", place)
        sums = docs.groupBy("k", "lane").agg(F.sum("size").alias("lane_size"))
        sums = running(sums, "lane_size", "lane", "lane_start", ("k",)).drop("lane_size")
        docs = running(docs, "size", "place", "before", ("k", "lane"))
        docs = docs.join(sums, ["k", "lane"]).withColumn("start", F.col("lane_start") + F.col("before"))
        return self.scratch.keep(docs.select("row", "doc_id", "size", "k", "start"))

    def shard_counts(self) -> DataFrame:
        """Draws of each shard: shard, k, first (index of its first slot of the source), n."""
        total = self.n_draws
        # sources lie one after another on a line of `total` units; a slot draws a unit
        line = running(self.sources.where("draws > 0").select("k", "draws"), "draws", "k", "low")
        wide = max(1, total // (4 * max(self.n_sources, 1)))  # cells hold a source or few, or hardly any slot
        cells = F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("low") + F.col("draws") - 1) / wide))
        line = self.scratch.keep(line.withColumn("cell", F.explode(cells)))
        unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(self.seed), F.col("id"))), 1, 12), 16, 10).cast("double")
        slots = self.spark.range(total).select(
            F.floor(F.col("id") / self.shard_blocks).alias("shard"),
            F.least(F.floor(unit / float(1 << 48) * total), F.lit(total - 1)).alias("x"),
        )
        slots = slots.withColumn("cell_2", F.floor(F.col("x") / wide))
        inside = (F.col("x") >= F.col("low")) & (F.col("x") < F.col("low") + F.col("draws"))
        drawn = slots.join(F.broadcast(line) if self.small else line, (F.col("cell") == F.col("cell_2")) & inside)
        drawn = drawn.groupBy("shard", "k").agg(F.count("*").alias("n"))
        drawn = self._with_sources(running(drawn, "n", "shard", "first", ("k",)), "draws")
        kept = F.greatest(F.lit(0), F.least(F.col("n"), F.col("draws") - F.col("first")))
        drawn = self.scratch.keep(drawn.select("shard", "k", "first", "n", kept.alias("kept")))
        own = drawn.where("kept > 0").select("shard", "k", "first", F.col("kept").alias("n"))

        # what sources drew too much of, shard by shard, and what others lack lie on a second line, both from 0 on
        have = drawn.groupBy("k").agg(F.sum("kept").alias("had"))
        lack = self.sources.where("draws > 0").select("k", "draws").join(have, "k", "left").fillna(0, ["had"])
        lack = lack.select("k", "had", (F.col("draws") - F.col("had")).alias("missing")).where("missing > 0")
        over = drawn.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("over")).where("over > 0")
        over, lack = running(over, "over", "shard", "a"), running(lack, "missing", "k", "c")
        units = lambda start, n: F.explode(F.sequence(F.floor(start / UNIT), F.floor((start + n - 1) / UNIT)))
        over = over.withColumn("unit", units(F.col("a"), F.col("over")))
        lack = lack.withColumn("unit", units(F.col("c"), F.col("missing")))
        low = F.greatest("a", "c", F.col("unit") * UNIT)
        high = F.least(F.col("a") + F.col("over"), F.col("c") + F.col("missing"), (F.col("unit") + 1) * UNIT)
        given = over.join(lack, "unit").withColumn("low", low).withColumn("high", high).where("low < high")
        given = given.select("shard", "k", (F.col("had") + F.col("low") - F.col("c")).alias("first"), (F.col("high") - F.col("low")).alias("n"))
        return own.unionByName(given)

    def slots(self) -> DataFrame:
        """Every slot: shard, k, pass (0 on), block (index in the source)."""
        slots = self._with_sources(self.shard_counts(), "blocks", "turns")
        slots = slots.withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
        slots = slots.withColumn("pass", F.floor(F.col("j") / F.col("blocks")).cast("int"))
        turn = F.element_at("turns", F.col("pass") + 1)
        place = F.pmod("j", "blocks").cast("decimal(19)") * turn["step"].cast("decimal(19)")  # needs more than 64 bits
        return slots.select("shard", "k", "pass", ((place + turn["shift"]) % F.col("blocks")).cast("long").alias("block"))

    def taken_blocks(self) -> DataFrame:
        """Joined by index: row (of the document), shard, k, pass, block, words of the document in the block."""
        size = self.block_words
        first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
        pieces = self.placed.where("size > 0").select(
            "row", "k", "start", "size", F.explode(F.sequence(first, last)).alias("block")
        )
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size) - F.greatest(
            F.col("start"), F.col("block") * size
        )
        pieces = pieces.select("row", "k", "block", words.alias("words"))
        # slots come from few rows of counts, so their number can't be told from the plan: never broadcast them
        return self.slots().hint("merge").join(pieces, ["k", "block"])

    def documents(self) -> DataFrame:
        """Every document of the input: doc_id, size, source_size, target, taken (words the mix takes)."""
        taken = self.taken_blocks().groupBy("row").agg(F.sum("words").alias("taken"))
        told = self._with_sources(self.placed.join(taken, "row", "left"), "source_size", "target")
        return told.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def _pieces(self, text: Column) -> Column:
        """The text (columns start and size beside it) cut at the bounds of its source's blocks, the first being shorter.

        Words that stand for those before it in its first block are put in
        front, so that every cut is one of whole blocks, and taken off again.
        """
        lead = (F.col("start") % self.block_words).cast("int")
        padded = F.concat(F.repeat(F.lit("x "), lead), F.regexp_replace(text, f"^{_GAP}+", ""))
        block = f"(?:{WORD}+{_GAP}*+){{1,{self.block_words}}}+"
        return F.transform(
            F.regexp_extract_all(padded, F.lit(block), F.lit(0)),
            lambda piece, i: F.when(i == 0, F.substring(piece, 2 * lead + 1, F.length(piece))).otherwise(piece),
        )

    def texts(self, text_col: str = "text", with_pass: bool = True) -> DataFrame:
        """The mix as texts: for each document and pass the words it takes, in order, with the carried columns.

        A document all of whose blocks are taken comes whole, unchanged.
        `text_col` must be carried. `shard_texts` gives the same words by shard.
        """
        size, text = self.block_words, F.col(f"carry_{text_col}")
        # at most one entry for each block of a document
        got = self.taken_blocks().groupBy("row", "pass").agg(
            F.sum("words").alias("taken"), F.collect_list("block").alias("blocks")
        )
        places = self.placed.where("size > 0").select("row", "size", "start")
        out = self.sized.drop("size", "order").join(got.join(places, "row"), "row")
        first = F.floor(F.col("start") / size)
        # a lambda's variable holds the pieces, so that they are found once and not for each block
        some = F.transform(
            F.array(self._pieces(text)),
            lambda held: F.array_join(F.transform(F.sort_array("blocks"), lambda b: F.get(held, (b - first).cast("int"))), ""),
        )[0]
        out = out.withColumn(f"carry_{text_col}", F.when(F.col("taken") == F.col("size"), text).otherwise(some))
        carried = [c for c in out.columns if c.startswith("carry_")]
        told = ["pass", "taken"] if with_pass else []
        return out.select("doc_id", "source", *told, *[F.col(c).alias(c[6:]) for c in carried])

    def shard_texts(self, text_col: str = "text") -> DataFrame:
        """The mix by output shard, a row for each taken block of a document: shard, k, pass, block, doc_id, text, words."""
        places = self.placed.where("size > 0").select("row", "start", "doc_id")
        told = self.sized.select("row", F.col(f"carry_{text_col}").alias("text")).join(places, "row")
        told = told.select("row", "doc_id", "start", F.posexplode(self._pieces(F.col("text"))).alias("i", "piece"))
        told = told.select("row", "doc_id", (F.floor(F.col("start") / self.block_words) + F.col("i")).alias("block"), "piece")
        taken = self.taken_blocks().join(told, ["row", "block"])
        return taken.select("shard", "k", "pass", "block", "doc_id", F.col("piece").alias("text"), "words")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """`Mix` of `docs`, by document: doc_id, size, source_size, target, taken."""
    return Mix(docs, **options).documents()
