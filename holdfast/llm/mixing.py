"""Mixing sources to target weights on a low-discrepancy schedule (operator 11).

A source's documents, shuffled by a hash of id and text, are one stream of words, cut into blocks of
``block_words``. The mix is a row of slots, each of which takes one block of one source:

1. Targets. Sources by code point, null last, weigh ``weights`` in turn and share all words. Where a target
   is above ``most`` times its source's words it stays there, and the rest is shared again by weight.
2. Schedule. A source needs as many slots as its target has blocks; one after the other the sources so fill
   the cumulative interval [first, first + slots) of 0..2^k - 1. Slot i has the van der Corput point
   bitreverse(i) / 2^k and goes to the source in whose interval that point lies; points behind the last
   source are empty slots. Any stretch of slots thus holds every source by its share, and a source gets
   exactly its slots, as the 2^k points are all the multiples of 2^-k.
3. Ranks. Bit reversal is its own inverse, so a source lists its own points. How many slots before i are the
   same source's is a sum over the bits of i (the slots that share i's bits above a set bit and have it clear
   have points in even steps), so slots are ranked without a sort.
4. Join. The slot of rank r takes block r mod blocks in pass r div blocks; the last one only the words the
   target still lacks. Slots and pieces of documents meet by source and block, at most ``most`` slots to a block.

No source is a task of its own: starts in a stream are running sums over ranges of the hash, with one
offset per range, and slots are made 65,536 at a time. All of it is DataFrame functions.

Null texts count as empty; texts without words take no part in the mix and have taken 0. A null source is a source of its own,
other than the empty string. Repeated rows are rows of their own. Null ids count as empty text in the hash.
Of an empty table the result is empty. Only the id, text and source columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.llm.rows import text_of
from holdfast.sources.readers import with_row_position
from holdfast.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RANGE_ROWS = 10_000
SLOTS_AT_ONCE = 1 << 16


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def running_sum(df: DataFrame, value: str, group: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, in order of part, then ``order``.
    A part is one window; of the parts only their totals are summed in a row."""
    totals = df.groupBy(*group, part).agg(F.sum(value).alias("_total"))
    ahead = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, part, F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.join(offsets, [*group, part]) \
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_offset")


# ------------------------------------------------------------------ targets

def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(key, source_size) to one row per source: key, source, source_size, target, goal (whole words)."""
    order = [F.col("key") == "", F.col("key")]
    ranged = with_row_position(sizes.repartitionByRange(*order).sortWithinPartitions(*order), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source") % len(weights) + 1).cast("int"))
    weighed = written(ranged.withColumn("w", weight.cast("decimal(19,0)"))
                      .withColumn("most", (F.col("source_size") * most).cast("decimal(19,0)")), "source-weights")
    row = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    total, share, held = int(row[0] or 0), int(row[1] or 1), -1
    left = total
    while True:  # one row a round; the sources held at their most only grow in number
        above = F.expr(f"w * {left}BD > most * {share}BD")
        row = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("w")))).first()
        if row[0] == held:
            break
        held, left, share = row[0], total - int(row[1] or 0), int(row[2] or 1)
    return weighed.select(
        "key", "source", "source_size",
        F.when(above, F.col("most").cast("double")).otherwise(F.expr(f"CAST(w * {left}BD AS DOUBLE) / {share}D")).alias("target"),
        F.when(above, F.col("most").cast("long")).otherwise(F.expr(f"(2 * w * {left}BD + {share}BD) div {2 * share}BD")).alias("goal"))


# ------------------------------------------------------------------ schedule

def needed(sources: DataFrame, block_words: int) -> DataFrame:
    """Blocks of a source and the slots its goal takes."""
    rest = F.expr(f"(goal % source_size + {block_words - 1}) div {block_words}")
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    whole = sources.where("source_size > 0").withColumn("blocks", blocks)
    return whole.withColumn("slots", F.expr("goal div source_size") * F.col("blocks") + rest)


def reversed_bits(point: Column, bits: int) -> Column:
    if not bits:
        return F.lit(0).cast("long")
    return F.conv(F.reverse(F.lpad(F.bin(point), bits, "0")), 2, 10).cast("long")


def rank_of(bits: int) -> Column:
    """Slots before that of ``point`` whose points lie in [first, first + slots)."""
    def below(limit: str, p: int) -> str:  # multiples of 2^(p + 1), plus point's bits under p, that lie below the limit
        return f"shiftright({limit} - (point & {(1 << p) - 1}L) + {(2 << p) - 1}L, {p + 1})"

    terms = [f"(shiftright(point, {p}) & 1L) * ({below('(first + slots)', p)} - {below('first', p)})" for p in range(bits)]
    return F.expr(" + ".join(terms) or "0L")


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """All slots: slot, source, rank, block, pass, words (that the slot takes of its block)."""
    wanted = needed(sources, block_words).withColumn("part", F.expr("source div 4096"))
    wanted = written(running_sum(wanted, "slots", [], "part", ["source"], "first"), "sources")
    many = int(wanted.agg(F.sum("slots")).first()[0] or 0)
    bits = max(many - 1, 0).bit_length()
    parts = wanted.where("slots > 0").select(
        "*", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOTS_AT_ONCE})")).alias("_part"))
    here = F.expr(f"sequence(_part * {SLOTS_AT_ONCE}, least(slots, (_part + 1) * {SLOTS_AT_ONCE}) - 1)")
    # so many tasks, as the plan's sizes say nothing of the slots that a row becomes
    tasks = max(1, many // (8 * SLOTS_AT_ONCE))
    points = parts.repartition(tasks, "source", "_part").select(
        "source", "first", "slots", "blocks", "goal", "source_size", F.explode(here).alias("point"))
    ranked = points.withColumn("point", F.col("point") + F.col("first")).withColumn("rank", rank_of(bits))
    taken = ranked.select(
        reversed_bits(F.col("point"), bits).alias("slot"), "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"),
        F.expr("rank div blocks").alias("pass"), "goal", "source_size")
    lacking = F.expr(f"goal - pass * source_size - block * {block_words}")
    there = F.expr(f"source_size - block * {block_words}")
    return taken.withColumn("words", F.least(F.lit(block_words), there, lacking).cast("long")).drop("goal", "source_size")


# ------------------------------------------------------------------ the mix

@dataclass(frozen=True)
class Mix:
    """``rows``: every document's place in its source's stream; ``slots``; ``pieces``: what each slot takes."""

    rows: DataFrame     # doc_id, size, hash, source, start, source_size, target, goal
    slots: DataFrame    # slot, source, rank, block, pass, words
    block_words: int

    @property
    def parts(self) -> DataFrame:
        """Documents cut at block edges: doc_id, source, start, size, block, word (first in the document), at (in the block), words."""
        b = self.block_words
        cut = self.rows.where("size > 0").select(
            "*", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        return cut.withColumn("word", F.greatest(F.lit(0), F.col("block") * b - F.col("start"))) \
            .withColumn("at", F.col("start") + F.col("word") - F.col("block") * b) \
            .withColumn("length", F.least(F.col("size") - F.col("word"), b - F.col("at")))

    @property
    def pieces(self) -> DataFrame:
        """The mix in pieces, to be read by slot and ``at``: words ``word`` to ``word + words`` of a document."""
        met = self.parts.join(self.slots.hint("merge"), ["source", "block"]) \
            .withColumn("words", F.least("length", F.col("words") - F.col("at"))).where("words > 0")
        return met.select("slot", "at", "doc_id", "hash", "word", "words", "source", "pass")

    def taken(self) -> DataFrame:
        """Every document with the words the mix takes of it."""
        met = self.parts.join(self.slots.select("source", "block", "words").hint("merge"), ["source", "block"], "left")
        words = F.greatest(F.lit(0), F.least("length", F.coalesce("words", F.lit(0)) - F.col("at")))
        out = ["doc_id", "size", "source_size", "target"]
        # (source, start) names a row: only rows without words share a start
        counted = met.groupBy("source", "start").agg(*[F.any_value(c).alias(c) for c in out], F.sum(words).alias("taken"))
        none = self.rows.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
        return counted.select(*out, "taken").unionByName(none)

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """slot, at, text: the words of every piece, joined by blanks. Read it in order of slot and ``at``."""
        one = docs.select(_hash(id_col, text_col).alias("hash"), text_of(text_col).alias("_text")).dropDuplicates(["hash"])
        words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
        return self.pieces.join(one, "hash").select(
            "slot", "at", F.array_join(F.slice(words, (F.col("word") + 1).cast("int"), F.col("words").cast("int")), " ").alias("text"))


def _hash(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat(text_of(id_col), F.lit(":"), text_of(text_col)).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = 1024) -> Mix:
    """The mix of all documents: see Mix."""
    # one text key per source: "" for null, "s..." for others, in the order of the names
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    narrow = written(docs.select(
        F.col(id_col).alias("doc_id"), key.alias("key"), word_count(text_of(text_col)).alias("size"),
        _hash(id_col, text_col).alias("hash")), "sizes")
    ranges = max(1, -(-narrow.count() // RANGE_ROWS))
    part = F.expr(f"shiftright(CAST(conv(substring(hash, 1, 8), 16, 10) AS BIGINT) * {ranges}L, 32)")
    ranged = narrow.withColumn("part", part)
    sizes = ranged.groupBy("key", "part").agg(F.sum("size").alias("s")).groupBy("key").agg(F.sum("s").alias("source_size"))
    sources = written(targets(sizes, weights, most), "targets")
    # one row per source and range, so that no source's rows meet in one task
    about = ranged.select("key", "part").distinct().join(sources, "key")
    placed = running_sum(ranged, "size", ["key"], "part", ["hash", "doc_id", "size"], "start").join(about, ["key", "part"])
    return Mix(written(placed.drop("key", "part"), "placed"), schedule(sources, block_words), block_words)
