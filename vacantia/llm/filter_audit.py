"""Filter interaction audit: what five document filters remove, alone, after one another and in all orders.

Every document gets a mask of the filters it fails, and a part (its language) keeps one count for each mask. All further figures
follow from these 32 counts. The removal game gives a coalition of filters the number of documents that at least one of them
removes. Its Hart-Mas-Colell potential is computed recursively, P(S) = (v(S) + sum of P(S without i)) / |S|, scaled by 60 so that all
values stay whole. A filter's Shapley value is P(all) - P(all without it); a step of an order removes v(S with i) - v(S).

The filters: A, under 200 words (maximal runs of anything but space and \\t \\n \\v \\f \\r); B, distinct words under half of the words;
C, over 3 % of the code points are A to Z; D, one of # $ % & * |; E, the text of a smaller doc_id, anywhere in the table.

A null text is the empty text: it fails A, but neither B nor C nor D, and E like any other text. A null language is the part ''. Rows with
equal doc_id are counted each; none is a copy of the other, as neither doc_id is smaller. A null doc_id has no order: such a row
never fails E and never makes another row fail it; it has no label. A doc_id with several labels counts as good, or toxic, if one of them says so.
An empty table gives no rows. Texts of any length are read whole inside one expression. Extra columns are not read.

On Spark: one pass over the texts leaves a mask and a digest for each row; equal rows and equal texts are counted before each shuffle, so
a text that a third of all rows share is a few rows there. Everything after is as long as the parts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F


FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1
#: Multiple of the potential that is whole for every coalition of five: the least common multiple of 1 to 5.
SCALE = 60
ORDERS = 120
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "[#$%&*|]"
BLANK = r"[\x20\x09-\x0D]+"


def text_failures(documents: DataFrame) -> DataFrame:
    """(part, doc_id, digest, mask): the filters A to D as the bits 1, 2, 4, 8 of the mask."""
    rows = documents.select(
        F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    split = rows.withColumn("words", F.array_remove(F.split("text", BLANK), ""))
    fails = [
        F.size("words") < 200,
        100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        100 * (F.length("text") - F.length(F.translate("text", UPPER, ""))) > 3 * F.length("text"),
        F.col("text").rlike(MARKS),
    ]
    mask = sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))
    return split.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def failure_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, E as bit 16."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    same = text_failures(documents).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    marked = same.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    by_text = marked.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"), least)
    firsts = by_text.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    own = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0) + F.col("unnumbered")
    told = by_text.join(firsts, "digest").withColumn("own", own)
    both = F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    rows = told.select("part", "good", "toxic", F.inline(both))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _removed(what: str) -> Column:
    """The removal game as an array over the 32 coalitions: documents that fail one of its filters."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(what))), F.lit(0)) for s in range(ALL + 1)])


def _without(s: int) -> list[int]:
    return [s & ~(1 << i) for i in range(len(FILTERS)) if s >> i & 1]


def potentials(games: DataFrame) -> DataFrame:
    """Adds ``potential``, SCALE times the potential of each coalition, from ``removed``, one size of coalition after the other."""
    out = games.withColumn("p_0", F.lit(0).cast("bigint"))
    for size in range(1, len(FILTERS) + 1):
        own = [s for s in range(ALL + 1) if s.bit_count() == size]
        total = {s: SCALE * F.col("removed")[s] + sum(F.col(f"p_{t}") for t in _without(s)) for s in own}
        out = out.withColumns({f"p_{s}": F.call_function("div", total[s], F.lit(size).cast("bigint")) for s in own})
    return out.withColumn("potential", F.array(*[f"p_{s}" for s in range(ALL + 1)])).drop(*[f"p_{s}" for s in range(ALL + 1)])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), for each part all 120 orders
    and their five steps. ``shapley`` is the sum of what the step's filter removes over all orders, 120 times its Shapley value."""
    games = failure_counts(documents, labels).groupBy("part").agg(
        F.sum("n").alias("total"), _removed("n").alias("removed"), _removed("good").alias("good"), _removed("toxic").alias("toxic")
    )
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = potentials(games).withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = [F.instr("filter_order", f) for f in FILTERS]
    before = sum((F.when(place < F.col("step"), 1 << i).otherwise(0) for i, place in enumerate(bit)), F.lit(0))
    own = sum((F.when(place == F.col("step"), 1 << i).otherwise(0) for i, place in enumerate(bit)), F.lit(0))
    told = steps.withColumns({"before": before, "own": own})

    def gain(game: str, low: Column, high: Column) -> Column:
        return F.get(game, high) - F.get(game, low)

    low, high, rest = F.col("before"), F.col("before") + F.col("own"), F.lit(ALL) - F.col("own")
    removed = gain("removed", low, high)
    return told.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("removed", high)).alias("kept"), removed.alias("removed"), (F.get("removed", F.col("own")) - removed).alias("redundant"),
        gain("removed", rest, F.lit(ALL)).alias("unique_fails"), gain("good", low, high).alias("good_lost"), gain("toxic", low, high).alias("toxic_lost"),
        (gain("potential", rest, F.lit(ALL)) * (ORDERS // SCALE)).alias("shapley"),
    )
