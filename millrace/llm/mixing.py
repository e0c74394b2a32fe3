"""Mixing sources to target weights: every source gives the words that its weight asks for, some documents several times.

A source's target is its weight's share of all words, but at most ``ceiling`` times the source; what is above goes to the others
by weight until none is above. In order of (ceiling * size / weight) the sources that reach their ceiling come first, so
sums along this order tell which do. Within a source documents are range-sorted by hash-random keys, distributed prefix sums
count the words before each, and the last epoch is cut at the source's exact budget, within a document where it falls there;
earlier epochs take the source whole. Keys depend on ids only, so reruns agree.

Defined results: a null or text without words has size 0 and gives nothing; a null source is a source of its own and comes last;
a source without words has target 0; rows that share an id and size are interchangeable, so that the cut falls in one of
them; a null id is an id; an empty table gives an empty result; further columns are carried, those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.prefix_sums import prefix_sums
from millrace.llm.shared import small_or_shuffled, stash

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, again and again.
WEIGHTS = (5, 2, 1)
#: Times that a source, and so a document, is taken at most.
CEILING = 3
_OWN = ("size", "source_size", "target", "taken", "mix_key")


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long")


def mix_key(id_col: str, seed: str = "mix") -> Column:
    """A hash-random number of 60 bits for each id."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col(id_col).cast("string"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(no_source, name, source_size, target double, budget long) of each (no_source, name, source_size); the budget is the target to the nearest word.

    All sums run over whole numbers, in decimals where products of them need it.
    """
    ordered = prefix_sums(sizes.withColumn("all", F.lit(0)).withColumn("one", F.lit(1).cast("long")), "all", ["no_source", "name"], {"one": "rank"})
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = ordered.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int"))).withColumn("most", ceiling * F.col("source_size"))
    ratio = weighed.withColumn("ratio", F.col("most").cast("decimal(38,18)") / F.col("weight").cast("decimal(20,0)"))
    summed = prefix_sums(ratio.select("all", "ratio", "no_source", "name", "source_size", "weight", "most"), "all", ["ratio", "no_source", "name"], {"most": "given", "weight": "served", "source_size": "words_before"})
    summed = stash(summed, "source-sums")
    whole = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    # what is left for this source and all after it, and their weights: it reaches its ceiling if its share would be as much
    rest, shares = F.col("words") - F.col("given"), F.col("weights") - F.col("served")
    big = lambda c: c.cast("decimal(19,0)")
    judged = summed.crossJoin(F.broadcast(whole)).withColumn("full", big(F.col("most")) * big(shares) <= big(rest) * big(F.col("weight")))
    judged = judged.withColumn("left_words", rest).withColumn("left_weights", shares)
    # the first that doesn't reach its ceiling has what is left for all that don't
    level = judged.where("not full").agg(F.min_by(F.struct("left_words", "left_weights"), F.struct("ratio", "no_source", "name")).alias("level"))
    share = judged.crossJoin(F.broadcast(level)).withColumn("lw", F.col("level.left_words")).withColumn("ls", F.col("level.left_weights"))
    product = big(F.col("lw")) * big(F.col("weight"))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(product.cast("double") / F.col("ls").cast("double"))
    nearest = F.expr("cast((2 * cast(lw as decimal(19,0)) * cast(weight as decimal(19,0)) + ls) div (2 * ls) as bigint)")
    budget = F.when(F.col("full"), F.col("most")).otherwise(nearest)
    return share.select("no_source", "name", "source_size", target.alias("target"), budget.alias("budget"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: str = "mix", with_text: bool = False) -> DataFrame:
    """The input, with its text only if ``with_text``, and ``size``, ``source_size``, ``target``, ``taken`` (words that the mix takes of the row) and ``mix_key``.

    With texts the sort moves these as well, as a shuffled corpus needs; without, only ids and numbers.
    """
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, source_col, *_OWN) and (with_text or c != text_col)]
    source, none = F.coalesce(F.col(f"`{source_col}`"), F.lit("")), F.col(f"`{source_col}`").isNull()
    tied = F.xxhash64(*carried) if carried else F.lit(0).cast("long")
    rows = docs.select(none.alias("no_source"), source.alias("name"), mix_key(f"`{id_col}`", seed).alias("mix_key"), F.col(f"`{id_col}`").alias("id"), word_count(f"`{text_col}`").alias("size"), tied.alias("tied"), F.struct(*carried).alias("row") if carried else F.lit(None).cast("struct<x:int>").alias("row"))
    rows = stash(rows, "mix-rows")
    targets = stash(source_targets(rows.groupBy("no_source", "name").agg(F.sum("size").alias("source_size")), weights, ceiling), "mix-targets")
    # the group is one column for the sort: sources by name, null apart
    grouped = rows.withColumn("group", F.concat(F.when(F.col("no_source"), "1").otherwise("0"), "name"))
    placed = prefix_sums(grouped, "group", ["mix_key", "id", "size", "tied"], {"size": "before"})
    joined = placed.join(small_or_shuffled(targets), ["no_source", "name"])
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    last = F.col("budget") - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(last, F.col("size")))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in (id_col, source_col, *_OWN) and (with_text or c != text_col)]
    return joined.select(F.col("id").alias(id_col), F.when(~F.col("no_source"), F.col("name")).alias(source_col), *own, "size", "source_size", "target", taken.alias("taken"), "mix_key")


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, with ``epoch`` from 0 and ``words_taken``; where the cut falls within a text, its first words joined by one space."""
    mixed = mix_sources(docs, id_col, text_col, source_col, with_text=True, **options).where("taken > 0")
    times = F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))
    out = mixed.withColumn("epoch", F.explode(times)).withColumn("words_taken", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    first = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORDS), F.lit(0)), F.lit(1), F.col("words_taken").cast("int")), " ")
    return out.withColumn(text_col, F.when(F.col("words_taken") < F.col("size"), first).otherwise(F.col(text_col)))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
