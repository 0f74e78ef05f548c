"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source has a target share of all words; a document of it is taken target / source words times on average. The whole part of
that is taken outright, the rest is a probability. Two documents of a source meet at a time: words move from one to the other,
the direction drawn so that each keeps its expected copies, until one of them has a whole number; the other goes on. What a source
takes in words stays exactly at its target all the while.

Reduction tree: the documents of a source are dealt by hash into chunks of about CHUNK, each a fold over the chunk from the
longest to the shortest (so that what is left over is short); every chunk leaves at most one document that isn't whole, and these meet
in the next level, until one is left per source. It goes to the nearer whole number, so a source misses its target by
at most half of one document. The draws are hashes of the pair, so reruns agree, however rows are partitioned.

Targets: sources in order of their names (code points, null last) weigh cycle[0], cycle[1], ...; together they share 100 % of all
words; no target exceeds `most` times its source, and the excess is shared again by weight until none is above. The level of words
per weight at which that holds is found by aggregates over the table of sources, which stays distributed.

Cases: null or blank texts have no words and are taken 0 times; a source without words has the target 0; null sources are one
source; null and repeated ids and repeated rows are documents of their own (rows equal in source, id and size can stand for each other);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, with_groups

CYCLE, MOST, CHUNK, SEED = (1, 2, 3), 3.0, 128, 11
SOURCE = ["src", "none"]
_HELD = "struct<size:bigint,key:bigint,id:bigint,base:int,p:double>"
_DONE = "array<struct<id:bigint,size:bigint,copies:int>>"


def words(text: str) -> Column:
    """Number of maximal runs of characters other than space and 0x09-0x0D; a word becomes one character, so memory stays near the text's."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"^[\x20\x09-\x0D]++", ""), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", ".")
    return F.length(one).cast("bigint")


def ranked(sources: DataFrame, order: list[Column]) -> DataFrame:
    """sources with column rank from 0, in this order: places within sorted partitions plus the rows before each of them."""
    placed = materialize(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33).alias("part")
    before = placed.groupBy(part).count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("part", F.coalesce("before", F.lit(0)).alias("before"))  # one row per partition
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "place", "before")


def targets(sources: DataFrame, cycle: Sequence[int] = CYCLE, most: float = MOST) -> DataFrame:
    """(src, none, source_size, docs) with column target."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))
    weighed = materialize(ranked(sources, [F.col("none"), F.col("src")]).withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * most).drop("rank"), "sources")
    level, capped = 0.0, -1
    while True:  # each round caps sources that the last level leaves above; the level only rises
        above = F.col("weight") * level > F.col("ceiling")
        r = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("ceiling"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("free"), F.count(F.when(above, 1)).alias("capped")).first()
        if r["capped"] == capped or not r["free"]:
            break
        capped, level = r["capped"], (r["all"] - (r["held"] or 0.0)) / r["free"]
    return weighed.withColumn("target", F.least(F.col("weight") * level, F.col("ceiling"))).drop("weight", "ceiling")


def _uniform(a: str, b: str, seed: int) -> str:
    return f"(pmod(xxhash64({a}, {b}, {seed}L), 9007199254740992L) / 9007199254740992D)"


def _fold(level: int, seed: int) -> str:
    """One chunk, an array of _HELD from the longest: struct of what is still open (h) and the documents decided (done)."""
    done = lambda x, whole: f"array_append(s.done, named_struct('id', {x}.id, 'size', {x}.size, 'copies', {x}.base + {whole}))"
    # words that a and b can still gain (ga, gb) or lose (la, lb)
    pair = "named_struct('ga', (1 - s.h.p) * s.h.size, 'la', s.h.p * s.h.size, 'gb', (1 - x.p) * x.size, 'lb', x.p * x.size)"
    moved = lambda x, change: f"named_struct('size', {x}.size, 'key', {x}.key, 'id', {x}.id, 'base', {x}.base, 'p', least(1D, greatest(0D, {x}.p {change} / {x}.size)))"
    out = lambda h, d: f"named_struct('h', {h}, 'done', {d})"
    up = f"CASE WHEN w.ga <= w.lb THEN {out(moved('x', '- w.ga'), done('s.h', 1))} ELSE {out(moved('s.h', '+ w.lb'), done('x', 0))} END"
    down = f"CASE WHEN w.la <= w.gb THEN {out(moved('x', '+ w.la'), done('s.h', 0))} ELSE {out(moved('s.h', '- w.gb'), done('x', 1))} END"
    u = _uniform("s.h.key", "x.key", seed * 64 + level)
    meet = f"element_at(transform(array({pair}), w -> CASE WHEN {u} * (least(w.ga, w.lb) + least(w.la, w.gb)) < least(w.la, w.gb) THEN {up} ELSE {down} END), 1)"
    first = out("x", "s.done")
    return f"aggregate(chunk, named_struct('h', cast(NULL AS {_HELD}), 'done', cast(array() AS {_DONE})), (s, x) -> CASE WHEN s.h IS NULL THEN {first} ELSE {meet} END)"


def _level(open_: DataFrame, level: int, seed: int, chunk: int) -> DataFrame:
    """open_ (src, none, open: how many of its source, and the fields of _HELD) folded by chunk: columns h and done of _fold."""
    chunks = F.ceil(F.col("open") / chunk).cast("bigint")
    dealt = open_.withColumn("chunk_no", F.pmod(F.xxhash64("key", F.lit(seed * 64 + 32 + level)), chunks)).withColumn("chunks", chunks)
    one = dealt.groupBy(*SOURCE, "chunks", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("size", "key", "id", "base", "p")), asc=False).alias("chunk"))
    return one.select(*SOURCE, "chunks", F.expr(_fold(level, seed)).alias("folded")).select(*SOURCE, "chunks", "folded.h", "folded.done")


def _apart(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per row of rows, those alike in keys numbered in column copy_no; alike rows are counted before they are dealt."""
    block = 4096  # so that no array grows with the rows that are alike by more than a 4096th of them
    counted = rows.groupBy(keys).agg(F.count("*").alias("alike"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("alike") - 1, F.lit(block))))
    return blocks.withColumn("copy_no", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + block, F.col("alike")) - 1))).drop("block", "alike")


def mix(
    docs: DataFrame, cycle: Sequence[int] = CYCLE, most: float = MOST, seed: int = SEED, chunk: int = CHUNK,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies, source; one row per document."""
    source = F.col(source_col).cast("string")
    rows = materialize(docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("none"), words(text_col).alias("size")), "sizes")
    sources = targets(rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), cycle, most)
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    joined = with_groups(_apart(rows, [*SOURCE, "id", "size"]), sources, SOURCE, "docs").withColumn("share", F.when(F.col("size") > 0, share).otherwise(0.0))
    joined = joined.withColumn("base", F.floor("share").cast("int")).withColumn("p", F.col("share") - F.floor("share"))
    joined = materialize(joined.withColumn("key", F.xxhash64(*SOURCE, "id", "size", "copy_no", F.lit(seed))).drop("copy_no", "share"), "shares")

    is_open = F.col("p") > 0
    decided = joined.where(~is_open).select(*SOURCE, "id", "size", F.col("base").alias("copies"))
    open_ = joined.where(is_open).select(*SOURCE, F.col("docs").alias("open"), "size", "key", "id", "base", "p")
    level = 0
    while True:
        folded = materialize(_level(open_, level, seed, chunk), "folded")
        decided = decided.unionByName(folded.select(*SOURCE, F.inline("done")))
        most_chunks = folded.agg(F.max("chunks")).first()[0] or 1
        if most_chunks == 1:
            break
        open_ = folded.where("h IS NOT NULL").select(*SOURCE, F.col("chunks").alias("open"), "h.*")
        level += 1
    last = folded.where("h IS NOT NULL").select(*SOURCE, "h.id", "h.size", (F.col("h.base") + (F.col("h.p") >= 0.5).cast("int")).alias("copies"))
    out = with_groups(decided.unionByName(last), sources, SOURCE, "docs")
    return out.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
        F.when(~F.col("none"), F.col("src")).alias("source"),
    )


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixture itself: rows of docs as often as mix() takes them. Ids must be unique."""
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias("id_"), F.col("copies").alias("copies_"))
    joined = docs.join(copies, F.col(f"`{id_col}`") == F.col("id_"))
    return joined.withColumn("copy_", F.explode(F.sequence(F.lit(1), "copies_"))).select(*(F.col(f"`{c}`") for c in docs.columns))
