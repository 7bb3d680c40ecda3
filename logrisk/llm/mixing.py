"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies, target over
source size. Its whole part is sure; the fraction is rounded in pairs: words
move at random between two documents, in a way that keeps their sum and every
expectation, until one of them has a whole number of copies. The other one
goes on to the next pair. A chunk of documents is rounded by one fold and
leaves at most one open document; the open ones of a source form the chunks of
the next level, so a source of n documents needs log n levels (to the base of
the chunk length), each a shuffle of a chunk length's fewer rows. The words of
a source stay equal to its target up to its one last document.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.llm.common import WORD, same, stored
from logrisk.operators.ordered import Run, row_numbers, running

#: Documents that one fold rounds.
CHUNK = 32
#: A repeated row comes as often as this at most from one entry of a list.
COPIES = 10_000
ENTRY = "struct<u:double,item:struct<doc_id:bigint,source:string,text_key:bigint,nr:bigint,size:bigint,base:bigint>,mass:double,x:double>"
KEYS = ("doc_id", "source", "text_key", "nr")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Words each source should give: source, source_size, n, weight, target.

    sizes: source, source_size, n, one row per source. Sources by code point,
    null last, take the weights in turn and share `share` of all words; a
    target stops at `cap` times its source, and what is above goes to the
    others by weight. That is target = min(cap * size, level * weight), where
    the level comes from running sums over sources ordered by size / weight.
    """
    place = row_numbers(sizes.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "_place")
    turn = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        turn = F.when((F.col("_place") - 1) % len(weights) == k, float(w)).otherwise(turn)
    ranked = stored(
        place.select("source", "source_size", "n", "_place", turn.alias("weight"))
        .withColumn("_top", cap * F.col("source_size"))
        .withColumn("_at", F.col("_top") / F.col("weight")), "mix-sources")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return ranked.select("source", "source_size", "n", "weight", F.lit(0.0).alias("target"))
    sums = running(ranked, [], ["_at", "_place"], [[
        Run("_tops", "sum", F.col("_top")), Run("_weights", "sum", F.col("weight"))]])
    # With all sources before this one at their stop, the others share this level.
    level = (share * total - (F.col("_tops") - F.col("_top"))) / (weight - (F.col("_weights") - F.col("weight")))
    found = sums.select("_at", "_place", level.alias("_level")).where(F.col("_at") >= F.col("_level")) \
        .agg(F.min_by("_level", F.struct("_at", "_place"))).first()[0]
    target = F.col("_top") if found is None else F.least(F.col("_top"), found * F.col("weight"))
    return ranked.select("source", "source_size", "n", "weight", target.alias("target"))


def _uniform(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / float(1 << 53)


def _fold(items: Column) -> Column:
    """Rounds a list of (u, item, mass, x): struct(open, done), `done` with x 0 or 1."""
    entry = ENTRY
    start = F.struct(F.lit(None).cast(entry).alias("open"), F.array().cast(f"array<{entry}>").alias("done"))

    def with_x(e: Column, x: Column) -> Column:
        return F.struct(e["u"].alias("u"), e["item"].alias("item"), e["mass"].alias("mass"), x.alias("x"))

    def pair(acc: Column, new: Column) -> Column:
        a, b = acc["open"], new
        up = F.least(a["mass"] * (1 - a["x"]), b["mass"] * b["x"])
        down = F.least(a["mass"] * a["x"], b["mass"] * (1 - b["x"]))
        moved = F.when(new["u"] * (up + down) < down, up).otherwise(-down)
        # Which of the two became whole is decided by the masses, not by rounded sums.
        a_whole = F.when(moved > 0, a["mass"] * (1 - a["x"]) <= b["mass"] * b["x"]) \
            .otherwise(a["mass"] * a["x"] <= b["mass"] * (1 - b["x"]))
        b_whole = F.when(moved > 0, b["mass"] * b["x"] <= a["mass"] * (1 - a["x"])) \
            .otherwise(b["mass"] * (1 - b["x"]) <= a["mass"] * a["x"])
        ax = F.when(a_whole, F.when(moved > 0, 1.0).otherwise(0.0)).otherwise(a["x"] + moved / a["mass"])
        bx = F.when(b_whole, F.when(moved > 0, 0.0).otherwise(1.0)).otherwise(b["x"] - moved / b["mass"])
        none = F.array().cast(f"array<{entry}>")
        done = F.concat(acc["done"], F.when(a_whole, F.array(with_x(a, ax))).otherwise(none),
                        F.when(b_whole, F.array(with_x(b, bx))).otherwise(none))
        still = F.when(~a_whole, with_x(a, ax)).when(~b_whole, with_x(b, bx))
        return F.struct(still.alias("open"), done.alias("done"))

    def step(acc: Column, new: Column) -> Column:
        return F.when(acc["open"].isNull(), F.struct(new.alias("open"), acc["done"].alias("done"))) \
            .otherwise(pair(acc, new))

    return F.aggregate(items, start, step)


def _numbered(items: DataFrame) -> DataFrame:
    """A row with a number from 1 for each of the m rows that an item stands for."""
    first = F.col("block") * COPIES + 1
    each = F.explode(F.sequence(first, F.least(F.col("m"), first + (COPIES - 1)))).alias("nr")
    few = items.where(F.col("m") <= COPIES).withColumn("block", F.lit(0).cast("long"))
    many = items.where(F.col("m") > COPIES).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES))))
    many = many.repartition("doc_id", "source", "text_key", "block")
    return few.unionByName(many).select("doc_id", "source", "text_key", "size", each)


def decide(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
           seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """Copies for every document: one row per row of docs.

    docs: doc_id, text, source (further columns are not read). Result: doc_id,
    source, text_key, nr, size, copies, source_size, target, weight. Rows that
    repeat in doc_id, source and text are told apart by a number nr from 1 and
    each rounded on its own. Null or blank texts have size 0 and are rounded
    each on their own. The random numbers are hashes of the row, its number and
    the seed: reruns agree.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(F.col("text")).alias("text_key"), words(F.col("text")).alias("size"))
    items = rows.groupBy("doc_id", "source", "text_key").agg(
        F.count(F.lit(1)).alias("m"), F.max("size").alias("size"))
    items = stored(items, "mix-items")
    sizes = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    goals = stored(targets(sizes, weights, share, cap), "mix-targets")
    most = goals.agg(F.max("n")).first()[0] or 0

    ratio = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    ratio = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).otherwise(ratio)
    ratio = F.when(F.col("source_size") == 0, 0.0).otherwise(ratio)
    start = _numbered(items).alias("i").join(goals.alias("g"), same("i", "g", "source")).select(
        F.struct(*[F.col(f"i.{c}") for c in (*KEYS, "size")], F.floor(ratio).alias("base")).alias("item"),
        F.col("size").cast("double").alias("mass"),
        (ratio - F.floor(ratio)).alias("x"), F.col("n"))
    hashed = [F.col("item")[c] for c in KEYS]
    sure = (F.col("mass") == 0) | (F.col("x") == 0)
    alone = start.where(sure).select("item", (_uniform(*hashed, F.lit(seed)) < F.col("x")).cast("double").alias("x"))
    decided, still, level = [alone], start.where(~sure), 0
    while most:
        n_chunks = F.ceil(F.col("n") / float(chunk))
        entry = F.struct(_uniform(*hashed, F.lit(seed + 2 * level + 1)).alias("u"), "item", "mass", "x")
        folded = still.groupBy(
            F.col("item.source").alias("_source"),
            F.pmod(F.xxhash64(*hashed, F.lit(seed + 2 * level + 2)), n_chunks).alias("_chunk"),
        ).agg(F.array_sort(F.collect_list(entry)).alias("_items"), F.max(n_chunks).alias("n"))
        folded = folded.select("n", _fold(F.col("_items")).alias("f"))
        level_rows = folded.select("n", F.explode(F.concat(
            F.transform(F.col("f.done"), lambda e: F.struct(F.lit(False).alias("left"), e.alias("e"))),
            F.when(F.col("f.open").isNull(), F.array().cast(f"array<struct<left:boolean,e:{ENTRY}>>"))
            .otherwise(F.array(F.struct(F.lit(True).alias("left"), F.col("f.open").alias("e")))))).alias("r"))
        level_rows = stored(level_rows.select("n", "r.left", "r.e.*"), f"mix-level-{level}")
        decided.append(level_rows.where(~F.col("left")).select("item", "x"))
        still = level_rows.where("left").select("item", "mass", "x", "n")
        most = ceil(most / chunk) if most > chunk else 0
        level += 1
    decided.append(still.select("item", (_uniform(*hashed, F.lit(seed + 2 * level + 1)) < F.col("x")).cast("double").alias("x")))
    picks = decided[0]
    for more in decided[1:]:
        picks = picks.unionByName(more)
    picks = picks.select("item.*", "x").select(
        *KEYS, "size", (F.col("base") + F.col("x").cast("long")).alias("copies"))
    decisions = picks.alias("p").join(goals.alias("g"), same("p", "g", "source")).select(
        *[f"p.{c}" for c in KEYS], "p.size", "p.copies", "g.source_size", "g.target", "g.weight")
    return stored(decisions, "mix-decisions")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    See `decide`; an empty table gives no rows.
    """
    return decide(docs, **options).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, all columns, each repeated as often as the mix takes it.

    Rows that repeat in doc_id, source and text may differ in other columns;
    which of them has which number is decided by a hash of the whole row.
    """
    decisions = decide(docs, **options)
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text")).alias("text_key"))
    repeated = decisions.where("nr = 2").select(*KEYS[:3])
    single = keyed.withColumn("nr", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        again = same("k", "m", *KEYS[:3])
        single = keyed.alias("k").join(repeated.alias("m"), again, "left_anti").withColumn("nr", F.lit(1).cast("long"))
        more = stored(keyed.alias("k").join(repeated.alias("m"), again, "left_semi").withColumn(
            "_order", F.xxhash64("_row")).withColumn("_id", F.monotonically_increasing_id()), "mix-repeated")
        single = single.unionByName(row_numbers(more, list(KEYS[:3]), ["_order", "_id"], "nr").drop("_order", "_id"))
    taken = single.alias("r").join(decisions.where("copies > 0").alias("d"), same("r", "d", *KEYS))
    return taken.select("r._row", F.explode(F.sequence(F.lit(1), F.col("d.copies").cast("int")))).select("_row.*")
