"""Secret scan with linking of credentials that come in several parts.

Base kinds are found by their patterns alone. Weak candidates (a bare key id, a
bare random string, an address) are common in clean text, so each is reported
only when the parts that complete it stand in the same scope. Scopes are
intervals of a text: sections between empty lines, sections of ini files,
innermost blocks of braces. Parts are points, and an interval join over
buckets of position finds the scopes that each part stands in.

Places come from running sums over the lengths of what lies between matches:
windows over rows, so a text with very many matches costs no more for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logrisk.llm.common import same, stored

#: The base kinds in their order, patterns and least lengths.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Weak kinds: they count only beside parts that complete them. What must occur is looked for in the run itself.
KEY_ID = r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,}+(?![A-Za-z0-9])"
RANDOM = (r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{24})(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])"
          r"[A-Za-z0-9+/]{24,}+={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = r"(?i)\b(?:https?|s3|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@%-]+"

KINDS = ["assign", "access", "hex", "id", "random", "endpoint"]
WEAK = 3
#: Scopes: what ends a section, the first line of an ini section, a block of braces.
BREAK, HEADER, BRACES = r"\n[\x20\t\r]*\n", r"(?m)^\[[^\[\]\n]+\][\x20\t\r]*$", r"\{[^{}]*\}"
SECTION, INI, BLOCK = 10, 11, 12
#: Code points of a bucket of the interval join.
BUCKET = 4096

KEY = ["doc_id", "text_key"]
LENGTHS = "array<struct<between:int,whole:int,kept:int>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Lengths of the leftmost non-overlapping matches and of what lies between, in code points; null if none.

    The last entry has what follows the last match, and a match of no length.
    """
    def lengths(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.length(p))

    whole = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    kept = whole if not group else lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    zipped = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("between"), whole.alias("whole"), kept.alias("kept"))
    return F.when(F.rlike(text, F.lit(pattern)), zipped.cast(LENGTHS))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, weak, scopes: lengths around the matches of each pattern, in one pass over the texts.

    base, weak: arrays by kind, null where nothing matches. Scopes are looked
    for only in texts with weak candidates. size is the length of the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text.alias("text"))
    text = F.col("text")
    found = rows.select(
        *KEY, "text", F.length("text").alias("size"),
        F.array(_matches(text, ASSIGN[0], 2), _matches(text, ACCESS), _matches(text, HEX)).alias("base"),
        F.array(_matches(text, KEY_ID), _matches(text, RANDOM), _matches(text, ENDPOINT)).alias("weak"))
    some = F.exists("weak", lambda w: w.isNotNull())
    scopes = F.array(_matches(text, BREAK), _matches(text, HEADER), _matches(text, BRACES))
    return found.select(*KEY, "size", "base", "weak", F.when(some, scopes).alias("scopes"))


def _placed(rows: DataFrame, lengths: str, first: int) -> DataFrame:
    """doc_id, text_key, size, kind, n, start, end, kept: a row for each match, and one for what follows the last."""
    kinds = rows.select(*KEY, "size", F.posexplode(lengths).alias("kind", "found")).where("found is not null")
    each = kinds.select(*KEY, "size", (F.col("kind") + first).alias("kind"), F.posexplode("found").alias("n", "x"))
    whole = F.coalesce("x.whole", F.lit(0))
    end = F.sum((F.col("x.between") + whole).cast("long")).over(Window.partitionBy(*KEY, "kind").orderBy("n"))
    return each.select(*KEY, "size", "kind", "n", (end - whole).alias("start"), end.alias("end"), F.col("x.kept").alias("kept"))


def spans(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans and free weak candidates (doc_id, text_key, kind, start, end) of the rows of `scan`.

    A weak candidate that overlaps a base span is the same thing and left out;
    both go by the buckets they lie in.
    """
    base = _placed(texts, "base", 0).where(F.col("kept") >= F.when(F.col("kind") == 0, ASSIGN[1]).otherwise(0))
    base = stored(base.select(*KEY, "kind", "start", "end"), "secrets-base")
    weak = _placed(texts, "weak", WEAK).where("kept is not null").select(*KEY, "kind", "start", "end")
    weak = stored(weak, "secrets-weak")
    apart = _bucketed(base, "start", "end").alias("b")
    meets = same("w", "b", *KEY, "bucket") & (F.col("b.start") < F.col("w.end")) & (F.col("w.start") < F.col("b.end"))
    taken = _bucketed(weak, "start", "end").alias("w").join(apart, meets, "left_semi").select(*KEY, "kind", "start").distinct()
    return base, weak.alias("w").join(taken.alias("t"), same("w", "t", *KEY, "kind", "start"), "left_anti")


def _bucketed(rows: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bucket that an interval has a part in."""
    at = lambda c: F.floor(c / BUCKET)
    return rows.withColumn("bucket", F.explode(F.sequence(at(F.col(start)), at(F.greatest(F.col(end) - 1, F.col(start))))))


def scopes(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, scope, start, end of texts with weak candidates."""
    some = texts.where("scopes is not null")
    found = _placed(some, "scopes", SECTION)
    in_order = Window.partitionBy(*KEY, "kind").orderBy("n")
    begin = F.when(F.col("kind") == SECTION, F.coalesce(F.lag("end").over(in_order), F.lit(0))).otherwise(F.col("start"))
    end = F.when(F.col("kind") == SECTION, F.col("start")).when(
        F.col("kind") == INI, F.coalesce(F.lead("start").over(in_order), F.col("size"))).otherwise(F.col("end"))
    real = (F.col("kind") == SECTION) | F.col("kept").isNotNull()
    found = found.select(*KEY, "kind", "n", begin.cast("long").alias("start"), end.cast("long").alias("end"), real.alias("real"))
    # A text without an empty line is one section.
    whole = some.where(F.col("scopes")[0].isNull()).select(
        *KEY, F.lit(SECTION).alias("kind"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("start"),
        F.col("size").cast("long").alias("end"))
    every = found.where("real and start < end").drop("real").unionByName(whole)
    return every.select(*KEY, F.struct("kind", "n").alias("scope"), "start", "end")


def link(base: DataFrame, weak: DataFrame, within: DataFrame) -> DataFrame:
    """The weak candidates that are completed: doc_id, text_key, kind, start, end.

    A bare key id counts beside a secret (assign, hex, random), a random string
    beside an identifier (access, id), an address only beside both; beside
    means in one scope. What a scope holds is counted once, without pairs.
    """
    held = weak.select(*KEY).distinct()
    parts = base.alias("b").join(held.alias("h"), same("b", "h", *KEY), "left_semi").unionByName(weak)
    parts = parts.withColumn("bucket", F.floor(F.col("start") / BUCKET))
    inside = same("p", "s", *KEY, "bucket") & (F.col("p.start") >= F.col("s.start")) & (F.col("p.start") < F.col("s.end"))
    placed = parts.alias("p").join(_bucketed(within, "start", "end").alias("s"), inside)
    placed = stored(placed.select(*[f"p.{c}" for c in (*KEY, "kind", "start", "end")], "s.scope"), "secrets-placed")
    holds = placed.groupBy(*KEY, "scope").agg(
        F.max(F.col("kind").isin(1, 3)).alias("identifier"), F.max(F.col("kind").isin(0, 2, 4)).alias("secret"))
    complete = F.when(F.col("p.kind") == 3, F.col("h.secret")).when(F.col("p.kind") == 4, F.col("h.identifier")).otherwise(
        F.col("h.identifier") & F.col("h.secret"))
    beside = placed.where(F.col("kind") >= WEAK).alias("p").join(holds.alias("h"), same("p", "h", *KEY, "scope")).where(complete)
    return beside.select(*[f"p.{c}" for c in (*KEY, "kind", "start", "end")]).distinct()


def _listed(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_linked, base_spans, spans.

    docs: doc_id, text (further columns are not read). Spans are
    kind:start:end in code points, by start, then kind. Null and empty texts
    have none. Repeated rows get the same answer each; a null doc_id stays.
    """
    rows = stored(scan(docs), "secrets")
    some = F.exists("base", lambda b: b.isNotNull()) | F.col("scopes").isNotNull()
    texts = rows.where(some).dropDuplicates(KEY)
    base, weak = spans(texts)
    weak = stored(weak, "secrets-free")
    linked = link(base, weak, scopes(texts))
    every = base.unionByName(linked).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    joined = rows.select(*KEY).alias("r").join(stored(every, "secrets-found").alias("e"), same("r", "e", *KEY), "left")
    found = F.coalesce("e.found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    joined = joined.select("r.doc_id", found.alias("found"))
    own = F.filter("found", lambda s: s["kind"] < WEAK)
    counts = [_number(F.col("found"), k).alias(f"n_{KINDS[k]}") for k in range(WEAK)]
    return joined.select(
        "doc_id", *counts, (F.size("found") - F.size(own)).cast("long").alias("n_linked"),
        _listed(own).alias("base_spans"), _listed(F.col("found")).alias("spans"))
