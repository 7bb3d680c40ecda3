"""URL filter: rules by host and path, and boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrisk.llm.common import lower_ascii, stored


@dataclass(frozen=True)
class Rule:
    """`verdict` for a host with its subdomains, below a path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, in lower case."""
    return lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(name, verdict), or null.

    Rules are a list of the caller, at most a thousand; it becomes one expression.
    """
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules: join a rule table on host suffixes instead")
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character. One pass over the text for each different character."""
    n = F.length(text).cast("double")

    def add(total: Column, char: Column) -> Column:
        share = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return total - share * F.log2(share)

    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), add)).otherwise(0.0)


FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digits",
            "hyphens", "entropy", "params", "query_length", "secure", "suffix_rate", "suffix_log_n",
            "part_rate", "part_log_n"]


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features of a url that need no other row, and the keys of the suffix statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    host, path = F.col("host"), F.col("path")
    return pages.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": _count(path, "/").cast("double"),
        "digit_ratio": F.when(url == "", 0.0).otherwise(
            (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / F.length(url)),
        "host_digits": (F.length(host) - F.length(F.translate(host, "0123456789", ""))).cast("double"),
        "hyphens": _count(url, "-").cast("double"),
        "entropy": _entropy(url),
        "params": F.when(query == "", 0).otherwise(_count(query, "&") + 1).cast("double"),
        "query_length": F.length(query).cast("double"),
        "secure": F.startswith(url, F.lit("https:")).cast("double"),
        "_suffix": F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1),
        "_part": F.regexp_extract(path, r"^/?([^/]*)", 1),
    })


#: Parts of the labelled urls: the first one is held out, the others are folds of the suffix statistics.
PARTS = 5


def part_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(PARTS)), F.lit(PARTS)).cast("int")


def _counted(labelled: DataFrame, key: str, name: str) -> DataFrame:
    """Urls and blocked urls per key, as arrays by fold, over all labelled rows that are not held out."""
    def folds(value: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("_fold") == k, value).otherwise(0.0)) for k in range(1, PARTS)])

    return labelled.where("_fold > 0").groupBy(key).agg(
        folds(F.lit(1.0)).alias(f"{name}_n"), folds(F.col("label")).alias(f"{name}_blocked"))


def _rated(rows: DataFrame, counts: DataFrame, key: str, name: str, prior: float = 10.0) -> DataFrame:
    """Share of blocked urls of the key, drawn towards one half, and the logarithm of their number.

    A row that is learnt from sees the other folds only: neither its own label
    nor that of an equal url is in its statistics.
    """
    def seen(column: str) -> Column:
        every = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
        own = F.when(F.col("label").isNotNull() & (F.col("_fold") > 0), F.try_element_at(F.col(column), F.col("_fold")))
        return F.coalesce(every - F.coalesce(own, F.lit(0.0)), F.lit(0.0))

    n, blocked = seen(f"{name}_n"), seen(f"{name}_blocked")
    return rows.join(counts, key, "left").withColumns({
        f"{name}_rate": (blocked + prior / 2) / (n + prior), f"{name}_log_n": F.log1p(n)}).drop(f"{name}_n", f"{name}_blocked")


def judge(pages: DataFrame, rules: list[Rule], fit_rows: int = 20_000, rounds: int = 20, depth: int = 3,
          seed: int = 42) -> DataFrame:
    """Verdict for every url: page_id, host, path, rule, score, verdict, held_out.

    A rule decides where one fits. All others are judged by boosted trees that
    are fitted on the urls which a rule labels: on at most `fit_rows` of them,
    those with the smallest hash of url and id. A fifth of the labelled urls, by
    a hash, is held out of the fit and of all statistics (held_out), to measure
    on. The suffix statistics count all others; a row that the trees learn from
    sees those of other folds. score is the probability of block. Without labelled rows, or
    with one verdict only among them, score is the share of blocked labels (one
    half without any), and block needs more than one half. A null url, or one
    without ://, has an empty host and path. Repeated rows are judged alike.
    """
    judged = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    judged = judged.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")),
                                 "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("label", F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == "block").cast("double")))
    rows = stored(lexical(judged).withColumn("_fold", part_of(F.col("url"))), "urls")
    known = rows.where(F.col("label").isNotNull())
    suffixes, parts = stored(_counted(known, "_suffix", "suffix"), "url-suffixes"), stored(_counted(known, "_part", "part"), "url-parts")

    def with_rates(df: DataFrame) -> DataFrame:
        return _rated(_rated(df, suffixes, "_suffix", "suffix"), parts, "_part", "part")

    sample = known.where("_fold > 0").orderBy(F.xxhash64("url", "page_id", F.lit(seed)), "page_id", "url").limit(fit_rows)
    sample = stored(with_rates(sample).coalesce(1).sortWithinPartitions("page_id", "url"), "url-fit")
    n, blocked = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    scored = with_rates(rows)
    if n and 0 < blocked < n:
        vector = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)
        model = trees.fit(vector.transform(sample.coalesce(1)))
        scored = model.transform(vector.transform(scored)).withColumn(
            "score", vector_to_array("probability")[1])
    else:
        scored = scored.withColumn("score", F.lit(blocked / n if n else 0.5))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    held = F.col("label").isNotNull() & (F.col("_fold") == 0)
    return scored.select("page_id", "host", "path", F.col("_rule.name").alias("rule"), "score", verdict.alias("verdict"),
                         F.coalesce(held, F.lit(False)).alias("held_out"))
