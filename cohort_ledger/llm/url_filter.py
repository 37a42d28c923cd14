"""URL filters: rules first, then a ratio of character language models.

A URL that a rule fits gets the rule's verdict.  From these URLs two smoothed
variable-order Markov models are counted, one of accepted and one of rejected
ones, over the whole URL (scheme and host in lower case, path, query and
fragment) with ``ORDER`` characters of context.  Each order is
mixed with the next shorter one by how often and how variedly its context was
seen (Witten-Bell); an unseen context leaves the word to the shorter one.  The
score of a URL is the difference of both log-likelihoods per character, and it
is accepted from a threshold on, which is calibrated on ruled URLs that the
models did not see (a fifth of them by hash): the cut with the best mean of
both hit rates.

Only built-in functions are used.  Counting and scoring meet in a table of
distinct character runs, which grows with the variety of the URLs; equal
texts are scored once.  Sums are of whole numbers, so they do not depend on
the order of rows.  The driver sees a histogram of at most ``2 * REACH * BINS``
rows.

Defined results: a NULL URL, or one without ``://``, has an empty host and path
and is judged by the method, the latter by all its characters; without examples of both kinds every score is 0
and the threshold is 0, which accepts; repeated rows get equal verdicts; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_ledger.llm.words import LOWER, UPPER
from cohort_ledger.session import cut

ORDER = 4
ALPHABET = 256  #: characters that an unseen one is taken to be one of
SCALE = 1 << 24  #: log-likelihoods are summed as whole numbers of this fraction
BINS, REACH = 64, 16  #: bins per unit of score, and the scores they span on either side
START, STOP = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, from a path on."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    tail = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def whole(url: Column) -> Column:
    """All characters of a URL, A-Z of its scheme and host lower-cased; NULL is empty."""
    front = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    rest = F.substring(url, F.length(front) + 1, F.length(url))
    return F.coalesce(F.concat(F.translate(front, UPPER, LOWER), rest), F.lit(""))


def ruled(rules: list[Rule]) -> Column:
    """The longest rule that fits (host, path) as a struct; NULL if none does."""
    found = [F.lit(None).cast("struct<long:int,rule:string,verdict:string>")]
    for r in rules:
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        found.append(F.when(fits, F.struct(F.lit(len(r.name)).alias("long"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.array_max(F.array(*found))


def _runs(texts: DataFrame, order: int, *keep: str) -> DataFrame:
    """(keep, gram): for each character, with an end mark, the run of it and ``order`` before."""
    padded = F.concat(F.lit(START * order), "text", F.lit(STOP))
    at = F.sequence(F.lit(1), F.length("text") + 1)
    return texts.select(*keep, padded.alias("padded"), F.explode(at).alias("at")).select(*keep, F.expr(f"substring(padded, at, {order + 1})").alias("gram"))


def _last(column: str, n: int) -> Column:
    return F.expr(f"right({column}, {n})") if n else F.lit("")


def char_models(texts: DataFrame, trained: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) of every run in ``texts``: log-likelihood, accepted less rejected, as a whole number.

    ``trained`` has (text, n_allow, n_block), the texts to count and how often each was accepted and rejected.
    """
    counted = cut(_runs(trained, order, "n_allow", "n_block").groupBy("gram").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")))
    grams = _runs(texts, order).distinct().select("gram", F.lit(1.0 / ALPHABET).alias("p_allow"), F.lit(1.0 / ALPHABET).alias("p_block"))
    for k in range(order + 1):
        level = counted.groupBy(_last("gram", k + 1).alias("run")).agg(F.sum("n_allow").alias("c_allow"), F.sum("n_block").alias("c_block"))
        around = level.groupBy(F.expr("left(run, length(run) - 1)").alias("context")).agg(
            *[F.sum(f"c_{s}").alias(f"t_{s}") for s in ("allow", "block")], *[F.count_if(F.col(f"c_{s}") > 0).alias(f"v_{s}") for s in ("allow", "block")]
        )
        grams = (
            grams.withColumn("tail", _last("gram", k + 1))
            .withColumn("before", F.expr("left(tail, length(tail) - 1)"))
            .join(level, F.col("tail") == F.col("run"), "left")
            .join(around, F.col("before") == F.col("context"), "left")
        )
        mixed = lambda s: F.when(
            F.col(f"t_{s}") > 0, (F.coalesce(f"c_{s}", F.lit(0)) + F.col(f"v_{s}") * F.col(f"p_{s}")) / (F.col(f"t_{s}") + F.col(f"v_{s}"))
        ).otherwise(F.col(f"p_{s}"))
        grams = grams.select("gram", mixed("allow").alias("p_allow"), mixed("block").alias("p_block"))
    return grams.select("gram", F.round((F.ln("p_allow") - F.ln("p_block")) * SCALE).cast("long").alias("ratio"))


def _threshold(held: DataFrame) -> float:
    """The cut with the best mean hit rate over (score, n_allow, n_block)."""
    bins = F.greatest(F.lit(-REACH * BINS), F.least(F.lit(REACH * BINS - 1), F.floor(F.col("score") * BINS)))
    rows = held.groupBy(bins.alias("bin")).agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).orderBy("bin").collect()
    all_a, all_b = sum(r.a for r in rows), sum(r.b for r in rows)
    if not all_a or not all_b:
        return 0.0
    best, a, b = (1.0, rows[0].bin, rows[0].bin), 0, 0
    for r, later in zip(rows, [*rows[1:], None]):
        a, b = a + r.a, b + r.b
        rate = (all_a - a) / all_a + b / all_b
        if rate > best[0]:
            best = (rate, r.bin + 1, later.bin if later else r.bin + 1)
    return (best[1] + best[2]) / 2 / BINS


def judge(pages: DataFrame, rules: list[Rule], order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; score is NULL where a rule decides."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), whole(F.col("url")).alias("text"))
    rows = rows.withColumn("fit", ruled(rules))
    texts = cut(rows.groupBy("text").agg(F.count_if(F.col("fit.verdict") == "allow").alias("n_allow"), F.count_if(F.col("fit.verdict") == "block").alias("n_block"), F.count_if(F.col("fit").isNull()).alias("n_open")))
    held = F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(5)) == 0
    sure = (F.col("n_allow") > 0) | (F.col("n_block") > 0)
    scored = texts.where((F.col("n_open") > 0) | (sure & held))
    both = texts.agg(F.max("n_allow").alias("a"), F.max("n_block").alias("b")).first()
    if not both.a or not both.b:
        verdicts = scored.select(F.col("text").alias("judged"), F.lit(0.0).alias("score"))
        threshold = 0.0
    else:
        ratios = char_models(scored, texts.where(sure & ~held), order).select(F.col("gram").alias("of"), "ratio")
        each = _runs(scored, order, "text").join(ratios, F.col("gram") == F.col("of"))
        verdicts = cut(each.groupBy(F.col("text").alias("judged")).agg((F.sum("ratio") / F.count("ratio") / SCALE).alias("score")))
        threshold = _threshold(verdicts.join(texts.where(sure & held), F.col("judged") == F.col("text")).select("score", "n_allow", "n_block"))
    method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return rows.join(verdicts, F.col("text") == F.col("judged"), "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), F.when(F.col("fit").isNull(), F.col("score")).alias("score")
    )
