"""Texts cut off by field limits or in transfer, and how often each source cuts.

A field limit shows in the lengths: the hazard of a length is the share of texts, among those at least that long,
that end right there. Hazards come from counts of different texts by window functions, per source and measure
(characters, bytes, and bytes left over from whole packets; a closing line break or empty last line left out). Each is tested against the
pooled hazard of its neighbourhood, with the false discovery rate controlled over all lengths of all sources.

Which endings are incomplete is measured against those lengths. A text that ends with a closed sentence or document is
complete, whatever its length. Every other ending has a kind: inside an open formula, environment or brace, after a
closed command or display, after a numbered full stop, or otherwise, and within these the first word of its last line.
A kind is an ending of whole texts if it comes away from significant lengths significantly more often than cuts explain,
their number there being that at significant lengths times the ratio found for open structures; otherwise it is
incomplete. At significant lengths every ending is a cut that its neighbours' hazard doesn't explain. Away from them,
where a broken transfer raises no hazard, only endings of kinds that were measured as incomplete are. Without significant
lengths there is nothing to measure against, and only texts that end in a mark of omission are flagged.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.operators.salting import spread_join
from tidemark.session import written

# Marks that end a sentence and what may close after them; marks of omission.
SENTENCE_MARKS = ".!?。！？؟։।"
CLOSERS = "'\"”’»)]}"
OMISSION = ("...", "…", "[...]", "[…]")
BLANK = " \t\r\n\f\v\u00a0\u3000"
# A short word or a chain of them before a full stop, which may be an abbreviation.
SHORT_STOP = r"(?<![\p{L}\p{N}\\.])((?:\p{L}{1,5}+\.)++)"
FIRST_OF_LINE = r"^\s*(\\[A-Za-z]+\*?|\S{1,24})"
CLOSED_END = r"(\\end\{[^{}\n]*\}|\\\]|\$\$)$"
COMMAND_ONLY = r"^\s*\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{.*\})?$"
# Any text; the group holds the marks that open and close formulas, displays and groups.
STRUCTURE = r"\\\\|\\[${}]|(\\[\[\]()]|[${}])|[^${}\\]++|\\"
GRIDS = (512, 1024, 1460)


def normal_source(source: Column) -> Column:
    return F.lower(F.trim(source))


def with_endings(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with how its texts end: ``class``, ``kind`` and ``token``, null for a null or blank text.

    Comments are left out, so drafts in them don't count. Classes: ``complete`` (a closed sentence, an uncommented end of
    the document anywhere, or nothing but comments), ``omission`` (a mark that stands for missing text), ``open`` (inside a
    formula, environment or braces, or in a broken character), ``closed`` (after a closed environment, display or command),
    ``number`` and ``letter`` (a full stop after a digit or a single letter), ``word`` (all else). The kind tells the closed
    environment or the first word of the last line. ``token`` is the short word before the full stop of a complete text. The
    whole text is read. Steps are projections of their own, so that no pass over a text is made twice.
    """
    given = df.columns
    lit = F.lit
    steps = df.withColumn("_plain", F.rtrim(F.regexp_replace(text, lit(r"(?<!\\)%[^\n]*"), lit("")), lit(BLANK)))
    steps = steps.withColumn("_done", F.contains("_plain", lit("\\end{document}")) | (F.length("_plain") == 0)).withColumn("_rest", F.when(~F.col("_done"), F.col("_plain")))
    rest = F.col("_rest")
    steps = steps.select(
        *given, "_done", "_rest", (F.length(F.rtrim(F.col(text), lit(BLANK))) == 0).alias("_blank"), F.substring_index(rest, "\n", -1).alias("_last"),
        F.substring(rest, -64, 64).alias("_end"),  # longer than any token, so a token is seen whole
        F.substring(F.rtrim(rest, lit(CLOSERS)), -1, 1).alias("_mark"), F.regexp_replace(rest, lit(STRUCTURE), lit("$1")).alias("_structure"),
        (F.regexp_count(rest, lit(r"\\begin\{(?!document\})")) - F.regexp_count(rest, lit(r"\\end\{(?!document\})"))).alias("_opened"),
    )
    count = lambda mark: F.length("_structure") - F.length(F.replace("_structure", lit(mark), lit(mark[1:])))
    is_open = (count("$") % 2 == 1) | (F.col("_opened") > 0) | (count("{") > count("}")) | (count("\\[") > count("\\]")) | (count("\\(") > count("\\)")) | F.endswith("_end", lit("\ufffd"))
    steps = steps.select(*given, "_done", "_blank", "_end", "_mark", "_last", is_open.alias("_open"), F.regexp_extract("_end", SHORT_STOP + "$", 1).alias("_token"), F.regexp_extract("_last", CLOSED_END, 1).alias("_closing"))
    cls = (
        F.when(F.col(text).isNull() | F.col("_blank"), lit(None))
        .when(F.col("_done"), "complete")
        .when(reduce(lambda a, b: a | b, [F.endswith("_end", lit(m)) for m in OMISSION]), "omission")
        .when(F.col("_open"), "open")
        .when(F.col("_end").rlike(r"\p{N}\.$"), "number")
        .when(F.length("_token") == 2, "letter")
        .when((F.col("_mark") != "") & F.contains(lit(SENTENCE_MARKS), "_mark"), "complete")
        .when((F.col("_closing") != "") | F.col("_last").rlike(COMMAND_ONLY), "closed")
        .otherwise("word")
    )
    kind = F.when(F.col("class").isin("closed", "word"), F.when(F.col("_closing") != "", F.col("_closing")).otherwise(F.regexp_extract("_last", FIRST_OF_LINE, 1))).when(F.col("class").isNotNull(), "")
    token = F.when((F.col("class") == "complete") & ~F.col("_done"), F.col("_token")).when(F.col("class").isNotNull(), "")
    return steps.withColumn("class", cls).select(*given, "class", kind.alias("kind"), token.alias("token"))


def poisson_tail(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X >= k) of a Poisson variable, 1 where k is not above the mean; summed upwards, so small values are exact."""
    k, mean = np.asarray(k, float), np.maximum(np.asarray(mean, float), 1e-12)
    log_term = k * np.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])
    total, term = np.ones_like(k), np.ones_like(k)
    for i in range(1, 400):
        term = term * mean / (k + i)
        total += term
        if (term < total * 1e-9).all():
            break
    return np.where(k <= mean, 1.0, np.minimum(1.0, np.exp(log_term) * total))


@F.pandas_udf(T.DoubleType())
def _tail(k: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series(poisson_tail(k.to_numpy(), mean.to_numpy()))


def significant_lengths(lengths: DataFrame, q: float = 0.001, reach: float = 0.1, start: int = 500) -> DataFrame:
    """Lengths (source, measure, length, n, at_risk, hazard, expected, p) at which texts end more often than at
    neighbouring lengths.

    ``lengths`` has a row per different text and measure. The neighbourhood of a length is its bin of ln(length + start), of
    width ``reach``, and the two next to it, or the lengths with about as many texts at risk, whichever lets more be
    expected. A length must be shared by two texts. ``q`` is the false discovery rate. Of a measure named bytes%<g>, what is left
    over from whole packets, only 0 is tested. Windows span the distinct lengths of a source, which the longest text bounds,
    not the number of texts. An empty table gives no rows.
    """
    key = ["source", "measure"]
    counts = lengths.groupBy(*key, "length").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(*key).orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    at_risk = F.sum("n").over(W.partitionBy(*key)) - F.sum("n").over(upto) + F.col("n")
    # Between two lengths the number at risk is that of the longer one, so this sums it over all lengths in between.
    gap = F.col("length") - F.coalesce(F.lag("length").over(W.partitionBy(*key).orderBy("length")), F.col("length") - 1)
    hazards = counts.select("*", at_risk.alias("at_risk"), gap.alias("gap")).select(
        "*", F.floor(F.log(F.col("length") + F.lit(start)) / reach).alias("bin"), F.floor(F.log2("at_risk")).alias("depth")
    )
    bins = hazards.groupBy(*key, "bin").agg(F.sum("n").alias("ends"), F.sum(F.col("gap") * F.col("at_risk")).alias("exposure"))
    # Each bin goes to itself and to both neighbours, so gaps between bins need no care.
    pooled = bins.select(*key, "ends", "exposure", F.explode(F.array(*[F.col("bin") + i for i in (-1, 0, 1)])).alias("bin")).groupBy(*key, "bin").agg(F.sum("ends").alias("ends"), F.sum("exposure").alias("exposure"))
    # Towards the longest texts a hazard can rise within a bin: those of like numbers at risk are neighbours, too.
    deep = hazards.groupBy(*key, "depth").agg(F.sum("n").alias("_ends"), F.sum(F.col("gap") * F.col("at_risk")).alias("_exposure"))
    # Half a text is added, as no neighbour may end there.
    expected = F.greatest(*[(F.col(e) - F.col("n") + 0.5) / F.col(x) * F.col("at_risk") for e, x in (("ends", "exposure"), ("_ends", "_exposure"))])
    # A length that only one text has, and what is left over from a packet, is a test but can't be significant.
    counts_ = (F.col("n") > 1) & (~F.col("measure").startswith("bytes%") | (F.col("length") == 0))
    p = F.when(counts_, _tail(F.col("n").cast("double"), F.col("expected"))).otherwise(F.lit(1.0))
    tested = written(
        hazards.join(pooled, [*key, "bin"]).join(deep, [*key, "depth"]).select(*key, "length", "n", "at_risk", (F.col("n") / F.col("at_risk")).alias("hazard"), expected.alias("expected")).withColumn("p", p), "hazards"
    )
    # Benjamini-Hochberg over a grid of thresholds 2^(-k/4): at most 4001 counts come to the driver.
    grid = tested.groupBy(F.least(F.floor(-F.log2(F.greatest("p", F.lit(1e-300))) * 4), F.lit(4000)).alias("k")).count().collect()
    tests = sum(r["count"] for r in grid)
    passed, limit = 0, 0.0
    for row in sorted(grid, key=lambda r: -r["k"]):
        passed += row["count"]
        if 2.0 ** (-row["k"] / 4) * tests <= q * passed:
            limit = 2.0 ** (-row["k"] / 4)
    return tested.where(F.col("p") <= limit)


def abbreviations(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Those of the ``tokens`` (short words with their full stop) after which texts mostly go on within the sentence.

    Every occurrence in all texts counts; it goes on if a lower-case letter, digit, command, formula or inner mark follows
    on the line. More than half by two standard deviations makes an abbreviation.
    """
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit("(" + SHORT_STOP + r"[ \t~]*\S?)"), F.lit(1))).alias("m"))
    parts = found.select(F.regexp_extract("m", SHORT_STOP, 1).alias("token"), F.col("m").rlike(r"\.[ \t~]*[\p{Ll}\p{N}\\$,;:(]$").alias("on"))
    seen = parts.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("on").alias("on"))
    return seen.where(F.col("on") * 2 > F.col("n") + 2 * F.sqrt("n")).select("token").join(tokens.distinct(), "token")


def endings(docs: DataFrame) -> DataFrame:
    """(doc_id, source, class, kind, token, text_hash, chars, bytes) of each text; a closing line break or empty last line doesn't count as length."""
    body = F.regexp_replace("text", F.lit(r"\n{1,2}\z"), F.lit(""))
    rows = with_endings(docs.select("doc_id", F.coalesce(normal_source(F.col("source")), F.lit("")).alias("source"), "text")).withColumn("body", body)
    return rows.select("doc_id", "source", "class", "kind", "token", F.xxhash64("body").alias("text_hash"), F.length("body").alias("chars"), F.octet_length("body").alias("bytes"))


def measured_lengths(judged: DataFrame) -> DataFrame:
    """(source, measure, length), a row per different text of a source; what is left over from packets per different length."""
    texts = judged.where("class is not null").select("source", "text_hash", "chars", "bytes").distinct()
    whole = texts.select("source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in ("chars", "bytes")])).alias("m"))
    sizes = texts.select("source", "bytes").distinct()
    rest = sizes.select("source", "bytes", F.explode(F.array(*[F.lit(g) for g in GRIDS])).alias("g")).where("bytes >= g")
    return whole.select("source", "m.*").unionByName(rest.select("source", F.concat(F.lit("bytes%"), "g").alias("measure"), (F.col("bytes") % F.col("g")).alias("length")))


def at_limits(judged: DataFrame, limits: DataFrame) -> DataFrame:
    """``judged`` with ``chance``: the share of the ends at its significant length that neighbours explain, null elsewhere.

    The significant lengths of a source become one map, so a text looks up all its measures in one join.
    """
    key = lambda measure, length: F.concat_ws("=", measure, length.cast("string"))
    share = F.least(F.col("expected") / F.col("n"), F.lit(1.0))
    of_source = limits.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("measure"), F.col("length")), share))).alias("_limits"))
    measures = [("chars", F.col("chars")), ("bytes", F.col("bytes")), *[(f"bytes%{g}", F.when(F.col("bytes") >= g, F.col("bytes") % g)) for g in GRIDS]]
    found = [F.try_element_at("_limits", key(F.lit(m), length)) for m, length in measures]
    return spread_join(judged, of_source, ["source"], how="left").withColumn("chance", F.least(*found)).drop("_limits")


def truncated(docs: DataFrame, alpha: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Judged texts (doc_id, source, class, kind, at_limit, cut, reason), one row per row of ``docs``, and the significant lengths.

    ``docs`` needs doc_id, text and source; sources are compared trimmed and in lower case, a null source is one of
    its own. Null and blank texts are never cut. Repeated rows are judged alike. An empty table gives no rows. ``reason`` is
    ``length`` at a significant length, ``omission`` or ``ending`` elsewhere, null for texts that aren't cut. ``alpha``: the
    error of calling a kind an ending of whole texts.
    """
    judged = written(endings(docs), "endings")
    limits = written(significant_lengths(measured_lengths(judged)), "limits")
    short = written(abbreviations(docs, judged.where("class = 'complete' and token <> ''").select("token")), "abbreviations").withColumn("_abbreviation", F.lit(True))
    judged = spread_join(judged, short, ["token"], how="left").withColumn("class", F.when(F.col("_abbreviation"), "open").otherwise(F.col("class")))
    placed = written(at_limits(judged.select("doc_id", "source", "class", "kind", "chars", "bytes"), limits).select("doc_id", "source", "class", "kind", "chance"), "placed")
    n0, n1 = F.count_if(F.col("chance").isNull()), F.count("chance")
    kinds = written(placed.where("class is not null").groupBy("class", "kind").agg(n0.alias("n0"), n1.alias("n1"), F.sum("chance").alias("by_chance")), "kinds")
    sums = kinds.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("by_chance").alias("by_chance"), *[F.coalesce(F.sum(F.when(F.col("class") == "open", F.col(c))), F.lit(0)).alias(f"open{c}") for c in ("n0", "n1")]).first()
    if not sums["n1"]:
        flagged = placed.select("doc_id", "source", "class", "kind", F.lit(False).alias("at_limit"), F.coalesce(F.col("class") == "omission", F.lit(False)).alias("cut"))
        return flagged.withColumn("reason", F.when(F.col("cut"), "omission")), limits
    # Cuts away from significant lengths per cut at one, by endings that only cuts leave.
    ratio = (sums["openn0"] + 0.5) / (sums["openn1"] + 0.5)
    chance = sums["by_chance"] / max(sums["n0"], 1)  # texts at significant lengths by chance, per text elsewhere
    explained = ratio * (F.col("n1") + 1)
    whole = written(
        kinds.where(F.col("class").isin("closed", "number", "letter", "word") & (F.col("n0") > 2 * explained)).where(_tail(F.col("n0").cast("double"), explained) < alpha), "whole-kinds"
    )
    # What is left of each class is judged as one; a class not seen at significant lengths isn't one of cuts.
    rest = kinds.join(whole.select("class", "kind"), ["class", "kind"], "left_anti").groupBy("class").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()  # one row per class
    away = [r["class"] for r in rest if r["class"] not in ("complete", "omission") and r["n1"] and r["n0"] <= 2 * ratio * r["n1"]]
    there = [r["class"] for r in rest if r["class"] != "complete" and r["n1"] > 2 * chance * r["n0"]]
    marked = spread_join(placed, whole.select("class", "kind", (F.col("n1") > 2 * chance * F.col("n0")).alias("_there")), ["class", "kind"], how="left")
    at_limit = F.col("chance").isNotNull()
    by_length = at_limit & F.coalesce("_there", F.col("class").isin(there))
    by_ending = ~at_limit & F.col("_there").isNull() & F.col("class").isin(away)
    reason = F.when(by_length, "length").when(F.col("class") == "omission", "omission").when(by_ending, "ending")
    return marked.select("doc_id", "source", "class", "kind", at_limit.alias("at_limit"), reason.isNotNull().alias("cut"), reason.alias("reason")), limits
