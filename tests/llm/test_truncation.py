import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.truncation import abbreviations, endings, measured_lengths, poisson_tail, significant_lengths, truncated, with_endings

ENDINGS = {
    "complete": [
        "A sentence.", "Is it? \n\n", "Quoted text.''\n", "\\begin{document}\nText\n\\end{document}\n% draft that stops in the mid", "Text.\n% an unfinished draft of", "% only a comment", "这是一个句子。", "It costs 5\\% more.",
        "As in \\eqref{a}, so $x$.", "The set \\{1, 2\\} is small.", "a \\\\[2pt] bb.", "so \\(x\\) and \\[y\\] hold.", "in line with Ref.",
    ],
    "omission": ["cut here...", "cut here [...]", "cut hi…"],
    "open": ["with $\\alpha", "we get\n\\begin{equation}\nx = 1", "see \\cite{abc", "\\begin{itemize}\n\\item One.", "bad byte \ufffd", "Text\\footnote{As shown.", "we get \\[ x = 1.", "so \\(x.", "a\\\\{b.", "\\emph{One. Two."],
    "closed": ["Body.\n\\endinput\n", "x\n\\begin{thebibliography}{9}\n\\bibitem{a} A.\n\\end{thebibliography}", "So \\[ x=1 \\]", "So $$x=1$$", "Text.\n\\input{sections/one}", "\\title{A}\n\\maketitle", "Text.\n\\section{Results}", "\\bibliography{" + "a," * 400 + "b}"],
    "number": ["with x = 0.", "pages 12--17."],
    "letter": ["\\bibitem{a} A. Author, P."],
    "word": ["and then the res", "\\begin{document} Text goes on and", "Text.\n\nKeywords: one, two", "Text.\n\nKeywords: " + "word, " * 400 + "last"],
}
SCHEMA = "doc_id long, text string, source string, cut string, ending int"


@pytest.mark.parametrize("expected", sorted(ENDINGS))
def test_endings(spark, expected):
    got = with_endings(spark.createDataFrame([(t,) for t in ENDINGS[expected]], "t string"), "t").select("t", F.col("class").alias("e")).collect()
    assert [(r.t, r.e) for r in got if r.e != expected] == []


def test_blank_and_very_long_texts(spark):
    long = ["word " * 400_000 + "end.", "$x$ " * 200_000 + "$y", " " * 500_000 + "x, y." + " " * 500_000, "\\begin{a}\\end{a}" * 50_000 + "."]
    rows = [(t,) for t in [None, "", " \n ", *long]]
    got = [r.e for r in with_endings(spark.createDataFrame(rows, "t string"), "t").select(F.col("class").alias("e")).collect()]
    assert got == [None, None, None, "complete", "open", "letter", "complete"]


def test_poisson_tail():
    import math

    for k, mean in ((3, 1.0), (10, 2.5), (5, 5.0), (1, 0.1)):
        exact = 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))
        got = poisson_tail(np.array([k]), np.array([mean]))[0]
        assert got == pytest.approx(exact if k > mean else 1.0)
    assert 0 < poisson_tail(np.array([40]), np.array([0.5]))[0] < 1e-50


def test_limits_are_found_and_only_those(spark):
    rng = np.random.default_rng(0)
    rows = [("a", int(x)) for x in rng.integers(200, 8000, 3000)] + [("a", 4000)] * 60 + [("b", int(x)) for x in rng.integers(200, 8000, 500)] + [("c", 300)]
    df = spark.createDataFrame(rows, "source string, length int").withColumn("measure", F.lit("chars"))
    assert {(r.source, r.length) for r in significant_lengths(df).collect()} == {("a", 4000)}
    assert significant_lengths(df.where("false")).count() == 0


def test_a_small_source_has_limits_and_copies_are_one_text(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"{i} " + "x" * int(n), "a", "", 0) for i, n in enumerate(rng.integers(300, 3000, 60))]
    rows += [(100 + i, (f"{i} " + "y" * 700)[:700], "a", "", 0) for i in range(4)] + [(200 + i, "one text " * 90, "a", "", 0) for i in range(9)]
    limits = significant_lengths(measured_lengths(endings(spark.createDataFrame(rows, SCHEMA))))
    assert {r.length for r in limits.where("measure = 'chars'").collect()} == {700}


def test_packets_show_in_what_is_left_over(spark):
    rng = np.random.default_rng(4)
    lengths = [int(n) for n in rng.integers(300, 30_000, 400)] + [1460 * k for k in range(1, 16)]
    limits = significant_lengths(measured_lengths(endings(spark.createDataFrame([(i, (f"{i} " + "x" * n)[:n], "a", "", 0) for i, n in enumerate(lengths)], SCHEMA))))
    assert {r.measure for r in limits.collect()} == {"bytes%1460"}


def _corpus(limit: bool):
    """Texts of one source: whole ones in three ways, cuts at a limit of 1000 and cuts elsewhere."""
    rng = np.random.default_rng(1)
    rows = [(i, f"{i} " + "x" * int(n - 1) + ", and.", " A ", "", 0) for i, n in enumerate(rng.integers(500, 3000, 400))]
    rows += [(500 + i, f"{i} " + "x" * int(n) + ".\nKeywords: one, two", "a", "", 0) for i, n in enumerate(rng.integers(500, 3000, 40))]
    rows += [(600 + i, f"{i} " + "x" * int(n) + ".\n\\endinput", "a", "", 0) for i, n in enumerate(rng.integers(500, 3000, 40))]
    if limit:
        ends = [" and so on", " with $x", " it is al", "\nthus the"]
        rows += [(1000 + i, (f"{i} " + "y" * 1000)[: 1000 - len(ends[i % 4])] + ends[i % 4], "a", "", 0) for i in range(32)] + [(1900, "z" * 978 + ".\nKeywords: one, twooo", "a", "", 0), (1901, "z" * 990 + " complete.", "a", "", 0)]
    rows += [(2000 + i, f"{i} " + "y" * int(n) + e, "b", "", 0) for i, (n, e) in enumerate(zip(rng.integers(500, 3000, 6), ["stops mid", " then $y", "\nthe res", " {\\em a", "so that", " and $\\alpha"], strict=True))]
    return rows + [(3000, "what is left…", "c", "", 0), (3001, None, "a", "", 0), (3002, "", None, "", 0), (3003, " so that", None, "", 0), (3003, " so that", None, "", 0), (None, " so that", "a", "", 0)]


def test_endings_are_measured_against_the_limits(spark):
    rows = _corpus(True)
    judged, limits = truncated(spark.createDataFrame(rows, SCHEMA))
    got = judged.collect()
    by = lambda reason: sorted(r.doc_id for r in got if r.reason == reason and r.doc_id is not None)
    assert len(got) == len(rows) and all(r.cut == (r.reason is not None) for r in got)
    assert by("length") == [*range(1000, 1032), 1900] and by("omission") == [3000] and by("ending") == [*range(2000, 2006), 3003, 3003]
    assert {(r.source, r.length) for r in limits.collect()} == {("a", 1000)}


def test_without_limits_only_marks_of_omission_count(spark):
    judged, limits = truncated(spark.createDataFrame(_corpus(False), SCHEMA))
    assert limits.count() == 0 and [r.doc_id for r in judged.where("cut").collect()] == [3000]
    empty, none = truncated(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and none.count() == 0


def test_abbreviations_are_words_after_which_sentences_go_on(spark):
    texts = ["See Fig. 3 and Fig.~4 here. The case, cf. the data. Then Fig. 5, cf. \\cite{a}, ends here. So it is. We go." for _ in range(9)]
    long = ["a." * 300_000, "abcde." * 100_000 + " x", "word" * 200_000 + "."]
    docs = spark.createDataFrame([(t,) for t in texts + long] + [(None,), ("",)], "text string")
    tokens = spark.createDataFrame([(t,) for t in ("Fig.", "cf.", "here.", "data.", "is.", "new.")], "token string")
    assert {r.token for r in abbreviations(docs, tokens).collect()} == {"Fig.", "cf."}
