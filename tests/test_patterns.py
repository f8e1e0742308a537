"""Expected values were worked out by hand from the positions of each pattern."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plexicount.functions.patterns import Expression, Parts, PatternError, Slices, compile_pattern, exact_pattern

READ, MARKS = "TTGACCATGCAAGT", "abcdefghijklmn"


def extracted(spark, pattern, rows, method="string", three_prime=False):
    made = compile_pattern(pattern, method, three_prime).extract(F.col("seq"), F.col("qual"))
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, seq string, qual string").select("k", made.alias("x")).orderBy("k").collect()
    return [None if r["x"] is None else tuple(r["x"]) for r in got]


def test_string_from_the_start(spark):
    # C C N X N N: cell 0-1, UMI 2 and 4-5, 3 stays.
    assert extracted(spark, "CCNXNN", [(READ, MARKS)]) == [("GCC", "cef", "TT", "AATGCAAGT", "dghijklmn")]


def test_string_from_the_end(spark):
    # The last five: N N X C N.
    assert extracted(spark, "NNXCN", [(READ, MARKS)], three_prime=True) == [("CAT", "jkn", "G", "TTGACCATGA", "abcdefghil")]


def test_a_read_of_just_the_pattern_and_a_shorter_one(spark):
    assert extracted(spark, "NNX", [("GAT", "xyz"), ("GA", "xy"), ("", "")]) == [("GA", "xy", "", "T", "z"), None, None]


@pytest.mark.parametrize("pattern", ["NNB", "nnx", " "])
def test_bad_letters(pattern):
    with pytest.raises(PatternError):
        compile_pattern(pattern)


@pytest.mark.parametrize("pattern", ["^(.)(.)", "(?P<other>..)", "(?P<umi_1>..", "{s<=3}(?P<umi_1>.)", "{s<=0}(?P<umi_1>.)", "(?P<umi_1>G{s<=})", "(?P<umi_1>G{s<=1)", "(?P<umi_1>T)(?!G)", r"(?P<umi_1>.)\1"])
def test_bad_expressions(pattern):
    with pytest.raises(PatternError):
        compile_pattern(pattern, "regex")


def test_fixed_positions_become_slices(spark):
    pattern = "^(?P<umi_1>.{2})(?P<discard_1>..)(?P<cell_1>.{3}).(?P<umi_0>.)"
    assert isinstance(compile_pattern(pattern, "regex"), Slices)
    # umi_0 is position 8 and stands before umi_1 by name; 2-3 are gone, 7 stays.
    assert extracted(spark, pattern, [(READ, MARKS)], "regex") == [("GTT", "iab", "CCA", "TCAAGT", "hjklmn")]


def test_parts_are_matched_in_the_jvm(spark):
    pattern = "(?P<umi_3>[GT]A)C*(?P<cell_1>AT?)(?P<umi_20>.)"
    assert isinstance(compile_pattern(pattern, "regex"), Parts)
    # Leftmost: GA at 2, CC at 4 stay, AT at 6, G at 8; as text umi_20 stands before umi_3.
    assert extracted(spark, pattern, [(READ, MARKS), ("CCCC", "abcd"), (None, "a")], "regex") == [("GGA", "icd", "AT", "TTCCCAAGT", "abefjklmn"), None, None]


def test_others_go_through_the_matcher(spark):
    pattern = "(?P<umi_1>(?:GA|CA){1}).(?P<cell_1>C|T)"
    assert isinstance(compile_pattern(pattern, "regex"), Expression)
    assert extracted(spark, pattern, [(READ, MARKS)], "regex") == [("GA", "cd", "C", "TTCATGCAAGT", "abeghijklmn")]


@pytest.mark.parametrize("pattern", ["(?P<umi_1>A+?)C{1,2}(?P<cell_2>[^G]*)G", "^(?P<umi_1>.{2,4})(?P<discard_1>TT?)", "T(?P<umi_1>.*)T", "(?P<cell_1>[AC]{3})(?P<umi_1>.{0,3}?)G?"])
def test_the_jvm_and_the_matcher_agree(spark, pattern):
    rng = random.Random(len(pattern))
    reads = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 24))) for _ in range(300)]
    rows = [(r, "".join(chr(33 + k) for k in range(len(r)))) for r in reads]
    assert isinstance(compile_pattern(pattern, "regex"), Parts)
    x = F.struct(Expression(pattern).extract(F.col("seq"), F.col("qual")).alias("x"))["x"]
    want = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, seq string, qual string").select("k", x.alias("x")).orderBy("k").collect()
    got = extracted(spark, pattern, rows, "regex")
    assert got == [None if r["x"] is None else tuple(r["x"]) for r in want]
    assert [g is not None for g in got] == [bool(re.search(pattern, r)) for r in reads]


def test_substitution_marks():
    assert exact_pattern("GG{s<=1}TT{s<=0}C{s<=4}") == "G.TT."
