"""Many patterns at once against the chain of them all."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.pattern_filter import literal_of, redact_many
from millrace.functions.redaction import SECRET


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [
        ("secret-\\d+", "secret-"), ("ab?cde", "cde"), ("ab+cd", "ab"), ("ab{0,3}cd", "cd"), ("xyz{2}", "xyz"), ("a|bcd", None), ("(?i)secret", None), ("(abc|d)efg", "efg"),
        ("[abc]de\\.f", "de.f"), ("\\Qa.b\\E", None), ("a\\x41bc", None), ("[[a-z]&&[^b]]xy", "xy"), ("(?:ab)*", None), ("(?=abc)\\w+", None), ("a.b", "a"), ("\\bword\\b", "word"), ("^start$", "start"), ("(a[)]b)cd", "cd"), ("", None),
    ],
)
def test_literal_of_a_pattern(pattern, literal):
    assert literal_of(pattern) == literal


def test_many_patterns_equal_the_chain(spark):
    patterns = [f"key{i:04d}-[a-z]+" for i in range(1500)] + ["x(?:a|b)y", "RED[A-Z]+", "z\\[", "(", "\\d{4}q?", "ET\\]\\w", "b*w", "(?i)TOKEN", "end\\b"]
    texts = [None, "", "plain", "key0007-abc and key1499-z9", "xay xby", "a key0001-k]w", "REDUCED", "z[key0002-aend", "1234q token end", "SECRET]a key0003-qa", "bbbw"]
    want = []
    for text in texts:
        for pattern in patterns:
            if text is not None and pattern != "(":
                text = re.sub(pattern, SECRET, text)
        want.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("other", F.lit("key0001-a")).repartition(3)
    have = redact_many(df, "text", patterns)
    assert have.columns == ["n", "text", "other"]
    assert [r["text"] for r in have.orderBy("n").collect()] == want and {r["other"] for r in have.collect()} == {"key0001-a"}
    assert [r["text"] for r in redact_many(df, "text", []).orderBy("n").collect()] == texts
