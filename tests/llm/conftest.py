from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_lines long, lines_removed long"

#: Null and empty texts, null and repeated ids, blanks, odd white space, special tokens, very long texts and words.
ODD = [
    (10_000, None), (10_001, ""), (10_002, " \n\t "), (10_003, "\n\n\n"), (10_004, "x\x1cy \x1d z w v\u0085u"), (10_005, "I'm <|endoftext|> he's <|startoftext|> <|ENDOFTEXT|>"),
    (10_006, "a ́é H̱ ẖ K İ ΣΑΣ"), (10_007, "12,3.4 '!' !' don't!! (a)_b ...…! été«!»"), (10_008, "word " * 30_000), (10_009, "ab" * 40_000),
    (10_010, "\U0001f600\U0001f600 中文字 \n\n 字\n\n\n"), (10_011, "same text here twice over"), (10_012, "same text here twice over"), (10_013, "12345 !!! ..."),
    (None, "no id one"), (None, "no id two"), (None, None), (10_014, "a repeated row"), (10_014, "a repeated row"), (10_015, "one"), (10_016, "a  b   c \n d \n\n  e  "),
]


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    return ODD


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """Some documents and the odd rows, with columns that clash with those the operators add."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, None, "zz", 7, 7) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(i, t, None if k % 3 else "en", "s", None, 0.5, None, 1, None) for k, (i, t) in enumerate(ODD)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
