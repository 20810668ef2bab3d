import pytest
from pyspark.sql import types as T

#: Texts every operator has to get along with; ids repeat, rows repeat, columns clash.
ODD = [
    None, "", " ", "\n", "\n\n \n", "a", "a b", "a  b", " a b ", "a\n b\n", "\ta\tb\x0b\x0cc\r\n", "x" * 5000,
    "word " * 3000, "ä ß ☃ 日本語 🙂", "▁ a▁b", "<s> </s> <unk> <0x41>", "\x00 \x1f \x7f", "a\u00a0b\u3000c",
    "The same words. " * 40, "The same words. " * 40, "l1 a\nl2 b\nl1 a\n", '{"json": [1, 2]}', "# $ % & | < > *" * 9,
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i if i % 7 != 5 else None, t, "clash", -i) for i, t in enumerate(ODD)] + [(2, " ", "clash", 0)]
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.StringType()),
            T.StructField("count", T.IntegerType()),
        ]
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
