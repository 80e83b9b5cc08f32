"""Small hostile tables shared by the tests of the training-data operators."""

import random

from pyspark.sql import types as T

DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("score", T.DoubleType()),
        T.StructField("name", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tie", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("lang_pred", T.StringType()),
    ]
)

WORDS = "the of and river stone idle garden quiet lamp winter copper signal harbor violet engine meadow thunder paper silver northern".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) * (rng.random() < 0.6) for _ in range(n))


def edge_texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = sentence(rng, 60)
    rows: list[tuple[int | None, str | None]] = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "two  words"),
        (6, "Two words"),
        (7, base),
        (8, base.upper()),
        (9, near),
        (10, base),
        (11, sentence(rng, 40) + " " + passage + " " + sentence(rng, 40)),
        (12, sentence(rng, 50) + " " + passage),
        (13, passage + " " + passage),
        (14, "12345 6789 !!!"),
        (15, "日本語 テキスト \U0001f600 é ﬁ"),
        (16, "x" * 3000),
        (17, sentence(rng, 20_000)),
        (18, "a b c d e"),
        (19, "a b c d e f"),
        (20, "ab " * 400),
        (21, "<|endoftext|> it's <|startoftext|>\x1f\x85 end"),
        (21, "<|endoftext|> it's <|startoftext|>\x1f\x85 end"),
        (22, "o'clock\r\nnext\x0bline\x0cfeed"),
        (None, "a row without an id"),
    ]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 200))) for i in range(30)]
    rows += [(200 + i, near + " tail" * (i % 3)) for i in range(12)]
    return rows


def doc_frame(spark, rows, langs=("en", "fr", None)):
    data = [(i, t, langs[k % len(langs)] if i is not None else None, None if k % 5 == 0 else "s", None if t is None else len(t), 0.5, "n", k, "k", "t", "s", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOC_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
