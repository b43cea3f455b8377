import pytest
from pyspark.sql import functions as F

from corpusmill.functions import tokens as K
from corpusmill.operators import costing


@pytest.fixture
def models(spark):
    return spark.createDataFrame(
        [("gpt-4o", 0.0025, 128000), ("claude-3-5", 0.003, 200000)],
        "base_name string, input_cost_1k double, context_window int",
    )


def test_costs_and_limits(spark, models):
    usage = spark.createDataFrame(
        [("a", "gpt-4o", 2000), ("b", "nobody", 5000), ("c", "gpt-4o", 0), ("d", "gpt-4o", -5),
         ("e", "claude-3-5", 200001), ("f", "nobody", 4096)],
        "project string, target_model string, n_tokens long",
    )
    rows = {r.project: (r.cost_usd, r.context_limit, r.over_limit) for r in costing.with_cost(usage, models).collect()}
    assert rows == {
        "a": (0.005, 128000, False), "b": (0.0, 4096, True), "c": (0.0, 128000, False), "d": (0.0, 128000, False),
        "e": (200001 / 1000 * 0.003, 200000, True), "f": (0.0, 4096, False),
    }


def test_stored_count_wins(spark):
    df = spark.createDataFrame([(0, 4000), (7, None), (7, 0)], "now long, stored long")
    tokens = costing.effective_tokens(F.col("now"), F.col("stored"))
    got = df.select(costing.cost(tokens, F.lit(0.0025))).collect()
    assert [r[0] for r in got] == [0.01, 7 / 1000 * 0.0025, 0.0]


def test_bad_price_costs_nothing(spark):
    df = spark.createDataFrame([("x",), ("0.5",), (None,)], "price string")
    assert [r[0] for r in df.select(costing.cost(F.lit(1000), F.col("price"))).collect()] == [0.0, 0.5, 0.0]


def test_heuristic(spark):
    df = spark.createDataFrame([("",), (None,), ("a",), ("abcd",), ("abcde",), ("é" * 8,)], "t string")
    assert [r[0] for r in df.select(K.heuristic_tokens(F.col("t"))).collect()] == [0, 0, 1, 1, 2, 2]


def test_encoding_names(spark):
    df = spark.createDataFrame([("gpt-4o",), ("GPT-4-turbo",), ("gpt-3.5-turbo",), ("Legacy X",), ("gpt-4",)], "m string")
    assert [r[0] for r in df.select(K.encoding_name(F.col("m"))).collect()] == [
        "o200k_base", "cl100k_base", "cl100k_base", "cl100k_base", "o200k_base",
    ]


def test_byte_pairs_and_fallback(spark):
    # Local functions reach the workers by value, test modules would not.
    def tiny_encoder():
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257}
        return tiktoken.Encoding(
            "tiny", pat_str=r"[a-z]+|[^a-z]", mergeable_ranks=ranks, special_tokens={"<|end|>": 300}
        )

    def broken_encoder():
        raise OSError("no vocabulary")

    df = spark.createDataFrame([("abab",), ("abab c",), ("",), (None,), ("<|end|>",)], "t string")
    exact = [r[0] for r in df.select(K.bpe_tokens(F.col("t"), tiny_encoder)).collect()]
    assert exact == [1, 3, 0, 0, 7]
    rough = [r[0] for r in df.select(K.bpe_tokens(F.col("t"), broken_encoder)).collect()]
    assert rough == [1, 2, 0, 0, 2]


def test_missing_vocabulary_falls_back(spark, tmp_path):
    df = spark.createDataFrame([("abcdefgh",)], "t string")
    assert df.select(K.model_tokens(F.col("t"), "gpt-4o", str(tmp_path))).first()[0] == 2
    assert df.select(K.model_tokens(F.col("t"), "gpt-4o", None)).first()[0] == 2


def test_a_broken_vocabulary_is_an_error(tmp_path):
    assert K.token_method("gpt-4o", str(tmp_path)) == K.HEURISTIC
    (tmp_path / "o200k_base.pattern").write_text(r"\S+|\s+")
    (tmp_path / "o200k_base.tiktoken").write_text("YQ== zero\n")
    with pytest.raises(ValueError):
        K.token_method("gpt-4o", str(tmp_path))
