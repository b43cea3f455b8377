import json
import random

from pyspark.sql import functions as F

from corpusmill.operators import catalogue as C

RAW = {
    "sample_spec": {"mode": "chat", "max_tokens": "a number"},
    "azure/gpt-4o": {"mode": "chat", "litellm_provider": "azure", "input_cost_per_token": 1e-6, "max_input_tokens": 1000},
    "gpt-4o": {"mode": "Chat", "litellm_provider": "openai", "input_cost_per_token": 2.5e-6,
               "output_cost_per_token": 1e-5, "max_input_tokens": 128000, "max_tokens": 16384},
    "openrouter/openai/gpt-4o": {"mode": "chat", "litellm_provider": "openrouter"},
    "claude-3-5": {"mode": "chat", "litellm_provider": "anthropic", "max_tokens": 200000, "input_cost_per_token": 3e-6},
    "bedrock/claude-3-5": {"mode": "chat", "litellm_provider": "bedrock_converse"},
    "bedrock/only": {"mode": "completion", "litellm_provider": "bedrock", "max_input_tokens": 0},
    "vertex_ai/only": {"mode": "completion", "litellm_provider": "vertex_ai"},
    "embed": {"mode": "embedding", "litellm_provider": "openai"},
    "modeless": {"litellm_provider": "openai"},
    "not-an-object": "text",
    "null-price": {"mode": "chat", "input_cost_per_token": None, "max_input_tokens": 0, "max_tokens": 0},
}


def snapshot(tmp_path, raw=RAW):
    path = tmp_path / "models.json"
    path.write_text(json.dumps(raw, indent=1))
    return str(path)


def test_normalize_and_dedupe(spark, tmp_path):
    models = {r.base_name: r for r in C.canonical(C.normalize(C.read_snapshot(spark, snapshot(tmp_path)))).collect()}
    assert set(models) == {"gpt-4o", "claude-3-5", "only", "null-price"}
    best = models["gpt-4o"]
    assert (best.id, best.provider, best.context_window) == ("gpt-4o", "OPENAI", 128000)
    assert (best.input_cost_1k, best.output_cost_1k) == (2.5e-6 * 1000, 1e-5 * 1000)
    assert (models["claude-3-5"].id, models["claude-3-5"].context_window) == ("claude-3-5", 200000)
    assert (models["only"].id, models["only"].provider, models["only"].context_window) == ("bedrock/only", "AWS (BEDROCK)", 4096)
    plain = models["null-price"]
    assert (plain.provider, plain.input_cost_1k, plain.context_window) == ("UNKNOWN", 0.0, 4096)


def test_dedupe_matches_a_loop(spark):
    rng = random.Random(5)
    names = ["OPENAI", "AZURE", "AWS (BEDROCK)", "GOOGLE (VERTEX)", "GOOGLE", "AWS (SAGEMAKER)"]
    rows = [(i, f"m{rng.randint(0, 60)}", f"id{i}", rng.choice(names), 1.0, 1.0, 1) for i in range(600)]
    df = spark.createDataFrame(
        rows, "seq long, base_name string, id string, provider string, input_cost_1k double, "
        "output_cost_1k double, context_window int")
    got = {r.base_name: r.id for r in C.canonical(df).collect()}
    infra = lambda p: any(k in p for k in ("AZURE", "BEDROCK", "VERTEX", "SAGEMAKER"))
    kept = {}
    for _, base, mid, provider, *_ in rows:
        if base not in kept or (infra(kept[base][1]) and not infra(provider)):
            kept[base] = (mid, provider)
    assert got == {base: mid for base, (mid, _) in kept.items()}


def test_tiers(spark, tmp_path):
    raw = snapshot(tmp_path)
    stored = str(tmp_path / "curated")
    assert C.first_available(spark, stored, None).count() == 0
    assert C.first_available(spark, None, str(tmp_path / "missing.json")).count() == 0
    from_raw = C.first_available(spark, stored, raw)
    assert from_raw.count() == 4
    from_raw.where("base_name = 'only'").write.parquet(stored)
    assert [r.base_name for r in C.first_available(spark, stored, raw).collect()] == ["only"]


def test_merge_and_provider_lists(spark, tmp_path):
    models = C.canonical(C.normalize(C.read_snapshot(spark, snapshot(tmp_path))))
    live = models.where("base_name = 'gpt-4o'").withColumn("input_cost_1k", F.lit(9.0))
    merged = {r.base_name: r.input_cost_1k for r in C.merge_live(models, live).collect()}
    assert len(merged) == 4 and merged["gpt-4o"] == 9.0
    assert [r.provider for r in C.providers(models).collect()] == ["ANTHROPIC", "AWS (BEDROCK)", "OPENAI", "UNKNOWN"]
    wanted = spark.createDataFrame([("OPENAI",), ("NOBODY",)], "provider string")
    rows = {(r.provider, r.model) for r in C.models_by_provider(models, wanted).collect()}
    assert ("NOBODY", "-- No Models --") in rows and ("OPENAI", "gpt-4o") in rows and len(rows) == 5
