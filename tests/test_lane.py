import pytest

from tagloom.operators import lane

CASES = {
    "a cat, masterpiece, Best-Quality": ("score_9, score_8_up, score_7_up, score_6_up, source_cartoon, solo, 1girl, a cat", ["strip", "add", "add", "add"]),
    "score_9, source_anime, 1girl": ("score_9, source_cartoon, 1girl", ["normalize", "add"]),
    "score_9, source_cartoon, source_anime, 1girl": ("score_9, source_cartoon, 1girl", ["strip", "add"]),
    "score_9, score_4_up, 1girl": ("score_9, score_4_up, source_cartoon, 1girl", ["add", "flag", "add"]),
    "score_9_up, solo, 2girls": ("score_9, score_8_up, score_7_up, score_6_up, source_cartoon, score_9_up, solo, 2girls", ["add", "flag", "add"]),
    "": ("score_9, score_8_up, score_7_up, score_6_up, source_cartoon, solo, 1girl", ["add", "add", "add"]),
    "score_9, 1girl, one BREAK sky, man": ("score_9, source_cartoon, 1girl, one\nBREAK\nsky, man", ["add", "flag", "add"]),
}
KIND = "doc_id long, prompt string, loras array<struct<name:string,weight:double>>"


@pytest.fixture(scope="module")
def translated(spark):
    rows = [(k, p, None) for k, p in enumerate(CASES)] + [(90, "1girl, <lora:ink:0.7>, <lora:x:bad>", [("your style lora.safetensors", 0.3), (" ", 1.0)]), (91, None, None)]
    return {r.doc_id: r for r in lane.translate(spark.createDataFrame(rows, KIND)).collect()}


def test_prompts_and_receipts(translated):
    for k, (prompt, ops) in enumerate(CASES.values()):
        assert (translated[k].prompt, [c.op for c in translated[k].changes]) == (prompt, ops)


def test_loras(translated):
    r = translated[90]
    assert [(x.name, x.weight) for x in r.loras] == [(lane.LORA, 0.8), ("ink", 0.7), ("x", 0.8)] and "lora" not in r.prompt
    assert [c.op for c in r.changes] == ["strip", "add", "normalize", "keep"]
    assert translated[91].prompt == translated[5].prompt


def test_translating_twice_changes_nothing(spark, translated):
    again = lane.translate(spark.createDataFrame([(k, r.prompt, [(x.name, x.weight) for x in r.loras]) for k, r in translated.items()], KIND))
    assert {r.doc_id: r.prompt for r in again.collect()} == {k: r.prompt for k, r in translated.items()}
