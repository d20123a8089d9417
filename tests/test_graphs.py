"""Golden graphs, drafts from every dialect, and an archive with all kinds of pictures."""

import json

from pyspark.sql import functions as F

from tagloom.operators import graphs, ingest

FULL = {
    "4": {"class_type": "CheckpointLoaderSimple", "inputs": {"ckpt_name": "sub/Best.safetensors"}},
    "10": {"class_type": "LoraLoader", "inputs": {"lora_name": "ink", "strength_model": 0.6, "model": ["4", 0]}},
    "11": {"class_type": "Reroute", "inputs": {"": ["10", 0]}},
    "12": {"class_type": "Power Lora Loader", "inputs": {"lora_name": "oil", "model": ["11", 0]}},
    "5": {"class_type": "EmptyLatentImage", "inputs": {"width": 512, "height": 640}},
    "6": {"class_type": "CLIPTextEncode", "inputs": {"text": "score_9, a cat", "clip": ["4", 1]}},
    "7": {"class_type": "CLIPTextEncode", "inputs": {"text": "blur"}},
    "20": {"class_type": "Odd Name", "inputs": {"steps": 12, "cfg": 4.5, "seed": ["90", 0], "sampler_name": "euler", "scheduler": "karras", "denoise": 0.45, "latent_image": ["21", 0], "model": ["12", 0]}},
    "21": {"class_type": "LatentUpscale", "inputs": {"upscale_method": "bilinear"}},
    "3": {"class_type": "Renamed", "inputs": {"steps": 24, "cfg": 6, "seed": 77, "sampler_name": "euler_ancestral", "scheduler": "normal", "latent_image": ["5", 0], "positive": ["6", 0], "negative": ["7", 0], "model": ["12", 0]}},
    "30": {"class_type": "FaceDetailer", "inputs": {"steps": 1, "cfg": 1, "seed": 1, "sampler_name": "euler", "scheduler": "karras", "model": ["12", 0]}},
    "31": {"class_type": "KSampler Helper", "inputs": {"steps": 9}},
}
CYCLE = {"1": {"class_type": "S", "inputs": {"steps": 1, "cfg": 1, "seed": 1, "sampler_name": "own", "scheduler": "own", "model": ["2", 0], "positive": ["9", 0]}}, "2": {"class_type": "Reroute", "inputs": {"source": ["3", 0], "x": ["4", 0]}}, "3": {"class_type": "LoraLoader", "inputs": {"lora_name": ["5", 0], "model": ["2", 0]}}}
TIES = {
    "b": {"class_type": "S", "inputs": {"steps": 1, "cfg": 1, "seed": 1, "sampler_name": "b", "scheduler": "s", "denoise": 1.0}}, "a": {"class_type": "S", "inputs": {"steps": 1, "cfg": 1, "seed": 1, "sampler_name": "a", "scheduler": "s"}},
    "c": {"class_type": "S", "inputs": {"steps": 1, "cfg": 1, "seed": 1, "sampler_name": "c", "scheduler": "s", "denoise": 0.2}}, "m": {"class_type": "UpscaleModelLoader", "inputs": {"model_name": "R-ESRGAN 4x+.pth"}},
}


def rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id string, text string")


def test_full_graph(spark):
    got = graphs.parsed(rows(spark, {"full": json.dumps(FULL), "bad": "{", "none": json.dumps({"1": {"class_type": "X"}}), "list": "[1]", "null": None})).collect()
    assert [r.id for r in got] == ["full"]
    r = got[0]
    assert (r.prompt, r.negative, r.checkpoint, r.width, r.height) == ("score_9, a cat", "blur", "sub/Best.safetensors", 512, 640)
    assert [(x.name, x.weight) for x in r.loras] == [("oil", 0.8), ("ink", 0.6)]
    assert r.settings == {"Steps": "24", "CFG scale": "6", "Seed": "77", "Sampler": "Euler a", "Schedule type": "Automatic"}
    assert (r.hires.enabled, r.hires.upscaler, r.hires.denoise, r.hires.steps, r.hires.cfg) == (True, "bilinear", 0.45, 12, 4.5)
    assert r.notes == ["second pass on node 20", "detailer node FaceDetailer is not read"]


def test_cycles_ties_and_missing_parts(spark):
    got = {r.id: r for r in graphs.parsed(rows(spark, {"cycle": json.dumps(CYCLE), "ties": json.dumps(TIES)})).collect()}
    r = got["cycle"]
    assert (r.prompt, r.negative, r.checkpoint, r.loras, r.width, r.hires) == ("", "", None, [], None, None)
    assert r.settings["Sampler"] == "own" and r.notes == ["the latent isn't empty, so the size is unknown"]
    assert got["ties"].settings["Sampler"] == "b" and got["ties"].hires.denoise == 0.2 and got["ties"].hires.upscaler == "R-ESRGAN 4x+"


def test_chain_order_and_stop(spark):
    nodes = graphs.nodes(rows(spark, {"full": json.dumps(FULL)}))
    path = graphs.walk(graphs.steps(nodes), spark.createDataFrame([("full", "12"), ("full", "4"), ("full", "lost")], "graph string, node string"))
    assert sorted((r.start, r.depth, r.node) for r in path.collect()) == [("12", 0, "12"), ("12", 1, "11"), ("12", 2, "10"), ("12", 3, "4"), ("4", 0, "4")]


def test_drafts_of_tabs_hires_and_upscalers(spark):
    text = (
        "x\nSteps: 3, Hires upscaler: R-ESRGAN 4x+, ADetailer model: face.pt, ADetailer prompt: \"a, b\", ADetailer confidence: 0.5, ADetailer inpaint padding: 48.0, "
        "ADetailer model 2nd: None, ADetailer model 3rd: hand.pt, ADetailer denoising strength 3rd: 0.2, ADetailer negative prompt 3rd: bad"
    )
    parsed = ingest.infotext(rows(spark, {"1": text, "2": "y\nSteps: 3, Hires upscaler: Lost", "3": "z"}))
    installed, names = spark.createDataFrame([], "name string, nth int"), spark.createDataFrame([("RealESRGAN_x4plus",), ("Other",)], "name string")
    got = {r.id: r for r in ingest.drafts(parsed, installed, names).collect()}
    assert [tuple(t) for t in got["1"].tabs] == [(True, "face.pt", "a, b", None, 0.5, None, 48), (True, "hand.pt", None, "bad", None, 0.2, None)]
    assert (got["1"].hires_enabled, got["1"].upscaler) == (True, "RealESRGAN_x4plus") and got["1"].notes == ["Steps 3 is left to the shared ratios"]
    assert got["2"].upscaler == ingest.UPSCALER and got["2"].notes[0].startswith("upscaler Lost is not installed")
    assert (got["3"].hires_enabled, got["3"].upscaler, got["3"].tabs) == (False, ingest.UPSCALER, [])
    free = {r.id: r.upscaler for r in ingest.drafts(parsed, installed).collect()}
    assert free == {"1": "R-ESRGAN 4x+", "2": "Lost", "3": ingest.UPSCALER}


def test_archive(spark, tmp_path):
    from test_sources import png

    from tagloom.sources import scan

    files = {
        "one": png([(b"tEXt", b"parameters\0a masterpiece\nNegative prompt: n\nSteps: 3, Model: best")]), "two": png([(b"tEXt", b"prompt\0" + json.dumps(FULL).encode())]), "three.v1": png([]), "four": png([(b"tEXt", b"parameters\0")]),
        "five": b"text", "six": png([(b"tEXt", b"prompt\0{}")]), "seven": png([]),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    at = lambda f: f"file:{tmp_path}/{f}"
    sides = spark.createDataFrame([("three.meta.json", at("three.meta.json"), json.dumps({"parameters": "beside\nSteps: 9"})), ("seven.png.meta.json", at("seven.png.meta.json"), json.dumps({"parameters": ""}))], "file string, path string, text string")
    metadata = scan.png_metadata(spark, f"file:{tmp_path}/*.png")
    installed = spark.createDataFrame([("models/best.safetensors", 0)], "name string, nth int")
    drafts, rejects = ingest.ingest_archive(metadata, sides, installed)
    name = lambda p: p.rsplit("/", 1)[1].removesuffix(".png")
    got = {name(r.id): (r.format, r.prompt, r.checkpoint) for r in drafts.collect()}
    assert got == {"one": ("infotext", "a masterpiece", "models/best.safetensors"), "two": ("graph", "score_9, a cat", "models/best.safetensors"), "three.v1": ("infotext", "beside", ingest.NO_CHECKPOINT)}
    why = {name(r.path): r.reason for r in rejects.collect()}
    assert why == {"four": "no settings in the picture or beside it", "five": "no readable picture", "six": "no sampler in the graph", "seven": "no settings in the picture or beside it"}
    told = {(r.dialect, r.base): r.n for r in ingest.census(ingest.dispatch(metadata, sides)[0]).collect()}
    assert told[None, None] == 4 and told["infotext", "illustrious"] == 1 and told["graph", "pony"] == 1 and told["sidecar", "other"] == 1


def test_tidy_prompts(spark):
    from tagloom.functions import text as t

    cases = {"a,\nBREAK b,": "a\nBREAK b", "a, \n \n BREAK\nb": "a\nBREAK\nb", " a ": "a", "a,b": "a,b", "x,\ny": "x,\ny", "": "", ",": ""}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").select("raw", "want", t.tidy(F.col("raw")).alias("got"))
    assert [(r.raw, r.got) for r in df.collect()] == list(cases.items())
