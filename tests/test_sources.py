import json
import struct
import zlib

from pyspark.sql import functions as F

from tagloom.functions import text as t
from tagloom.operators import ingest, lint, sections, similar
from tagloom.sources import scan


def png(chunks):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    body = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0))
    body += b"".join(chunk(k, d) for k, d in chunks)
    return body + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(range(12)) for _ in range(3)))) + chunk(b"IEND", b"")


def test_tree_tickets_and_chunks(spark, tmp_path):
    at = tmp_path / "out" / "mia" / "base"
    at.mkdir(parents=True)
    (at / "1_7.png").write_bytes(png([(b"tEXt", b"parameters\0a cat\nSteps: 3")]))
    (at / "2_8.png").write_bytes(png([(b"tEXt", b"prompt\0{}"), (b"zTXt", b"note\0\0" + zlib.compress(b"x"))]))
    (at / "3_9.png").write_bytes(png([]))
    (at / "4.png").write_bytes(b"not a png")
    (at / "1_7.json").write_text(json.dumps({"profile": "base", "file": "1_7.png", "seed": 7, "effective_settings": {"prompt": "a cat", "steps": 3}}, indent=1))
    (at / "2_8.json").write_text("{broken")
    (tmp_path / "out" / "mia" / "stray.png").write_bytes(b"")
    root = f"file:{tmp_path}/out"
    seen = {r.file: r for r in scan.renders(spark, root).collect()}
    assert set(seen) == {"1_7.png", "2_8.png", "3_9.png", "4.png"} and seen["1_7.png"].character == "mia" and seen["1_7.png"].name == "base"
    tickets = scan.tickets(spark, root).collect()
    assert [(r.stem, r.seed, r.effective_settings.steps) for r in tickets] == [("1_7", 7, 3)]
    meta = {r.path.rsplit("/", 1)[1]: r.dialect for r in scan.png_metadata(spark, f"{root}/*/*/*.png").collect()}
    assert meta == {"1_7.png": "infotext", "2_8.png": "graph", "3_9.png": None, "4.png": None}


def test_index_notes_models_and_tags(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"items": {"a/b/c.png": {"rating": 4, "tags": ["x"]}, "d": {}}}))
    rows = {r.key: r for r in scan.library_index(spark, f"file:{tmp_path}/index.json").collect()}
    assert rows["a/b/c.png"].rating == 4 and rows["d"].rating == 0 and rows["d"].tags == [] and rows["d"].favorite is False
    (tmp_path / "bad.json").write_text("oops")
    assert scan.library_index(spark, f"file:{tmp_path}/bad.json").count() == 0
    (tmp_path / "tags.csv").write_text('cat,0,90,"kitty,feline"\nCat,0,5,\ndog,4,bad,"kitty"\n,0,4,\nshort\n')
    dump = scan.tag_dump(spark, f"file:{tmp_path}/tags.csv")
    assert sorted((r.tag, r.cnt, r.aliases) for r in dump.collect()) == [("cat", 90, ["kitty", "feline"]), ("dog", 0, ["kitty"])]
    assert {r.alias: r.tag for r in scan.alias_table(dump).collect()} == {"kitty": "cat", "feline": "cat"}
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "one.md").write_text("---\ntitle: 'One'\ntags: [a, b]\n  indented: no\n---\nbody [[two|label]] and [[three]]\n")
    (vault / "two.md").write_text("# Two\ntext")
    notes = {r.id: r for r in ingest.frontmatter(scan.notes(spark, f"file:{vault}/*.md")).withColumn("links", ingest.wiki_links(F.col("body"))).withColumn("list", ingest.list_value(F.try_element_at("meta", F.lit("tags")))).collect()}
    assert notes["one"].title == "One" and notes["one"].meta["tags"] == "[a, b]" and notes["one"].links == ["three", "two"] and notes["one"].list == ["a", "b"] and "indented" not in notes["one"].meta
    assert notes["two"].title == "Two" and notes["two"].body == "# Two\ntext"
    models = tmp_path / "models"
    (models / "sub" / ".cache").mkdir(parents=True)
    for name in ("top.safetensors", "sub/in.safetensors", "sub/._in.safetensors", "sub/.cache/x.safetensors"):
        (models / name).write_bytes(b"x")
    cache = spark.createDataFrame([("top", "https://x")], "name string, url string")
    got = sorted((r.name, r.folder, r.enriched) for r in scan.models(spark, f"file:{models}", cache).collect())
    assert got == [("in", "sub", False), ("top", "(root)", True)]


def test_sidecar_tiers(spark):
    files = spark.createDataFrame([("/a/x.1.png", "x.1.png"), ("/b/y.png", "y.png"), ("/c/z.png", "z.png")], "path string, file string")
    sides = spark.createDataFrame([("x.meta.json", "/a/x.meta.json", "own"), ("x.meta.json", "/q/x.meta.json", "far"), ("y.meta.json", "/q/y.meta.json", "elsewhere")], "file string, path string, text string")
    assert {r.file: r.text for r in scan.sidecar_fallback(files, sides).collect()} == {"x.1.png": "own", "y.png": "elsewhere", "z.png": None}


def test_infotext(spark):
    text = 'a cat, hat,\nBREAK\nsky <lora:ink:0.7>\nNegative prompt: blur\nSteps: 24, Sampler: Euler a, Seed: 7, Size: 768x1024, Lora hashes: "a: 1, b: 2", Steps: 30'
    rows = ingest.infotext(spark.createDataFrame([(text,), ("only a prompt",)], "text string")).collect()
    assert rows[0].prompt == "a cat, hat,\nBREAK\nsky <lora:ink:0.7>" and rows[0].negative == "blur"
    assert rows[0].settings == {"Sampler": "Euler a", "Seed": "7", "Size": "768x1024", "Lora hashes": "a: 1, b: 2", "Steps": "30"}
    assert rows[1].prompt == "only a prompt" and rows[1].negative == "" and rows[1].settings == {}
    bare = spark.createDataFrame([(text,)], "text string").select(t.strip_loras(F.lit("<lora:a:1>, x, <lora:b:2>,\nBREAK y,")).alias("s")).first().s
    assert "lora" not in bare and not bare.endswith(",")


def test_sections_round_trip(spark):
    prompt = "score_9, sharp\nportrait, 50mm\nBREAK\nred hair, blue eyes\nblack coat, 1boy\nBREAK\nforest at night\nrim light"
    lines = sections.parse(spark.createDataFrame([(1, prompt)], "doc_id long, prompt string"))
    got = [(r.text, r.section) for r in lines.orderBy("seg", "line").collect()]
    assert [s for _, s in got] == ["quality", "keystone", "character", "secondary", "setting", "lighting"]
    once = sections.compose(lines).first().prompt
    again = sections.compose(sections.parse(spark.createDataFrame([(1, once)], "doc_id long, prompt string"))).first().prompt
    assert once == "score_9, sharp,\nportrait, 50mm,\nBREAK\nred hair, blue eyes,\nBREAK\nblack coat, 1boy,\nBREAK\nforest at night,\nrim light,"
    assert [s for _, s in sorted((r.line + 10 * r.seg, r.section) for r in sections.parse(spark.createDataFrame([(1, once)], "doc_id long, prompt string")).collect())] == ["quality", "keystone", "character", "secondary", "setting", "lighting"]
    assert once == again


def test_lint_rules_fire(spark):
    prompt = "red hair, blue hair, dress, long dress, smiling, grin, sky, sky, big sky, sky blue, sky tower"
    raws = spark.createDataFrame([(1, prompt)], "doc_id long, prompt string").select("doc_id", F.posexplode(t.lint_tokens(F.col("prompt"))).alias("pos", "raw")).withColumn("norm", t.base_form(F.col("raw")))
    long = spark.createDataFrame([(1, "clear water, deep water, water fall")], "doc_id long, prompt string").select("doc_id", F.posexplode(t.lint_tokens(F.col("prompt"))).alias("pos", "raw")).withColumn("norm", t.base_form(F.col("raw")))
    found = {(r.kind, r.target): r.points for r in lint.findings(raws, raws.limit(0)).collect()}
    assert found == {("duplicate", "sky"): 20, ("overlap", "grin"): 12, ("color-conflict", "hair"): 12, ("subsumed", "dress"): 6}
    assert [(r.target, r.points) for r in lint.repeats(long).collect()] == [("water", 3)]
    kept = lint.unprotected(raws, ["sky"])
    assert ("duplicate", "sky") not in {(r.kind, r.target) for r in lint.findings(kept, raws.limit(0)).collect()}


def test_banded_pairs_and_greedy_groups(spark):
    import random

    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    hashes = {k: rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for k in range(80)}
    signed = [(k, h - (1 << 64) if h >> 63 else h) for k, h in ((k, h & (1 << 64) - 1) for k, h in hashes.items())]
    keyed = spark.createDataFrame(signed, "key long, h long")
    reps = {}
    for k, h in signed:
        reps.setdefault(h, k)
    by_key = {k: h & (1 << 64) - 1 for h, k in reps.items()}
    for threshold in (3, 6):
        pairs = similar.near_pairs(similar.classes(keyed), threshold)
        want = {(a, b) for a in by_key for b in by_key if a < b and bin(by_key[a] ^ by_key[b]).count("1") <= threshold}
        assert {(r.a, r.b) for r in pairs.collect()} == want
        leaders, groups = [], {}
        for k in sorted(by_key):
            near = [x for x in leaders if (x, k) in want]
            if near:
                groups[k] = min(near)
            else:
                leaders.append(k)
        groups |= {x: x for x in groups.values()}
        assert {r.member: r.leader for r in similar.greedy_groups(pairs).collect()} == groups


def test_lora_merge_and_strip(spark):
    prompt = "a cat <lora:ink:0.7>, sky,\nBREAK\nrain <lora:oil:1>, <lora:ink:0.9>"
    given = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).cast("double").alias("weight")) for n, w in (("oil", 0.5), ("new", None), ("", 1.0))])
    row = spark.createDataFrame([(prompt,)], "p string").select(t.merge_loras(F.col("p"), given).alias("merged"), t.strip_loras(F.col("p")).alias("bare"), t.merge_loras(F.lit("<lora:a:1>"), F.slice(given, 1, 0)).alias("only"), t.merge_loras(F.lit("plain, "), F.when(F.lit(False), given)).alias("plain")).first()
    assert row.merged.endswith("<lora:ink:0.9>,\n<lora:oil:0.5>,\n<lora:new:0.8>") and row.merged.count("<lora") == 3
    assert "lora" not in row.bare and row.only == "<lora:a:1>" and row.plain == "plain"


def test_removals_keep_lines_and_breaks(spark):
    prompts = spark.createDataFrame([(1, "sky, cat,\nsky,\nhat, Sky\nBREAK\nsky, (sky:1.2), end"), (2, "a, a"), (3, "x\nBREAK\nx")], "doc_id long, prompt string")
    chosen = spark.createDataFrame([(1, False, "sky", 1), (1, False, "sky", 2), (3, False, "x", 1)], "doc_id long, negative boolean, norm string, n long")
    budgets = lint.budgets(chosen)
    assert [(r.doc_id, r.budget) for r in budgets.orderBy("doc_id").collect()] == [(1, 3), (3, 1)]
    worst = lint.budgets(chosen.withColumn("negative", F.lit(True)))
    assert sorted(r.budget for r in worst.collect()) == [1, 2]
    got = {r.doc_id: r.prompt for r in lint.apply_removals(prompts, budgets).collect()}
    assert got == {1: "sky, cat,\nhat,\nBREAK\n(sky:1.2), end", 2: "a, a", 3: "x"}


def test_findings_order_and_tags_of_stats(spark):
    token = lambda text: spark.createDataFrame([(1, text)], "doc_id long, p string").select("doc_id", F.posexplode(t.lint_tokens(F.col("p"))).alias("pos", "raw")).withColumn("norm", t.base_form(F.col("raw")))
    prompt, negative = token("grin, sky, smiling, dress, red hair, long dress, blue hair, sky, (Grinning:1.2), hat, hat"), token("bad, bad")
    names = lambda **k: [(r.kind, r.target, r.points) for r in lint.report(prompt, negative, **k).orderBy("rank").collect()]
    assert names() == [("duplicate", "sky", 20), ("duplicate", "hat", 20), ("negative-duplicate", "bad", 20), ("overlap", "smiling", 12), ("overlap", "grin", 12), ("color-conflict", "hair", 12), ("subsumed", "dress", 6)]
    assert names(protected=["(SKY)", "Grin", ""]) == [("duplicate", "hat", 20), ("negative-duplicate", "bad", 20), ("color-conflict", "hair", 12), ("subsumed", "dress", 6)]
    from tagloom.operators import stats

    tokens = spark.createDataFrame([("positive", "mia", x) for x in ("<lora:x:0.8>", "Blue Sky", "blue-sky", "score_9", "(hat:1.1)")], "polarity string, character string, raw string")
    assert sorted((r.tag, r.cnt, r.overall) for r in stats.tag_counts(tokens).collect()) == [("blue_sky", 2, 0), ("blue_sky", 2, 1), ("hat", 1, 0), ("hat", 1, 1)]
    pairs = stats.cooccurrence(spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["a", "b", "c"]), (3, []), (4, None), (5, ["c"])], "id int, tags array<string>"), "id", 2)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 2)]
    renders = spark.createDataFrame([("m", 1, ["a", "b", "a", ""]), ("m", 2, ["c", "a"]), ("m", 3, [""]), ("n", 4, ["z"])], "character string, doc_id int, tags array<string>")
    core = stats.consolidate(renders, 0.6)
    assert sorted(map(tuple, core.collect())) == [("m", "a", 2, 2), ("n", "z", 1, 1)]
    assert sorted((r.doc_id, r.line) for r in stats.variations(renders, core).collect()) == [(1, "b"), (2, "c"), (3, ""), (4, "")]


def test_suggestions_of_any_length(spark):
    from tagloom.operators.suggest import suggest_all

    dump = spark.createDataFrame([("green_dress", 9, "robe"), ("green_hat", 5, "x"), ("red_hat", 7, "y"), ("g", 1, "z")], "tag string, cnt long, alias string")
    got = suggest_all(dump, spark.createDataFrame([("g",), ("green_ball_gown",), ("robe",), ("none_such",)], "q string"), 3)
    assert sorted((r.q, r["rank"], r.tag, r.tier) for r in got.collect()) == [("g", 1, "g", 1), ("g", 2, "green_dress", 3), ("g", 3, "green_hat", 3), ("green_ball_gown", 1, "green_dress", 6), ("green_ball_gown", 2, "green_hat", 6), ("robe", 1, "green_dress", 2)]


def test_suggestions_of_frequent_beginnings(spark):
    """Each query's candidates are at most those that begin with it, as soon as they are enough; a tag of two rows has one place."""
    from tagloom.operators import suggest

    rows = [(f"ab{k:03}", 500 - k, f"{k:03}ba") for k in range(300)] + [("xxab0", 900, "p"), ("twice_x", 3, "q"), ("twice_x", 8, "r"), ("zzlongtailzz", 1, "s")]
    dump = spark.createDataFrame(rows, "tag string, cnt long, alias string")
    asked = spark.createDataFrame([("ab",), ("ab",), ("xab",), ("ab0",), ("r",), ("longtail",), ("twice_y",), ("00ba",)], "q string")
    got = {}
    for r in sorted(suggest.suggest_all(dump, asked, 3).collect(), key=lambda r: (r.q, r["rank"])):
        got.setdefault(r.q, []).append((r.tag, r.tier))
    assert got == {
        "ab": [("ab000", 3), ("ab001", 3), ("ab002", 3)], "xab": [("xxab0", 4)], "ab0": [("ab000", 3), ("ab001", 3), ("ab002", 3)], "r": [("twice_x", 2)],
        "longtail": [("zzlongtailzz", 4)], "twice_y": [("twice_x", 6)], "00ba": [("ab000", 5), ("ab100", 5), ("ab200", 5)],
    }


def test_drafts(spark):
    text = "a cat <lora:ink:0.7>, score_9, <lora:ink:0.2> <lora:odd:x>,\nNegative prompt: blur\nSteps: 24, Seed: 7.0, Size: 512x640, Model: sub\\\\Best, Sampler: DPM"
    parsed = ingest.infotext(spark.createDataFrame([(1, text), (2, "b\nSteps: 3, Seed: no, Model: lost"), (3, "c")], "id long, text string"))
    installed = spark.createDataFrame([("models/best.safetensors", 1), ("old/BEST.ckpt", 2)], "name string, nth int")
    got = {r.id: r for r in ingest.drafts(parsed, installed).collect()}
    assert [(x.name, x.weight) for x in got[1].loras] == [("ink", 0.7), ("odd", 0.8)] and "lora" not in got[1].prompt
    assert (got[1].seed, got[1].width, got[1].height, got[1].sampler, got[1].scheduler, got[1].base_family) == (7, 512, 640, "DPM", "Karras", "pony")
    assert got[1].checkpoint == "models/best.safetensors" and got[1].checkpoint_resolved and got[1].notes == ["Steps 24 is left to the shared ratios"]
    assert (got[2].seed, got[2].width, got[2].checkpoint, got[2].checkpoint_resolved) == (-1, 768, "lost", False) and got[2].notes[0] == "checkpoint lost is not installed"
    assert got[3].checkpoint == ingest.NO_CHECKPOINT and got[3].notes == []


def test_styles_experiments_tickets_and_units(spark, tmp_path):
    from tagloom.operators import grid, library

    (tmp_path / "styles.json").write_text(json.dumps([{"name": "ink", "prompt": "nothing"}, {"name": "ink", "prompt": "ink, {prompt}", "negative_prompt": "blur"}]))
    styles = scan.styles(spark, f"file:{tmp_path}/styles.json")
    rows = spark.createDataFrame([(1, "cat", "dog", "ink"), (2, "cat", "dog", "lost"), (3, "cat", "", "ink")], "doc_id long, prompt string, negative_prompt string, style string")
    assert {r.doc_id: (r.prompt, r.negative) for r in grid.apply_styles(rows, styles).collect()} == {1: ("ink, cat", "blur, dog"), 2: ("cat", "dog"), 3: ("ink, cat", "blur")}
    for name, manifest in (("one", '{"a": 1}'), ("bad", "{")):
        (tmp_path / "exp" / name).mkdir(parents=True)
        (tmp_path / "exp" / name / "experiment.json").write_text(manifest)
    assert [r.folder for r in scan.experiments(spark, f"file:{tmp_path}/exp").collect()] == ["one"]
    renders = spark.createDataFrame([("mia", "base", "1_7"), ("mia", "alt", "1_7")], "character string, name string, stem string")
    tickets = spark.createDataFrame([("mia", "base", "1_7", 7)], "character string, name string, stem string, seed long")
    assert {r.name: r.seed for r in library.with_tickets(renders, tickets).collect()} == {"base": 7, "alt": None}
    units = spark.createDataFrame([(1, [(True, "canny", "x/a.png"), (True, "None", "a.png"), (False, "canny", "a.png"), (True, "depth", "lost.png"), (True, "pose", "b.png")])], "doc_id long, units array<struct<enabled:boolean, model:string, image_file:string>>")
    images = spark.createDataFrame([("a.png",), ("b.png",)], "file string")
    assert sorted((r.pos, r.unit.model) for r in grid.control_units(units, images).collect()) == [(0, "canny"), (4, "pose")]
    packed = b"Title\0\1\0en\0t\0" + zlib.compress("ü".encode())
    assert scan.png_chunks(png([(b"iTXt", packed), (b"iTXt", b"k\0\0\0\0\0plain")])) == [("Title", "ü"), ("k", "plain")]


def test_guides_and_searches(spark):
    from tagloom.operators import notes

    words = "some text of a page &amp; more " * 20
    html = {
        1: f"<title> A &lt;Title&gt; _ Civitai</title><nav>{words}</nav><p>{words}</p>", 2: f"<HEADER>x</HEADER><h1 class='a'>Big <b>Pony</b></h1>{words} a prompt<!-- <title>no</title> -->", 3: f"<script>var t = '<title>no</title>'</script><p>{words}", 4: "<title>short</title><p>x", 5: None,
        6: f"<title>A  &lt;title&gt;!</title>{words}\n\n\n\n\nend", 7: f"<title>_ Civitai</title>{words}",
    }
    pages = spark.createDataFrame([(k, f"file{k}", v) for k, v in html.items()], "page_id int, stem string, html string")
    kept, rejects = notes.guides(pages)
    got = {r.page_id: r for r in kept.collect()}
    assert {k: (r.id, r.title, r.tags) for k, r in got.items()} == {
        1: ("a-title", "A <Title>", ["civitai"]), 2: ("big-pony", "Big Pony", ["civitai", "pony", "prompting"]), 3: ("file3", "file3", ["civitai"]), 6: ("a-title-1", "A  <title>!", ["civitai"]), 7: ("file7", "file7", ["civitai"]),
    }
    assert "page & more" in got[1].text and got[6].text.endswith("more \n\nend") and sorted(r.page_id for r in rejects.collect()) == [4, 5]
    vault = spark.createDataFrame([("a", "One", "guide", ["x"], ["l"], "# only a heading"), ("b", "Two", None, ["x", "y"], [], "# head\nBody  text"), ("c", "Three", "note", [], ["Link"], "z" * 200)], "id string, title string, type string, tags array<string>, links array<string>, body string")
    find = lambda **k: {r.id: r.snippet for r in notes.search(vault, **k).collect()}
    assert find() == {"a": "", "b": "# head Body text", "c": "z" * 140}
    assert set(find(kind="note")) == {"b", "c"} and set(find(tag="x")) == {"a", "b"} and set(find(q="LINK")) == {"c"} and set(find(q="body", tag="y", kind="note")) == {"b"} and not find(q="nothing like it")


def test_tickets_are_written_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "character string, profile string, file string, seed long")
    path = f"{tmp_path}/tickets"
    assert scan.write_tickets(rows(("m", "a", "1.png", 7), ("m", "a", "1.png", 3), ("m", "b", "1.png", 9)), path) == 2
    assert scan.write_tickets(rows(("m", "a", "1.png", 1), ("n", "a", "2.png", None)), path) == 1
    assert scan.write_tickets(rows(("n", "a", "2.png", 5)), path) == 0
    got = spark.read.json(path).select("character", "profile", "file", "seed").collect()
    assert sorted(map(tuple, got)) == [("m", "a", "1.png", 3), ("m", "b", "1.png", 9), ("n", "a", "2.png", None)]
    assert (tmp_path / "tickets" / "character=m" / "profile=b").is_dir()
