"""Node graphs of pictures: samplers by their structure, model chains, and what a profile takes from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from . import profiles

#: Class names of latents that start empty, and of nodes that enlarge latents; a denoise from here on is a full pass.
EMPTY = ("EmptyLatentImage", "EmptySD3LatentImage")
ENLARGE = ("LatentUpscale", "UpscaleLatent")
FULL_PASS = 0.9


def nodes(rows: DataFrame) -> DataFrame:
    """(graph, pos, node, class_type, inputs) of JSON graphs (id, text); a text that is no such JSON has none.

    inputs maps a name to (kind, value, source): kind is number, text, link or other, a
    link's source is the id of the node it comes from, and order is that of the JSON.
    """
    schema = "map<string, struct<class_type string, inputs map<string, variant>>>"
    flat = rows.select(F.col("id").alias("graph"), F.posexplode(F.from_json("text", schema)).alias("pos", "node", "x"))

    def value(_: Column, v: Column) -> Column:
        kind, source = F.schema_of_variant(v), F.try_variant_get(v, "$[0]", "string")
        link = source.isNotNull() & F.try_variant_get(v, "$[1]", "string").isNotNull() & F.try_variant_get(v, "$[2]", "string").isNull()
        named = F.when(link, "link").when(kind == "STRING", "text").when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"), "number").otherwise("other")
        return F.struct(named.alias("kind"), F.try_variant_get(v, "$", "string").alias("value"), F.when(link, source).alias("source"))

    return flat.select("graph", "pos", "node", F.coalesce("x.class_type", F.lit("")).alias("class_type"), F.transform_values(F.coalesce("x.inputs", F.create_map().cast("map<string, variant>")), value).alias("inputs"))


def given(name: str) -> Column:
    return F.try_element_at("inputs", F.lit(name))


def samplers(graph_nodes: DataFrame) -> DataFrame:
    """(graph, node, role, inputs, latent_class, latent_inputs): the base sampler of each graph, and a second pass if there is one.

    A sampler is known by its inputs: steps, cfg and seed as values or links, sampler_name and
    scheduler as text, whatever its class; detailers don't count.  Those that start from an
    empty latent come first, then those of a full pass, then the order of the graph.  The
    second pass is the first later one with less than a full pass, else the first later one.
    """
    here = lambda n: F.coalesce(given(n)["kind"].isin("number", "text", "link"), F.lit(False))
    text = lambda n: F.coalesce(given(n)["kind"] == "text", F.lit(False))
    own = graph_nodes.where(here("steps") & here("cfg") & here("seed") & text("sampler_name") & text("scheduler") & ~F.contains(F.lower("class_type"), F.lit("detailer")))
    latents = graph_nodes.select("graph", F.col("node").alias("_source"), F.col("class_type").alias("latent_class"), F.col("inputs").alias("latent_inputs"))
    own = own.withColumn("_source", given("latent_image")["source"]).join(latents.hint("merge"), ["graph", "_source"], "left").drop("_source")
    denoise = F.when(given("denoise")["kind"] == "number", given("denoise")["value"].try_cast("double"))
    none = given("denoise").isNull() | (F.coalesce(given("denoise")["kind"], F.lit("")) == "other") & given("denoise")["value"].isNull()
    full = F.when(none | (denoise >= FULL_PASS), 1).otherwise(0)
    empty = F.when(F.col("latent_class").isin(*EMPTY), 1).otherwise(0)
    order = Window.partitionBy("graph").orderBy(F.desc(empty), F.desc(full), "pos")
    own = own.withColumn("_rank", F.row_number().over(order)).withColumn("_partial", F.coalesce(denoise < FULL_PASS, F.lit(False)))
    later = Window.partitionBy("graph", F.col("_rank") > 1).orderBy(F.desc(F.col("_partial").cast("int")), "_rank")
    own = own.withColumn("_place", F.row_number().over(later)).where("_place = 1")
    return own.select("graph", "node", F.when(F.col("_rank") == 1, "base").otherwise("second").alias("role"), "inputs", "latent_class", "latent_inputs")


def steps(graph_nodes: DataFrame) -> DataFrame:
    """(graph, node, next, lora, weight, checkpoint) of each node: where a model comes from and what the node adds.

    A checkpoint loader ends the way; a reroute passes on its source or else its first link;
    all others pass on their model input.
    """
    low = F.lower("class_type")
    checkpoint, lora = F.contains(low, F.lit("checkpointloader")), F.contains(low, F.lit("lora")) & F.contains(low, F.lit("loader"))
    first = F.get(F.filter(F.map_values("inputs"), lambda v: v["source"].isNotNull()), F.lit(0))["source"]
    way = F.when(lora, given("model")["source"]).when(checkpoint, None).when(F.col("class_type") == "Reroute", F.coalesce(given("source")["source"], first)).otherwise(given("model")["source"])
    text = lambda n: F.when(given(n)["kind"] == "text", given(n)["value"])
    return graph_nodes.select(
        "graph", "node", way.alias("next"), F.when(lora, text("lora_name")).alias("lora"), F.when(lora, F.coalesce(given("strength_model")["value"].try_cast("double"), F.lit(0.8))).alias("weight"), F.when(checkpoint & ~lora, text("ckpt_name")).alias("checkpoint"),
    )


def walk(way: DataFrame, start: DataFrame) -> DataFrame:
    """(graph, start, node, depth) along way (graph, node, next) from start (graph, node): one join a step, each written, until no path is open.

    A path ends where next is null, at a node that isn't there, and at one it has been at.
    """
    hops = way.select("graph", F.col("node").alias("at"), "next")
    front = start.select("graph", F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"))
    every, depth = [], 0
    while True:
        here = written(front.join(hops.hint("merge"), ["graph", "at"]).select("graph", "start", "at", "next", "path"), "walk")
        every.append(here.select("graph", "start", F.col("at").alias("node"), F.lit(depth).alias("depth")))
        front = here.where("next is not null and not array_contains(path, next)").select("graph", "start", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"))
        depth += 1
        if front.isEmpty():
            break
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def chains(graph_nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(graph, node, loras, checkpoint) upstream of start (graph, node, its first hop): loras in the order of the path, and the loader that ends it."""
    way = steps(graph_nodes)
    path = walk(way, start).join(way.drop("next").hint("merge"), ["graph", "node"])
    loras = F.transform(F.array_sort(F.filter(F.collect_list(F.struct("depth", "lora", "weight")), lambda x: x["lora"].isNotNull())), lambda x: F.struct(x["lora"].alias("name"), x["weight"].alias("weight")))
    return path.groupBy("graph", F.col("start").alias("node")).agg(loras.alias("loras"), F.max("checkpoint").alias("checkpoint"))


def parsed(rows: DataFrame) -> DataFrame:
    """Pieces of a profile in JSON graphs (id, text): prompt, negative, settings, loras, checkpoint, width, height, hires, notes.

    Graphs without a sampler, and texts that are no graph, give no row.
    """
    every = written(nodes(rows), "graph-nodes")
    found = written(samplers(every), "graph-samplers")
    base, second = found.where("role = 'base'"), found.where("role = 'second'")
    encoders = every.where("contains(lower(class_type), 'cliptextencode')").select("graph", F.col("node").alias("_n"), F.when(given("text")["kind"] == "text", given("text")["value"]).alias("_t"))
    own = base.select("*", *(given(c)["source"].alias(f"_{c}") for c in ("positive", "negative", "model")))
    for side in ("positive", "negative"):
        own = own.join(encoders.withColumnsRenamed({"_n": f"_{side}", "_t": f"{side}_text"}).hint("merge"), ["graph", f"_{side}"], "left")
    models = chains(every, own.where("_model is not null").select("graph", F.col("_model").alias("node")).distinct()).withColumnRenamed("node", "_model")
    own = own.join(models.hint("merge"), ["graph", "_model"], "left")
    method = F.when(F.col("latent_class").isin(*ENLARGE), F.try_element_at("latent_inputs", F.lit("upscale_method"))["value"])
    again = second.select("graph", F.col("node").alias("_second"), method.alias("_method"), *(given(k)["value"].try_cast("double").alias(f"_{k}") for k in ("denoise", "steps", "cfg")))
    loader = every.where("class_type = 'UpscaleModelLoader'").groupBy("graph").agg(F.min_by(F.coalesce(given("model_name")["value"], F.lit("")), "pos").alias("_loader"))
    detailers = every.where("contains(lower(class_type), 'detailer')").groupBy("graph").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "class_type"))), lambda x: F.concat(F.lit("detailer node "), x["class_type"], F.lit(" is not read"))).alias("_detailers"))
    for more in (again, loader, detailers):
        own = own.join(more.hint("merge"), "graph", "left")
    start_empty = F.col("latent_class").isin(*EMPTY)
    side = lambda c: F.when(start_empty, F.try_element_at("latent_inputs", F.lit(c))["value"].try_cast("double").cast("int"))
    settings = {
        "Steps": given("steps")["value"], "CFG scale": given("cfg")["value"], "Seed": given("seed")["value"], "Sampler": profiles.known_name(given("sampler_name")["value"], profiles.SAMPLERS),
        "Schedule type": profiles.known_name(given("scheduler")["value"], profiles.SCHEDULERS), "Denoising strength": given("denoise")["value"],
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in settings.items()]), lambda e: e["v"].isNotNull())
    upscaler = F.coalesce(F.regexp_replace("_loader", r"\.(pth|safetensors)$", ""), "_method")
    hires = F.when(F.col("_second").isNotNull(), F.struct(F.lit(True).alias("enabled"), upscaler.alias("upscaler"), F.col("_denoise").alias("denoise"), F.col("_steps").alias("steps"), F.col("_cfg").alias("cfg")))
    notes = F.filter(F.array(F.when(F.coalesce(start_empty, F.lit(False)), None).otherwise(F.lit("the latent isn't empty, so the size is unknown")), F.concat(F.lit("second pass on node "), "_second")), lambda x: x.isNotNull())
    return own.select(
        F.col("graph").alias("id"), F.lit("graph").alias("format"), F.coalesce("positive_text", F.lit("")).alias("prompt"), F.coalesce("negative_text", F.lit("")).alias("negative"), F.map_from_entries(pairs).alias("settings"),
        "loras", "checkpoint", side("width").alias("width"), side("height").alias("height"), hires.alias("hires"), F.concat(notes, F.coalesce("_detailers", F.array().cast("array<string>"))).alias("notes"),
    )
