"""Prompt sections: classify lines, then compose the sections to BREAK blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("quality", "keystone", "character", "secondary", "setting", "lighting")
# The vocabularies of each rule, the earlier rule first.
RULES = (
    ("quality", r"\bscore_\d|\bsource_\w+"),
    ("keystone", r"\b(portrait|medium shot|full body|close-?up|cowboy shot|\d+mm|three-?quarter|from (above|below|side|behind)|dutch angle|eye-?level|pov|wide (shot|angle)|focus|dynamic angle|angle)\b"),
    ("keystone", r"\b(standing|sitting|kneeling|lying|leaning|walking|posture|weight shifted|arms? (up|crossed|behind)|hands? on|head (tilt|rest)|eye contact|looking at viewer|smil(?:e|ing)|expression|catchlight|smirk|frown|laughing)\b"),
    ("character", r"\b(hair|bangs|ponytail|braid|twintails|curls|tendrils|updo)\b"),
    ("character", r"\b(eyes?:\d|blue eyes|green eyes|brown eyes|amber eyes|hazel|face|lips|makeup|moles?|pointed ears|horns)\b"),
    ("character", r"\b(blouse|shirt|skirt|dress|pants|jeans|shorts|bikini|lingerie|wearing|outfit|jacket|coat|sweater|top|belt|necklace|earrings|jewelry|pendant|glasses|boots|heels|stockings|pantyhose|gloves|hat)\b"),
    ("character", r"\b(breasts?|curvy|slim|voluptuous|athletic|plump|muscular|skin tone|pale skin|dark-?skinned|tan(?!k)|freckles|long legs|narrow waist|wide hips|thick thighs|dancer body|mature woman|aged up|mid 30s|\d0s\b|milf|body type)\b"),
    ("setting", r"\b(interior|outdoors?|outside|inside|room|office|beach|street|bedroom|kitchen|garden|forest|city|background|daytime|night(?:time)?|evening|morning|sunset|sunrise|living room|desk|couch|sofa|bed\b|window)\b"),
    ("lighting", r"\b(light|lighting|lamp|softbox|rim light|backlit|golden hour|glow|shadows?|sunlight|candle|neon)\b"),
    ("keystone", r"^\s*\(?\d\s*(girl|boy|women|men|other)s?\)?\s*$|\bsolo\b"),
    ("character", r"\b(mature woman|1girl|1boy|woman|man|female|male)\b"),
)
SECOND = r"\b(1boy|male|man|second (girl|woman)|another (girl|woman)|mmf|threesome|couple)\b"


def parse(prompts: DataFrame) -> DataFrame:
    """(doc_id, seg, line, text, section) of every non-empty line."""
    segments = prompts.select("doc_id", F.posexplode(F.split("prompt", r"\s*BREAK\s*")).alias("seg", "part"), F.size(F.split("prompt", r"\s*BREAK\s*")).alias("segs"))
    lines = segments.select("doc_id", "seg", "segs", F.posexplode(F.split("part", "\n")).alias("line", "text")).withColumn("text", F.trim("text")).where("text <> ''")
    low, section = F.lower("text"), F.when(F.col("seg") == 0, "quality").when(F.col("seg") == F.col("segs") - 1, "setting").otherwise("character")
    for name, pattern in reversed(RULES):
        section = F.when(low.rlike("(?i)" + pattern), name).otherwise(section)
    own = lines.withColumn("section", section)
    nth = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("seg", "line"))
    second = (F.col("section") == "character") & (nth > 1) & low.rlike(SECOND)
    return own.withColumn("section", F.when(second, "secondary").otherwise(F.col("section"))).select("doc_id", "seg", "line", "text", "section")


#: Which sections share a block of a composed prompt.
BLOCKS = {"quality": 0, "keystone": 0, "character": 1, "secondary": 2, "setting": 3, "lighting": 3}


def compose(lines: DataFrame) -> DataFrame:
    """Up to four blocks joined by BREAK; every line ends with a comma, sections keep their order in a block, empty ones leave none."""
    at = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values for x in kv]), F.col("section"))
    own = lines.select("doc_id", at(BLOCKS.items()).alias("block"), at([(s, k) for k, s in enumerate(ORDER)]).alias("rank"), "seg", "line", F.trim(F.btrim(F.trim("text"), F.lit(","))).alias("text")).where("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "seg", "line", "text"))), lambda x: x["text"]), ",\n")
    blocks = own.groupBy("doc_id", "block").agg(F.concat(joined, F.lit(",")).alias("text"))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\nBREAK\n").alias("prompt"))
