"""Queries on the library, its curation, notes, pages, plans and logs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cells, curation, graphs, grid, ingest, library, profiles
from ..operators import notes as vault
from ..shared import shared_folder
from ..sources import scan
from .registry import query
from .views import hashes, library_index, notes, table, tag_dump, tickets, tokens

VIEW = """, view AS (SELECT t.doc_id, t.character, t.profile, t.mtime, coalesce(i.rating, 0) AS rating, coalesce(i.favorite, false) AS favorite, coalesce(i.folders, []::VARCHAR[]) AS folders FROM tickets t LEFT JOIN library_index i USING (doc_id))"""


def view(spark, sf_dir):
    return library.view(tickets(spark, sf_dir).select("doc_id", "character", "profile", "mtime"), library_index(spark, sf_dir))


@query(VIEW + " SELECT doc_id, character, profile, mtime, rating, favorite, array_to_string(folders, ',') AS folders FROM view", "tickets library_index")
def library_view(spark, sf_dir):
    return view(spark, sf_dir).withColumn("folders", F.array_join("folders", ","))


@query(VIEW + " SELECT doc_id, rating, favorite FROM view WHERE character = 'en' AND rating >= 2 AND list_contains(folders, 'f1')", "tickets library_index")
def library_filter(spark, sf_dir):
    return library.matching(view(spark, sf_dir), character="en", min_rating=2, folder="f1").select("doc_id", "rating", "favorite")


@query(VIEW + " SELECT doc_id, favorite, rating, mtime FROM view ORDER BY favorite DESC, rating DESC, mtime DESC, doc_id LIMIT 40 OFFSET 20", "tickets library_index")
def library_page(spark, sf_dir):
    """One page of the library, by offset and limit."""
    return library.page(view(spark, sf_dir), 20, 40).select("doc_id", "favorite", "rating", "mtime")


@query(" SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM library_index i WHERE i.doc_id = d.doc_id)", "library_index")
def missing_artifacts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(library_index(spark, sf_dir).select("doc_id").hint("merge"), "doc_id", "left_anti")


@query(" SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM library_index i WHERE i.doc_id = d.doc_id) ORDER BY doc_id LIMIT 50", "library_index")
def bounded_worklist(spark, sf_dir):
    """At most 50 renders of missing artifacts a run, in order."""
    return missing_artifacts(spark, sf_dir).orderBy("doc_id").limit(50)


@query(", d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 5 END AS rating, true AS favorite FROM documents WHERE doc_id % 3 = 0) SELECT coalesce(i.doc_id, d.doc_id) AS doc_id, coalesce(d.rating, i.rating) AS rating, coalesce(d.favorite, i.favorite) AS favorite FROM library_index i FULL OUTER JOIN d ON d.doc_id = i.doc_id", "library_index")
def index_upsert(spark, sf_dir):
    """An index merged with new values for a third of the documents."""
    delta = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 5).alias("rating"), F.lit(True).alias("favorite"))
    return library.upsert(library_index(spark, sf_dir).select("doc_id", "rating", "favorite"), delta, ["rating", "favorite"])


@query("SELECT doc_id, rating, len(tags)::INTEGER AS n_tags, title, rating IS NULL OR rating BETWEEN 0 AND 5 AS valid FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 9 END AS rating, list_filter(string_split(text, ' '), lambda w: trim(w) <> '')[1:20] AS tags, substr(text, 1, 80) AS title FROM documents)")
def rate_update(spark, sf_dir):
    updates = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 9).alias("rating"), F.split("text", " ").alias("tags"), F.col("text").alias("title"))
    return library.checked_update(updates).select("doc_id", "rating", F.size("tags").alias("n_tags"), "title", "valid")


@query(", r AS (SELECT unnest(['f0', 'f1', 'f9']) AS folder), c AS (SELECT folder, count(*) AS items FROM (SELECT unnest(folders) AS folder FROM library_index) GROUP BY folder) SELECT coalesce(r.folder, c.folder) AS folder, coalesce(items, 0) AS items FROM r FULL OUTER JOIN c ON r.folder = c.folder", "library_index")
def folder_counts(spark, sf_dir):
    registry = spark.createDataFrame([("f0",), ("f1",), ("f9",)], "folder string")
    return library.folder_counts(registry, library_index(spark, sf_dir))


@query(" SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(folders, lambda f: f <> 'f3'), CASE WHEN doc_id % 2 = 0 THEN ['picked'] ELSE [] END))), ',') AS folders FROM library_index", "library_index")
def folder_assign(spark, sf_dir):
    """Adds a folder to selected rows and removes another from all."""
    added = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("picked"))).otherwise(F.array().cast("array<string>"))
    return library_index(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_union(F.array_remove("folders", "f3"), added)), ",").alias("folders"))


@query(" SELECT doc_id, list_contains(folders, 'f2') AS touched, array_to_string(list_transform(folders, lambda f: CASE WHEN f = 'f2' THEN 'two' ELSE f END), ',') AS folders FROM library_index", "library_index")
def folder_rename(spark, sf_dir):
    return library.rename_folder(library_index(spark, sf_dir), "f2", "two").select("doc_id", "touched", F.array_join("folders", ",").alias("folders"))


def keyed_renders(spark, sf_dir):
    """Documents as renders: doc_id, character, name, file, stem, key."""
    stem = F.col("doc_id").cast("string")
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("character"), F.col("source").alias("name"), F.concat(stem, F.lit(".png")).alias("file"), stem.alias("stem"))
    return own.withColumn("key", F.concat_ws("/", "character", "name", "file"))


@query("""WITH r AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.png' AS key, source = 'src1' OR doc_id IN (SELECT item_id FROM benchmark) AS gone FROM documents)
SELECT 'renders' AS kind, key AS id FROM r WHERE NOT gone UNION ALL SELECT 'tickets', key FROM r WHERE NOT gone AND doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'sidecars', key FROM r WHERE NOT gone AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'index', key FROM r WHERE NOT gone AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT 'thumbs', md5(key) || '.jpg' FROM r WHERE NOT gone""")
def delete_cascade(spark, sf_dir):
    """What is left of five tables when one profile's renders and those of benchmark items are deleted."""
    own, labels = keyed_renders(spark, sf_dir), table(spark, sf_dir, "labels")
    gone = own.where("name = 'src1'").unionByName(own.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi"))
    having = lambda rows: own.join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    tables = {"renders": own, "tickets": having(labels), "sidecars": having(labels.where("toxic = 1")), "index": having(labels.where("quality = 1")), "thumbs": own.select(F.concat(F.md5(F.col("key").cast("binary")), F.lit(".jpg")).alias("thumb"))}
    left = curation.delete_cascade(gone, tables)
    parts = [rows.select(F.lit(kind).alias("kind"), F.col("thumb" if kind == "thumbs" else "key").alias("id")) for kind, rows in left.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


PROFILES = """WITH prof AS (SELECT lang AS character, source AS name, coalesce(bool_or(l.toxic = 1), false) AS locked FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang, source)"""


def profile_table(spark, sf_dir):
    """Profiles (character, name, locked, body, variant_of): languages and sources, locked where a labelled document is toxic."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic").hint("merge"), "doc_id", "left")
    return docs.groupBy(F.col("lang").alias("character"), F.col("source").alias("name")).agg(F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("locked"), F.min("text").alias("body")).withColumn("variant_of", F.lit(None).cast("string"))


@query(PROFILES + """, m AS (SELECT character, name, CASE name WHEN 'src1' THEN 'first' WHEN 'src2' THEN 'src3' WHEN 'src4' THEN 'Bad Name' WHEN 'src5' THEN 'fifth' WHEN 'src6' THEN 'both' WHEN 'src7' THEN 'both' WHEN 'src8' THEN 'src8' END AS new_name, locked FROM prof),
j AS (SELECT character, name, new_name, locked, CASE WHEN new_name = 'Bad Name' THEN 'bad name' WHEN new_name = name THEN 'same name' WHEN locked THEN 'locked' WHEN EXISTS (SELECT 1 FROM prof p WHERE p.character = m.character AND p.name = m.new_name) OR count(*) OVER (PARTITION BY character, new_name) > 1 THEN 'name taken' END AS reason FROM m WHERE new_name IS NOT NULL)
SELECT d.doc_id, d.lang || '/' || coalesce(j.new_name, d.source) || '/' || d.doc_id || '.png' AS key, j.new_name IS NOT NULL AS renamed FROM documents d LEFT JOIN j ON j.character = d.lang AND j.name = d.source AND j.reason IS NULL""")
def rekey(spark, sf_dir):
    """Index keys after renames of profiles; locked profiles, taken and bad names are refused."""
    profiles_ = profile_table(spark, sf_dir)
    new = F.create_map(*[F.lit(x) for kv in {"src1": "first", "src2": "src3", "src4": "Bad Name", "src5": "fifth", "src6": "both", "src7": "both", "src8": "src8"}.items() for x in kv])
    moves = profiles_.select("character", "name", F.try_element_at(new, F.col("name")).alias("new_name")).where("new_name is not null")
    moved = curation.rekeyed(keyed_renders(spark, sf_dir).drop("key"), curation.rename_profiles(profiles_, moves))
    return moved.select("doc_id", F.concat_ws("/", "character", "name", "file").alias("key"), "renamed")


@query(PROFILES + """, taken AS (SELECT character, name, locked FROM prof UNION ALL SELECT character, name || '_s', false FROM prof WHERE character = 'de'),
i AS (SELECT d.lang AS character, d.source AS name, d.text AS body FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
v AS (SELECT i.character, i.name, row_number() OVER (PARTITION BY i.character, i.name ORDER BY body) + CASE WHEN i.character = 'de' THEN 1 ELSE 0 END AS k FROM i JOIN prof p USING (character, name) WHERE p.locked)
SELECT character, name, CASE WHEN k = 1 THEN name || '_s' ELSE name || '_s_' || k END AS saved_as, 'variant' AS action FROM v
UNION ALL SELECT DISTINCT i.character, i.name, i.name, 'overwritten' FROM i JOIN prof p USING (character, name) WHERE NOT p.locked""")
def guarded_merge(spark, sf_dir):
    """Good documents saved over the profiles of their language and source: locked ones get variants, with a number where the name is taken."""
    own = profile_table(spark, sf_dir)
    there = own.unionByName(own.where("character = 'de'").withColumns({"name": F.concat("name", F.lit("_s")), "locked": F.lit(False)}))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    incoming = table(spark, sf_dir, "documents").join(good.hint("merge"), "doc_id").select(F.col("lang").alias("character"), F.col("source").alias("name"), F.col("text").alias("body"), F.lit(None).cast("string").alias("variant_of"))
    return curation.guarded_save(there, incoming, "s")[1]


@query("SELECT lang AS character, array_to_string(list_sort(list_distinct(list(source))), ',') AS profiles, count(DISTINCT source) AS n FROM documents GROUP BY lang")
def profile_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct().groupBy(F.col("lang").alias("character")).agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("profiles"), F.count("*").alias("n"))


@query("SELECT d.source AS dataset, count(*) AS images, count(l.doc_id) AS exported, max(n_chars) AS newest FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def dataset_listing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit"))
    return docs.join(labels.hint("merge"), "doc_id", "left").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("images"), F.count("hit").alias("exported"), F.max("n_chars").alias("newest"))


EXPORT = r""", c AS (SELECT t.doc_id, t.character || '/' || t.profile || '/' || t.doc_id AS key, t.character, 'img' || (t.doc_id % 100) || '.png' AS file, t.mtime AS length, CASE WHEN i.favorite THEN 'tag, ' || t.character END AS machine, coalesce(t.prompt, '') AS prompt FROM tickets t JOIN library_index i USING (doc_id) WHERE i.rating >= 2),
x AS (SELECT *, substr(trim(regexp_replace(coalesce(machine, prompt), '(\s*,\s*)+', ', ', 'g'), ' ,'), 1, 2000) AS caption, machine IS NULL AND prompt <> '' AS fallback, CASE WHEN length = first_value(length) OVER (PARTITION BY file ORDER BY key) THEN file ELSE character || '_' || file END AS dest FROM c)"""


def exported(spark, sf_dir):
    """Well-rated renders exported with machine tags as captions, to a folder of this query's own."""
    own = tickets(spark, sf_dir).join(library_index(spark, sf_dir).where("rating >= 2").hint("merge"), "doc_id")
    own = own.select(
        F.concat_ws("/", "character", "profile", F.col("doc_id").cast("string")).alias("key"), "character", F.concat(F.lit("img"), (F.col("doc_id") % 100).cast("string"), F.lit(".png")).alias("file"), F.col("mtime").alias("length"),
        F.when(F.col("favorite"), F.array(F.lit("tag"), F.col("character"))).alias("machine_tags"), "prompt",
    )
    at = f"{shared_folder(spark)}/datasets-{uuid.uuid4().hex}"
    return curation.export_dataset(own, at, "picked", "wd14"), f"{at}/picked"


@query(EXPORT + " SELECT dest, max(key) AS key, arg_max(length, key) AS length, arg_max(caption, key) AS caption FROM x GROUP BY dest", "tickets library_index")
def dataset_export(spark, sf_dir):
    """What a data set holds after an export: a name that another length has gets its character in front."""
    return spark.read.parquet(f"{exported(spark, sf_dir)[1]}/held/0")


@query(EXPORT + " SELECT 'picked' AS dataset, 'wd14' AS caption, count(*) AS exported, count_if(fallback)::BIGINT AS wd14_fallbacks FROM x", "tickets library_index")
def dataset_receipt(spark, sf_dir):
    return exported(spark, sf_dir)[0][0]


@query(EXPORT + " SELECT key, dest AS file, fallback FROM x", "tickets library_index")
def dataset_items(spark, sf_dir):
    """The renders of a receipt and the files they became."""
    return exported(spark, sf_dir)[0][1]


@query(" SELECT count(*) AS total, count(l.doc_id) AS tagged FROM documents d LEFT JOIN library_index l USING (doc_id)", "library_index")
def tag_coverage(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(library_index(spark, sf_dir).select("doc_id", F.lit(1).alias("hit")).hint("merge"), "doc_id", "left").agg(F.count("*").alias("total"), F.count("hit").alias("tagged"))


@query(" SELECT '---' || chr(10) || 'title: ' || title || chr(10) || 'tags: [' || regexp_replace(array_to_string(tags, ', '), '[\\[\\]]', '', 'g') || ']' || chr(10) || '---' || chr(10) || body AS note, id FROM notes".replace("\\\\", "\\"), "notes")
def note_render(spark, sf_dir):
    """Notes as markdown with frontmatter; list items lose brackets."""
    n = F.lit("\n")
    tags = F.regexp_replace(F.array_join("tags", ", "), r"[\[\]]", "")
    return notes(spark, sf_dir).select("id", F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntags: ["), tags, F.lit("]\n---"), n, "body").alias("note"))


@query(r" SELECT id, title, substr(trim(regexp_replace(body, '\s+', ' ', 'g')), 1, 140) AS snippet FROM notes JOIN labels USING (doc_id) WHERE quality = 1 AND list_contains(tags, 'en') AND contains(lower(id || ' ' || title || ' ' || body || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(links, ' ')), 'the th')", "notes")
def note_search(spark, sf_dir):
    """Guides, which are the good documents, with a tag and a text."""
    kind = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "guide").alias("type"))
    own = notes(spark, sf_dir).join(kind.hint("merge"), "doc_id", "left")
    return vault.search(own, "The th", "en", "guide").select("id", "title", "snippet")


@query(" SELECT link AS target, count(DISTINCT id) AS sources, min(id) AS first FROM (SELECT id, unnest(links) AS link FROM notes) l WHERE EXISTS (SELECT 1 FROM notes n WHERE n.id = l.link) GROUP BY link", "notes")
def backlinks(spark, sf_dir):
    own = notes(spark, sf_dir)
    edges = own.select("id", F.explode("links").alias("target")).distinct()
    known = own.select(F.col("id").alias("target")).distinct()
    return edges.join(known.hint("merge"), "target", "left_semi").groupBy("target").agg(F.count("*").alias("sources"), F.min("id").alias("first"))


@query(r" SELECT id, array_to_string(list_sort(list_distinct(list_concat(links, list_filter(regexp_extract_all(regexp_replace(body, '([A-Z][\p{L}]{4,})[ ,.]', '[[\1|x]] ', 'g'), '\[\[([^|\]]+)\|', 1), lambda x: x <> '')))), ',') AS links FROM notes", "notes")
def note_links(spark, sf_dir):
    """Frontmatter links joined with wiki links of the body, sorted; long capitalised words of documents are written as such links."""
    body = F.regexp_replace("body", r"([A-Z][\p{L}]{4,})[ ,.]", "[[$1|x]] ")
    return notes(spark, sf_dir).select("id", F.array_join(F.array_sort(F.array_union("links", ingest.wiki_links(body))), ",").alias("links"))


@query(" SELECT DISTINCT unnest(tags) AS tag FROM notes", "notes")
def tag_facet(spark, sf_dir):
    return notes(spark, sf_dir).select(F.explode("tags").alias("tag")).distinct()


SLUG = "coalesce(nullif(substr(trim(regexp_replace(lower(title), '[^a-z0-9_-]+', '-', 'g'), '-'), 1, 60), ''), 'note')"


@query(f" SELECT doc_id, slug, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS id FROM (SELECT doc_id, slug, row_number() OVER (PARTITION BY slug ORDER BY doc_id) - 1 AS n FROM (SELECT doc_id, {SLUG} AS slug FROM notes))", "notes")
def slug_suffix(spark, sf_dir):
    return library.slug_suffix(notes(spark, sf_dir).select("doc_id", "title"), t.slug(F.col("title")), "doc_id").select("doc_id", "slug", "id")


_SHOWN = "html"
for _t in vault.BLOCKS:
    _SHOWN = f"regexp_replace({_SHOWN}, '<{_t}\\b[^>]*>.*?</{_t}\\s*>', '', 'gis')"
_SHOWN = f"regexp_replace({_SHOWN}, '<!--.*?-->', '', 'gs')"


def _plain(sql):
    for name, sign in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        sql = f"replace({sql}, '{name}', {sign})"
    return sql


def _strip(sql):
    return f"regexp_replace({sql}, '^\\s+|\\s+$', '', 'g')"


def _between(tag):
    inner = f"regexp_replace(regexp_extract(s, '<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1, 'is'), '<[^>]+>', '', 'g')"
    return f"nullif({_strip(_plain(inner))}, '')"


_TEXT = "regexp_replace(s, '<[^>]+>', chr(10), 'g')"
GUIDES = f"""WITH shown AS (SELECT page_id, regexp_extract(coalesce(url, ''), '([^/?#]*)$', 1) AS stem, {_SHOWN} AS s FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)),
g AS (SELECT page_id, coalesce(nullif({_strip("regexp_replace(coalesce(" + _between("title") + ", " + _between("h1") + ", stem), '\\s*_\\s*Civitai\\s*$', '')")}, ''), stem) AS title, {_strip("regexp_replace(" + _plain(_TEXT) + ", '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM shown),
k AS (SELECT *, coalesce(nullif(substr(trim(regexp_replace(lower(title), '[^a-z0-9_-]+', '-', 'g'), '-'), 1, 60), ''), 'note') AS slug, lower(title) || lower(substr(text, 1, 4000)) AS said FROM g WHERE length(text) >= 300)"""


def guides(spark, sf_dir):
    return vault.guides(table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.coalesce("url", F.lit("")), "([^/?#]*)$", 1).alias("stem"), "html"))


@query(GUIDES + """ SELECT page_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || (n - 1) END AS id, title, 'civitai' || CASE WHEN regexp_matches(said, 'pony|score_9') THEN ',pony' ELSE '' END || CASE WHEN contains(said, 'prompt') THEN ',prompting' ELSE '' END AS tags, md5(substr(text, 1, 100000)) AS text_md5
FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM k)""")
def html_guides(spark, sf_dir):
    """Pages as guide notes: title, heading or file name, text without blocks, tags, ids."""
    own = guides(spark, sf_dir)[0]
    return own.select("page_id", "id", "title", F.array_join("tags", ",").alias("tags"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(GUIDES + " SELECT page_id, 'too little text' AS reason FROM g WHERE length(text) < 300")
def guide_rejects(spark, sf_dir):
    return guides(spark, sf_dir)[1]


@query(" SELECT tag, category::INTEGER AS category, cnt, alias || ',x' AS aliases FROM tag_dump", "tag_dump")
def tag_dump_scan(spark, sf_dir):
    """Words of documents as a CSV of tags, written and scanned."""
    at = f"{shared_folder(spark)}/tags-{uuid.uuid4().hex}"
    tag_dump(spark, sf_dir).select("tag", "category", "cnt", F.concat(F.lit(" "), "alias", F.lit(", X ,"))).write.option("escape", '"').csv(at)
    return scan.tag_dump(spark, at).select("tag", "category", "cnt", F.array_join("aliases", ",").alias("aliases"))


SUGGEST = """, bw AS (SELECT list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
dump AS (SELECT tag, cnt, alias FROM tag_dump UNION ALL SELECT tag, count(*), reverse(tag) FROM (SELECT unnest(list_transform(range(1, greatest(2, len(w))), lambda k: concat_ws('_', w[k], w[k + 1]))) AS tag FROM bw) WHERE contains(tag, '_') GROUP BY tag), q AS (SELECT DISTINCT unnest(list_concat(w, list_transform(range(1, greatest(2, len(w))), lambda k: concat_ws('_', w[k], w[k + 1])))) AS q FROM (SELECT list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE doc_id % 100 = 0)), tiers AS (SELECT q, tag, cnt, 1 AS tier FROM q JOIN dump ON tag = q UNION ALL SELECT q, tag, cnt, 2 FROM q JOIN dump ON alias = q
UNION ALL SELECT q, tag, cnt, 3 FROM q JOIN dump ON starts_with(tag, q) UNION ALL SELECT q, tag, cnt, 4 FROM q JOIN dump ON contains(tag, q) UNION ALL SELECT q, tag, cnt, 5 FROM q JOIN dump ON contains(alias, q)),
one AS (SELECT q, tag, max(cnt) AS cnt, min(tier) AS tier FROM tiers WHERE q <> '' GROUP BY q, tag), own AS (SELECT q, rank, tag, tier FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, cnt DESC, tag) AS rank FROM one) WHERE rank <= 12),
had AS (SELECT a.q, count(o.tag) AS had, coalesce(list(o.tag) FILTER (o.tag IS NOT NULL), []) AS seen FROM (SELECT DISTINCT q FROM q WHERE q <> '') a LEFT JOIN own o USING (q) GROUP BY a.q),
forms AS (SELECT q, had, seen, k, array_to_string(string_split(q, '_')[1:k], '_') AS part FROM (SELECT *, unnest(range(1, len(string_split(q, '_')))) AS k FROM had WHERE had < 12 AND contains(q, '_'))),
more AS (SELECT f.q, f.had, f.k, d.tag, d.cnt FROM forms f JOIN dump d ON starts_with(d.tag, f.part || '_') AND contains(d.tag, '_') AND NOT list_contains(f.seen, d.tag)),
best AS (SELECT * FROM more QUALIFY k = max(k) OVER (PARTITION BY q)), late AS (SELECT q, had + row_number() OVER (PARTITION BY q ORDER BY cnt DESC, tag) AS rank, tag, 6 AS tier FROM best)"""


@query(SUGGEST + " SELECT q, rank::INTEGER AS rank, tag, tier FROM own UNION ALL SELECT q, rank::INTEGER, tag, tier FROM late WHERE rank <= 12", "tag_dump")
def tag_suggest(spark, sf_dir):
    """Twelve suggestions for each query, the words and pairs of words of every document whose id is divisible by 100.

    Tiers: exact tag, exact alias, prefix, substring, substring of the alias, by count; pairs
    that find too few go on from their shorter form.  Tags are words of documents and pairs of
    words of the benchmark.
    """
    from ..operators.suggest import suggest_all

    words = F.filter(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}0-9]+", " ")), " "), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 1), F.lit(1)), lambda k: F.concat_ws("_", F.get(F.col("w"), k - 1), F.get(F.col("w"), k)))
    asked = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(words.alias("w")).select(F.explode(F.concat("w", pairs)).alias("q")).where("q <> ''").distinct()
    more = table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(pairs).alias("tag")).where("instr(tag, '_') > 0").groupBy("tag").agg(F.count("*").alias("cnt"))
    dump = tag_dump(spark, sf_dir).select("tag", "cnt", "alias").unionByName(more.withColumn("alias", F.reverse("tag")))
    return suggest_all(dump, asked, 12)


REF = "CASE WHEN regexp_matches(url, '/[0-9]+$') THEN regexp_extract(url, '/([0-9]+)$', 1) ELSE replace(regexp_replace(url, '://[^/]*/', '://x/models/'), 'page=', 'modelVersionId=') END"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(r, '^[0-9]+$') THEN 'model' WHEN regexp_matches(r, '[?&]modelVersionId=[0-9]') THEN 'version' WHEN regexp_matches(r, '/models/[0-9]') THEN 'model' ELSE 'reject' END AS kind,
CASE WHEN regexp_matches(r, '^[0-9]+$') THEN r WHEN regexp_matches(r, '[?&]modelVersionId=[0-9]') THEN regexp_extract(r, '[?&]modelVersionId=([0-9]+)', 1) ELSE nullif(regexp_extract(r, '/models/([0-9]+)', 1), '') END AS id
FROM (SELECT page_id, trim(coalesce({REF}, '')) AS r FROM pages)""")
def ref_parse(spark, sf_dir):
    """Pages' urls as references to models: numbers at their end stand alone, others keep their host for a model hub's and their page for a version."""
    u = F.col("url")
    ref = F.when(u.rlike("/[0-9]+$"), F.regexp_extract(u, "/([0-9]+)$", 1)).otherwise(F.replace(F.regexp_replace(u, "://[^/]*/", "://x/models/"), F.lit("page="), F.lit("modelVersionId=")))
    return table(spark, sf_dir, "pages").select("page_id", profiles.model_ref(ref).alias("x")).select("page_id", "x.*")


@query(r"""SELECT page_id, file, CASE WHEN file = '' THEN 'no name' WHEN contains(file, '/') OR contains(file, '\') THEN 'folder in the name' WHEN NOT ends_with(file, '.png') THEN 'no png' WHEN contains(file, '..') THEN 'dots in the name' END AS reason,
CASE WHEN key = '' THEN 'no key' WHEN NOT regexp_matches(key, '^[a-z0-9][a-z0-9_-]*$') THEN 'characters that keys don''t have' END AS key_reason
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS file, regexp_extract(url, '://([^/?#]*)', 1) AS key FROM pages WHERE url IS NOT NULL)""")
def key_quarantine(spark, sf_dir):
    """Paths and hosts of pages as file names and keys, with why they are refused."""
    own = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.regexp_replace("url", r"^[a-z]+://[^/]*/?", "").alias("file"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("key"))
    return own.select("page_id", "file", curation.file_reason(F.col("file")).alias("reason"), curation.key_reason(F.col("key")).alias("key_reason"))


_KEYS = [*profiles.SAMPLERS, *profiles.SCHEDULERS, "unheard_of"]
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (profiles.SAMPLERS | profiles.SCHEDULERS).items())


@query(f"SELECT doc_id, k, CASE k {_NAMES} ELSE k END AS name FROM (SELECT doc_id, {_KEYS!r}[1 + doc_id % {len(_KEYS)}] AS k FROM documents)")
def vocab_map(spark, sf_dir):
    """Every known sampler and scheduler name in turn, and one that isn't known."""
    k = F.element_at(F.array(*[F.lit(x) for x in _KEYS]), (F.col("doc_id") % len(_KEYS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("k")).select("doc_id", "k", profiles.known_name(F.col("k"), profiles.SAMPLERS | profiles.SCHEDULERS).alias("name"))


UPSCALERS = """WITH asked AS (SELECT doc_id, CASE WHEN l.quality = 1 THEN 'R-ESRGAN 4x+' WHEN l.quality = 0 THEN '' ELSE d.source END AS name FROM documents d LEFT JOIN labels l USING (doc_id)), installed AS (SELECT DISTINCT source AS name FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION SELECT 'RealESRGAN_x4plus')"""


@query(UPSCALERS + """ SELECT doc_id, CASE WHEN name = '' THEN 'RealESRGAN_x4plus_anime_6B' WHEN name IN (SELECT name FROM installed) THEN name WHEN name = 'R-ESRGAN 4x+' THEN 'RealESRGAN_x4plus' ELSE 'RealESRGAN_x4plus_anime_6B' END AS upscaler,
name <> '' AND name <> 'R-ESRGAN 4x+' AND name NOT IN (SELECT name FROM installed) AS noted FROM asked""")
def upscaler_resolve(spark, sf_dir):
    """Upscalers that documents ask for against an installed list: none, an alias, installed ones and others, which get the fallback and a note."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").hint("merge"), "doc_id", "left")
    asked = docs.select("doc_id", F.when(F.col("quality") == 1, "R-ESRGAN 4x+").when(F.col("quality") == 0, "").otherwise(F.col("source")).alias("asked"))
    installed = docs.where("toxic = 1").select(F.col("source").alias("name")).distinct().unionByName(spark.createDataFrame([("RealESRGAN_x4plus",)], "name string"))
    return ingest.upscaler_names(asked, "asked", installed).select("doc_id", "upscaler", F.col("upscaler_note").isNotNull().alias("noted"))


@query("SELECT event_id, event_type AS status, ts FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 100")
def request_listing(spark, sf_dir):
    """The newest requests of one status, at most 100."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("event_type").alias("status"), "ts").orderBy(F.desc("event_id")).limit(100)


STATUS = {"view": "ok", "click": "ok", "purchase": "skipped", "error": "failed"}


def enrichment(spark, sf_dir):
    """Events as results of an enrichment pass."""
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type")), F.lit("no_match"))
    return profiles.pass_counts(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), status.alias("status"), F.col("props").alias("error")))


@query("SELECT count_if(event_type IN ('view', 'click'))::BIGINT AS ok, count_if(event_type = 'purchase')::BIGINT AS skipped, count_if(event_type = 'error')::BIGINT AS failed, count_if(event_type NOT IN ('view', 'click', 'purchase', 'error'))::BIGINT AS no_match, count(*) AS total FROM events")
def enrichment_counts(spark, sf_dir):
    return enrichment(spark, sf_dir)[0]


@query("SELECT event_id AS key, substr(props, 1, 80) AS error FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 10")
def enrichment_errors(spark, sf_dir):
    """A report of the first ten errors."""
    return enrichment(spark, sf_dir)[1]


@query("SELECT user_id, max_by(event_id, ts) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1 GROUP BY user_id")
def latest_cached(spark, sf_dir):
    """The latest finished run of each signature; the larger id of equal times."""
    done = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return done.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last")).select("user_id", F.col("last.event_id").alias("event_id"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT user_id, min(ts) AS first, count(*) AS writes FROM s GROUP BY user_id, n""")
def quiet_sessions(spark, sf_dir):
    """Writes of a key that come within ten minutes of each other, as one session."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "10 minutes")).agg(F.min("ts").alias("first"), F.count("*").alias("writes"))
    return s.select("user_id", "first", "writes")


@query("SELECT conv_id AS job, max(turn) AS step, count(*) AS lines FROM conversations WHERE regexp_matches('step ' || turn, '^(paso|step) [0-9]+') GROUP BY conv_id")
def log_progress(spark, sf_dir):
    """The latest step of each job's log lines."""
    line = F.concat(F.lit("Step "), F.col("turn").cast("string"))
    step = F.nullif(F.regexp_extract(line, r"(?i)\b(?:paso|step) (\d+)", 1), F.lit("")).cast("long")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), step.alias("step")).where("step is not null").groupBy("job").agg(F.max("step").alias("step"), F.count("*").alias("lines"))


CENSUS = """WITH f AS (SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN 'infotext' WHEN l.quality = 0 THEN 'graph' WHEN d.lang <> 'en' AND d.text <> '' THEN 'sidecar' END AS dialect FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL)"""


def archive(spark, sf_dir):
    """Documents as pictures: labelled ones hold settings or a graph, others in foreign languages have a sidecar."""
    docs = table(spark, sf_dir, "documents").where("text is not null").join(table(spark, sf_dir, "labels").select("doc_id", "quality").hint("merge"), "doc_id", "left")
    path = F.concat(F.lit("/archive/"), F.col("doc_id").cast("string"))
    dialect = F.when(F.col("quality") == 1, "infotext").when(F.col("quality") == 0, "graph")
    files = docs.select(F.concat(path, F.lit(".png")).alias("path"), F.lit(True).alias("readable"), dialect.alias("dialect"), F.when(dialect.isNotNull(), F.col("text")).alias("text"))
    beside = docs.where("quality is null and lang <> 'en'").select(F.concat(F.col("doc_id").cast("string"), F.lit(".meta.json")).alias("file"), F.concat(path, F.lit(".meta.json")).alias("path"), F.to_json(F.struct(F.col("text").alias("parameters"))).alias("text"))
    return files, beside


@query(CENSUS + """ SELECT dialect, base, count(*) AS n FROM (SELECT dialect, CASE WHEN regexp_matches(lower(text), 'score_9|source_cartoon|source_anime') THEN 'pony' WHEN regexp_matches(lower(text), 'masterpiece|best quality|masterwork|best_quality') THEN 'illustrious' ELSE 'other' END AS base FROM f WHERE dialect IS NOT NULL) GROUP BY ROLLUP (dialect, base)""")
def archive_census(spark, sf_dir):
    """Pictures by where their settings were found and by base family, sidecars looked for beside those without."""
    return ingest.census(ingest.dispatch(*archive(spark, sf_dir))[0])


@query(CENSUS + " SELECT '/archive/' || doc_id || '.png' AS path, 'no settings in the picture or beside it' AS reason FROM f WHERE dialect IS NULL")
def archive_rejects(spark, sf_dir):
    return ingest.dispatch(*archive(spark, sf_dir))[1]


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, min(role) AS role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
n AS (SELECT conv_id, turn, role, CASE WHEN role <> 'system' THEN lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) END AS next FROM t),
w AS (SELECT conv_id, turn AS start, turn, role, next, 0 AS depth FROM n QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
  UNION ALL SELECT w.conv_id, w.start, n.turn, n.role, n.next, w.depth + 1 FROM w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.next)
SELECT conv_id AS graph, start AS node, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY depth) FILTER (role = 'assistant') AS passed, max(CASE WHEN role = 'system' THEN turn END) AS ended, count(*) AS n FROM w GROUP BY conv_id, start""")
def graph_chain(spark, sf_dir):
    """The way from the last turn of each conversation to its first or to a system turn, which ends it as a checkpoint does; what it passes, in order."""
    t_ = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").groupBy(F.col("conv_id").alias("graph"), F.col("turn").alias("node")).agg(F.min("role").alias("role"))
    before = F.lag("node").over(Window.partitionBy("graph").orderBy("node"))
    way = t_.select("graph", "node", "role", F.when(F.col("role") != "system", before).alias("next"))
    start = t_.groupBy("graph").agg(F.max("node").alias("node"))
    path = graphs.walk(way, start).join(way.select("graph", "node", "role").hint("merge"), ["graph", "node"])
    passed = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("depth", "node")))), lambda x: x["node"].cast("string"))
    out = path.groupBy("graph", "start").agg(F.nullif(F.array_join(passed, ","), F.lit("")).alias("passed"), F.max(F.when(F.col("role") == "system", F.col("node"))).alias("ended"), F.count("*").alias("n"))
    return out.withColumnRenamed("start", "node")


@query("SELECT doc_id, md5(lang || '/' || source || '/' || doc_id) AS key_md5, sha256(text) AS content, substr(sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}'), 1, 16) AS request FROM documents")
def content_keys(spark, sf_dir):
    key = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    request = F.substr(F.sha2(F.to_json(F.struct("lang", "source")), 256), F.lit(1), F.lit(16))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(key.cast("binary")).alias("key_md5"), F.sha2("text", 256).alias("content"), request.alias("request"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 768 ELSE n_chars % 2000 END AS width, CASE WHEN doc_id % 3 = 0 THEN 1024 ELSE doc_id END AS height FROM documents")
def size_parse(spark, sf_dir):
    """WxH to numbers, with defaults for what doesn't parse."""
    size = F.when(F.col("doc_id") % 3 == 0, "auto").otherwise(F.concat((F.col("n_chars") % 2000).cast("string"), F.lit("x"), F.col("doc_id").cast("string")))
    side = lambda k, d: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(size, "^([0-9]+)x([0-9]+)$", k), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(d).cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id", side(1, 768).alias("width"), side(2, 1024).alias("height"))


@query("SELECT doc_id, tab, CASE tab WHEN '' THEN lang WHEN ' 2nd' THEN source END AS model FROM (SELECT doc_id, lang, source, unnest(['', ' 2nd', ' 3rd']) AS tab FROM documents) WHERE tab <> ' 3rd'")
def settings_unpivot(spark, sf_dir):
    """Suffixed settings keys to one row a tab."""
    keys = F.create_map(F.lit("Model"), F.col("lang"), F.lit("Model 2nd"), F.col("source"), F.lit("Model 3rd"), F.lit("None"))
    own = table(spark, sf_dir, "documents").select("doc_id", keys.alias("m"), F.explode(F.array(F.lit(""), F.lit(" 2nd"), F.lit(" 3rd"))).alias("tab"))
    return own.withColumn("model", F.try_element_at("m", F.concat(F.lit("Model"), "tab"))).where("model <> 'None'").select("doc_id", "tab", "model")


@query("""WITH n AS (SELECT doc_id, list_concat(CASE WHEN l.quality = 1 THEN ['lab', 'deltae', 'face'] WHEN l.quality = 0 THEN ['ssim_vs_baseline'] ELSE [] END, CASE WHEN l.toxic = 1 THEN ['drift', 'texture_energy'] ELSE [] END, CASE WHEN d.lang = 'es' THEN [d.source] ELSE [] END) AS names FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN len(u) > 0 THEN NULL WHEN len(names) = 0 THEN 'face,drift' ELSE (SELECT string_agg(g, ',' ORDER BY k) FROM (SELECT g, min(k) AS k FROM (SELECT unnest(gs) AS g, unnest(range(len(gs))) AS k) GROUP BY g)) END AS metrics, u[1] AS unknown
FROM (SELECT *, list_transform(names, lambda x: CASE WHEN x IN ('face', 'lab', 'texture_energy') THEN 'face' ELSE 'drift' END) AS gs, list_filter(names, lambda x: x NOT IN ('face', 'lab', 'texture_energy', 'drift', 'lab_drift', 'deltae', 'ssim_vs_baseline')) AS u FROM n)""")
def metric_alias(spark, sf_dir):
    """Metric names of documents to their groups; a source's name is none and refused."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").hint("merge"), "doc_id", "left")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none = F.array().cast("array<string>")
    names = F.concat(F.when(F.col("quality") == 1, words("lab", "deltae", "face")).when(F.col("quality") == 0, words("ssim_vs_baseline")).otherwise(none), F.when(F.col("toxic") == 1, words("drift", "texture_energy")).otherwise(none), F.when(F.col("lang") == "es", F.array("source")).otherwise(none))
    return docs.select("doc_id", profiles.metric_groups(names).alias("x")).select("doc_id", F.array_join("x.groups", ",").alias("metrics"), "x.unknown")


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 END, 30) AS steps, coalesce(CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10)::DOUBLE END, 6.0::DOUBLE) AS cfg_scale, 3.0::DOUBLE AS distilled_cfg_scale,
CASE WHEN doc_id % 5 <> 0 THEN 1.5::DOUBLE END AS hr_scale, CASE WHEN doc_id % 5 <> 0 THEN coalesce(CASE WHEN doc_id % 2 = 0 THEN doc_id % 20 END, 10) END AS hr_steps, CASE WHEN doc_id % 5 <> 0 THEN 0.45::DOUBLE END AS hr_denoise, CASE WHEN doc_id % 5 <> 0 THEN 4.5::DOUBLE END AS hr_cfg,
doc_id % 3 AS n_tabs, CASE WHEN doc_id % 3 > 0 THEN 0.3::DOUBLE END AS confidence, CASE WHEN doc_id % 3 > 0 THEN 0.4::DOUBLE END AS denoise, CASE WHEN doc_id % 3 > 0 THEN coalesce(CASE WHEN doc_id % 2 = 0 THEN doc_id % 64 END, 32) END AS padding FROM documents""")
def inherit_defaults(spark, sf_dir):
    """All ten ratios: null ones take the shared pin, else the default."""
    d, none = F.col("doc_id"), F.lit(None).cast("double")
    even = lambda n: F.when(d % 2 == 0, d % n)
    base = F.struct(even(50).alias("steps"), F.when(d % 3 == 0, (d % 10).cast("double")).alias("cfg_scale"), none.alias("distilled_cfg_scale"))
    hires = F.when(d % 5 != 0, F.struct(none.alias("scale"), even(20).alias("steps"), none.alias("denoise"), none.alias("cfg")))
    tabs = F.array_repeat(F.struct(none.alias("confidence"), none.alias("denoise"), even(64).alias("padding")), (d % 3).cast("int"))
    own = profiles.inherit(table(spark, sf_dir, "documents").select("doc_id", base.alias("base"), hires.alias("hires"), tabs.alias("tabs")), {"steps": 30, "hr_scale": 1.5, "cfg_scale": None})
    last = F.try_element_at("tabs", F.lit(-1))
    return own.select("doc_id", "base.*", F.col("hires.scale").alias("hr_scale"), F.col("hires.steps").alias("hr_steps"), F.col("hires.denoise").alias("hr_denoise"), F.col("hires.cfg").alias("hr_cfg"), F.size("tabs").cast("long").alias("n_tabs"), last["confidence"].alias("confidence"), last["denoise"].alias("denoise"), last["padding"].alias("padding"))


@query(""" SELECT doc_id, line::INTEGER AS line, CASE WHEN character = 'de' THEN -1 ELSE mtime + line END AS seed, CASE WHEN raw = '' THEN base ELSE base || CASE WHEN contains(base, '<lora:') THEN chr(10) ELSE ', ' END || trim(raw) END AS prompt
FROM (SELECT doc_id, character, mtime, CASE WHEN character = 'en' THEN '<lora:' || profile || ':1>' ELSE profile END AS base, unnest(range(least(64, len(l)))) AS line, unnest(l[1:64]) AS raw FROM (SELECT *, string_split(prompt, ', ') AS l FROM tickets))""", "tickets")
def batch_plan(spark, sf_dir):
    """One row a line, 64 at most as in the batch form; seeds count up from a fixed base, or stay random (-1); lines follow loras on a new line."""
    own = tickets(spark, sf_dir)
    base = F.when(F.col("character") == "en", F.concat(F.lit("<lora:"), "profile", F.lit(":1>"))).otherwise(F.col("profile"))
    rows = own.select("doc_id", base.alias("prompt"), F.when(F.col("character") == "de", -1).otherwise(F.col("mtime")).alias("seed"), F.col("prompt").alias("asked"))
    return grid.batch(rows, F.split("asked", ", "), "increment")


@query("SELECT p.source AS profile, s.v AS steps, c.v AS cfg, row_number() OVER (PARTITION BY p.source ORDER BY c.v, s.v)::INTEGER AS cell FROM (SELECT DISTINCT source FROM documents) p, (SELECT unnest([14, 16, 18, 20]) AS v) s, (SELECT unnest([5, 6, 7]) AS v) c")
def axis_grid(spark, sf_dir):
    """Every profile's grid over the sorted axes; the grid's size is known from the plan and refused over 64 cells."""
    axes = {"cfg": [5, 6, 7], "steps": [14, 16, 18, 20]}
    size = 1
    for values in axes.values():
        size *= len(values)
    if size > 64:
        raise ValueError("a grid has at most 64 cells")
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("profile")).distinct()
    for name, values in sorted(axes.items()):
        own = own.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return own.withColumn("cell", F.row_number().over(Window.partitionBy("profile").orderBy("cfg", "steps")))


CELLS = """WITH own AS (SELECT d.doc_id, d.source AS run, d.lang, l.quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)), res AS (SELECT DISTINCT run, lang, toxic FROM own WHERE quality = 1), base AS (SELECT DISTINCT run FROM own WHERE quality = 0)"""


def cell_tables(spark, sf_dir):
    """Results of runs (sources) from labelled documents, and a choice for every document: objects whose keys stand in another order, or the word baseline."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").hint("merge"), "doc_id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(0)))
    cell = lambda *c: F.parse_json(F.to_json(F.struct(*c)))
    word = F.parse_json(F.lit('"baseline"'))
    results = docs.where("quality is not null").select(F.col("source").alias("run"), F.when(F.col("quality") == 1, cell("lang", "toxic")).otherwise(word).alias("cell"))
    choices = docs.select("doc_id", F.col("source").alias("run"), F.when(F.col("quality").isNull(), word).otherwise(cell("toxic", "lang")).alias("cell"))
    return results, choices


@query(CELLS + " SELECT doc_id, o.run, CASE WHEN quality IS NULL THEN 'baseline' ELSE lang || o.toxic END AS cell FROM own o WHERE CASE WHEN quality IS NULL THEN EXISTS (SELECT 1 FROM base b WHERE b.run = o.run) ELSE EXISTS (SELECT 1 FROM res r WHERE r.run = o.run AND r.lang = o.lang AND r.toxic = o.toxic) END")
def apply_cell(spark, sf_dir):
    """Choices that are cells of their run, as strings or objects."""
    results, choices = cell_tables(spark, sf_dir)
    found = cells.chosen(choices, results)
    text = F.coalesce(F.concat(F.try_variant_get("cell", "$.lang", "string"), F.try_variant_get("cell", "$.toxic", "string")), F.try_variant_get("cell", "$", "string"))
    return found.select("doc_id", "run", text.alias("cell"))


@query("""SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'tabs[0].score' WHEN l.quality = 0 THEN 'tabs.0.score' WHEN d.lang = 'en' THEN 'tabs[1].score' ELSE 'base.lang' END AS path FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE (l.quality IS NOT NULL AND l.toxic IS NULL) OR (l.quality IS NULL AND (d.lang = 'en' OR d.lang IS NULL))""")
def axis_paths(spark, sf_dir):
    """Axes that lead nowhere in their profile, in both spellings of a place in a list."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").hint("merge"), "doc_id", "left")
    profile = F.parse_json(F.to_json(F.struct(F.struct("lang").alias("base"), F.array(F.struct(F.col("toxic").alias("score"))).alias("tabs")), {"ignoreNullFields": "false"}))
    path = F.when(F.col("quality") == 1, "tabs[0].score").when(F.col("quality") == 0, "tabs.0.score").when(F.col("lang") == "en", "tabs[1].score").otherwise("base.lang")
    return cells.unresolved_axes(docs.select(F.col("doc_id").alias("id"), profile.alias("profile")), docs.select(F.col("doc_id").alias("id"), path.alias("path")))


@query("SELECT doc_id, source AS recorded, CASE source WHEN 'src1' THEN 'src1.safetensors' WHEN 'src2' THEN 'b/src2.ckpt' END AS installed FROM documents")
def checkpoint_resolve(spark, sf_dir):
    """Recorded names against installed files, with or without their extension; the first match wins."""
    files = spark.createDataFrame([(0, "src1.safetensors"), (1, "b/src2.ckpt"), (2, "c/src2.safetensors")], "ord int, installed string")
    base = F.element_at(F.split("installed", "/"), -1)
    forms = files.select("ord", "installed", F.explode(F.array(base, F.regexp_replace(base, r"\.[^.]*$", ""))).alias("source"))
    first = forms.groupBy("source").agg(F.min_by("installed", "ord").alias("installed"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(F.broadcast(first), "source", "left").select("doc_id", F.col("source").alias("recorded"), "installed")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0 EXCEPT ALL SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 = 0")
def snapshot_diff(spark, sf_dir):
    """Files of the later snapshot that the earlier one doesn't have."""
    own = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return own.where("doc_id % 7 <> 0").exceptAll(own.where("doc_id % 5 = 0"))


@query("SELECT doc_id, name, weight, pos::INTEGER AS pos FROM (SELECT doc_id, unnest([source, lang]) AS name, unnest(['0.8', '0.5']) AS weight, unnest([0, 1]) AS pos FROM documents)")
def lora_extract(spark, sf_dir):
    """Inline tokens in order, the first of a name."""
    text = F.concat(F.lit("<lora:"), "source", F.lit(":0.8> a, <lora:"), "lang", F.lit(":0.5>, <lora:"), "source", F.lit(":0.1>"))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(t.LORA), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(t.LORA), F.lit(2)).alias("weight"))
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("pos", "x")).select("doc_id", "pos", "x.name", "x.weight")
    first = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("pos"))
    return own.withColumn("rn", first).where("rn = 1").drop("rn")


@query(" SELECT doc_id, 'x' || mtime AS size, CASE WHEN mtime % 2 = 0 THEN 'hires' END AS hires, len(string_split(prompt, ', '))::INTEGER AS n_tokens, CASE WHEN doc_id % 2 = 0 THEN 'face' END AS tab FROM tickets", "tickets")
def effective_settings(spark, sf_dir):
    """The ticket of a payload: null hires when off, enabled tabs only."""
    tabs = F.filter(F.array(F.struct(F.lit("face").alias("model"), (F.col("doc_id") % 2 == 0).alias("enabled")), F.struct(F.lit("hand").alias("model"), F.lit(False).alias("enabled"))), lambda x: x["enabled"])
    return tickets(spark, sf_dir).select("doc_id", F.concat(F.lit("x"), F.col("mtime").cast("string")).alias("size"), F.when(F.col("mtime") % 2 == 0, "hires").alias("hires"), F.size(F.split("prompt", ", ")).alias("n_tokens"), F.get(F.transform(tabs, lambda x: x["model"]), F.lit(0)).alias("tab"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), chr(10)) AS lines FROM documents WHERE source = 'src3' AND len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) > 0")
def snippets(spark, sf_dir):
    """A section's snippets without blank lines; empty ones are rejected."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", lines.alias("l")).where("size(l) > 0").select("doc_id", F.array_join("l", "\n").alias("lines"))
